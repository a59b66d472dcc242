"""Literal expectations and edge cases of the other operators."""

import random

import pytest
from pyspark.sql import functions as F

from recallgrid.functions.exprs import entity_id, fingerprint, fnv1a64, normalize_alias
from recallgrid.functions.greedy import greedy_independent
from recallgrid.operators import accounting as A
from recallgrid.operators import context as C
from recallgrid.operators import entities as E
from recallgrid.operators import extraction as X
from recallgrid.operators import maintenance as M
from recallgrid.operators import registers as G
from recallgrid.operators import retrieval as R
from recallgrid.operators import state as S
from recallgrid.operators import store as ST


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_hash_vectors(spark):
    assert one(spark, fnv1a64(F.lit("a"))) == "af63dc4c8601ec8c"
    assert one(spark, fnv1a64(F.lit(""))) == "cbf29ce484222325"
    assert one(spark, entity_id(F.lit("peter"))) == "ent_5a3f68576c2bbcfd"
    assert one(spark, fingerprint("message-source", F.lit('{"activeSwipe":0,"messageIndex":0,"name":"User","role":"user","text":"Hello"}'))) == "fp1_298b977d95e62dd4"
    assert one(spark, fnv1a64(F.lit(None).cast("string"))) is None


def test_normalize_alias(spark):
    assert one(spark, normalize_alias(F.lit("  Ünïcode—O’Brien  42 ñ"))) == "unicode o brien 42 n"
    assert one(spark, normalize_alias(F.lit("é"))) == "e"


RESULT, SHOT = "register string, event string, subject string, position int, seq bigint", "register string, subject string, points int, complete boolean, seq bigint"


def standing(spark, results, amendments=(), shots=()):
    out = G.standings(spark.createDataFrame(results, RESULT), spark.createDataFrame(list(amendments), RESULT), spark.createDataFrame(list(shots), SHOT))
    return {r["subject"]: r["points"] for r in out.collect()}


def test_standings(spark):
    r1 = [("w", "r1", "edward", 1, 1), ("w", "r1", "loeb", 2, 1)]
    assert standing(spark, [*r1, ("w", "r2", "loeb", 1, 2), ("w", "r2", "edward", 3, 2)]) == {"edward": 16, "loeb": 18}
    assert standing(spark, r1, [("w", "r1", "edward", 3, 2)]) == {"edward": 6, "loeb": 8}
    assert standing(spark, [*r1, ("w", "r1", "edward", 2, 5)], [("w", "r1", "edward", 3, 2)]) == {"edward": 8}
    assert standing(spark, [], [], [("w", "edward", 47, False, 1), ("w", "loeb", 43, False, 1), ("w", "edward", 50, False, 2)]) == {"edward": 50, "loeb": 43}
    assert standing(spark, r1, [], [("w", "loeb", 5, True, 9)]) == {"loeb": 5}


def test_tournament(spark):
    m = lambda done: spark.createDataFrame([("t", "semi", "bob", "semi", True, 1), ("t", "final", "alice", "final", done, 2)], "register string, match string, winner string, round string, complete boolean, seq bigint")
    assert tuple(G.tournaments(m(False)).first()) == ("t", 2, None, True)
    assert tuple(G.tournaments(m(True)).first()) == ("t", 2, "alice", False)


def test_register_reducers(spark, as_rows):
    @G.register_reducer("count")
    def count(rows):
        return str(len(rows))

    obs = spark.createDataFrame([("a", "count", 1), ("a", "count", 2), ("b", "none", 1)], "register string, type string, seq bigint")
    assert as_rows(G.reduce_registers(obs)) == [("a", "count", "2"), ("b", "none", None)]


def test_relationships(spark):
    rows = [("c", 1, ["b", "a"], "trust", "set", "low"), ("c", 2, ["a", "b"], "trust", "add", "x"), ("c", 3, ["a", "b"], "trust", "add", "y"), ("c", 4, ["a", "b"], "bond", "add", "z"), ("c", 5, ["a", "b"], "bond", "remove", None), ("c", 6, ["a", "b"], "feud", "set", "v"), ("c", 7, None, "feud", "set", "w")]
    got = {r["dimension"]: r["values"] for r in S.relationships(spark.createDataFrame(rows, "chat_id string, seq bigint, participants array<string>, dimension string, op string, value string")).collect()}
    assert got == {"trust": ["x", "y"], "feud": ["v"]}


def test_commitments_age(spark):
    rows = [("c", 1, "a", "b", "swim", "made", "explicit"), ("c", 2, "a", "b", "swim", "kept", None), ("c", 3, "a", None, "run", "made", "explicit")]
    state = S.commitments(spark.createDataFrame(rows, "chat_id string, seq bigint, actor string, toward string, content string, transition string, evidence string"))
    assert {(r["content"], r["status"], r["touches"]) for r in state.collect()} == {("swim", "kept", 2), ("run", "active", 1)}
    ords = S.segment_ordinals(spark.createDataFrame([("c", f"s{i}", i, i) for i in range(4)], "chat_id string, segment_id string, first_index int, last_index int"))
    run = next(r["commitment_id"] for r in state.collect() if r["content"] == "run")
    touch = spark.createDataFrame([("c", "s0", "commitment", run)], "chat_id string, segment_id string, kind string, key string")
    aged = lambda n: {r["content"]: (r["aged_out"], r["age_segments"]) for r in S.commitment_ageout(state, S.provenance(touch, ords), ords, n).collect()}
    assert aged(3) == {"run": (True, 3), "swim": (False, None)} and aged(0)["run"] == (False, 3) and aged(4)["run"] == (False, 3)


def test_conflicts_keep_the_last(spark, as_rows):
    rows = [("c", 1, "s", "p", "a", False), ("c", 2, "s", "p", "b", False), ("c", 3, "s", "p", "b", False), ("c", 4, "s", "p", "c", True), ("c", 5, "s", "q", None, False), ("c", 6, "s", "q", "z", False)]
    assert as_rows(S.conflicts(spark.createDataFrame(rows, "chat_id string, seq bigint, subject string, property string, value string, superseding boolean"))) == [("c", "s", "p", 2, "a", "b")]


def test_bm25_prefers_the_concise(spark):
    docs = spark.createDataFrame([(1, "the promise about the letter"), (2, "promise " + " ".join(f"filler{i}" for i in range(120))), (3, None), (4, "nothing here")], "doc_id bigint, text string")
    terms = R.query_terms(spark.createDataFrame([(9, "A promise, the promise!")], "query_id bigint, text string"))
    assert [r["term"] for r in terms.collect()] == ["promise"]
    got = R.top_k(R.bm25(R.postings(docs), R.document_stats(docs), terms), 5).orderBy("place").collect()
    assert [r["doc_id"] for r in got] == [1, 2]


def test_cosine_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    r = random.Random(1)
    v = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, []), (62, [0.0] * 8), (63, [1.0])]
    df = spark.createDataFrame(v, "doc_id bigint, embedding array<double>")
    asked, got = df.where("doc_id % 5 = 0 and doc_id < 60").withColumnRenamed("doc_id", "query_id"), {}
    blocks = sorted(tuple(r) for r in R.cosine_top_k(df, asked, 4, most_cells=0).collect())
    for row in R.cosine_top_k(df, asked, 4).collect():
        got.setdefault(row["query_id"], []).append((row["place"], row["doc_id"], row["score"]))
    assert [(q, d, p) for q, d, _, p in blocks] == sorted((q, d, p) for q, rows in got.items() for p, d, _ in rows)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    for q in range(0, 60, 5):
        want = sorted(((-cos(v[q][1], v[d][1]), d) for d in range(60) if d != q))[:4]
        assert [(d, round(s, 9)) for _, d, s in sorted(got[q])] == [(d, round(-s, 9)) for s, d in want if -s > 0]
    pair = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([0.0], [0.0])], "a array<double>, b array<double>")
    assert [round(x[0], 6) for x in pair.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0, 0, 0]


def test_hybrid_ranking_prefers_an_exact_old_thread(spark):
    docs = spark.createDataFrame([(1, "c", 10), (2, "c", 900), (3, "c", 1000), (4, "d", 5)], "doc_id bigint, chat_id string, last_index int")
    queries = spark.createDataFrame([(3, "c")], "query_id bigint, chat_id string")
    lexical = spark.createDataFrame([(3, 2, 0.3), (3, 3, 9.0), (3, 4, 9.0)], "query_id bigint, doc_id bigint, score double")
    keys = spark.createDataFrame([(1, "thread", "t"), (2, "entity", "e"), (4, "thread", "t")], "doc_id bigint, kind string, key string")
    boosts = R.key_boosts(keys, spark.createDataFrame([(3, "thread", "t"), (3, "speaker", "e"), (3, "participant", "e")], "query_id bigint, kind string, key string"))
    assert {(r["doc_id"], r["boost"]) for r in boosts.collect()} == {(1, 2.0), (2, 1.5), (4, 2.0)}
    got = R.hybrid_top_k(docs, queries, lexical, None, boosts.where("doc_id <> 2"), 5, recency_weight=0.5).orderBy("place").collect()
    assert [r["doc_id"] for r in got] == [1, 2] and got[1]["recency"] == 1.0
    vectors = spark.createDataFrame([(1, "c", [1.0, 0.0]), (2, "c", [0.0, 1.0]), (3, "c", [0.0, 2.0]), (4, "d", [0.0, 1.0])], "doc_id bigint, chat_id string, embedding array<double>")
    near = R.cosine_within(vectors, vectors.where("doc_id = 3").withColumnRenamed("doc_id", "query_id"), "chat_id")
    assert {(r["doc_id"], round(r["score"], 9)) for r in near.collect()} == {(2, 1.0), (3, 1.0)}
    got = R.hybrid_top_k(docs, queries, lexical, near, None, 5).collect()
    assert [(r["doc_id"], round(r["semantic"], 9)) for r in got] == [(2, 1.0)]


def test_hot_terms_are_spread(spark, as_rows, monkeypatch):
    docs = spark.createDataFrame([(i, "harbour " + "x" * (i % 7) + f" w{i % 3}") for i in range(50)], "doc_id bigint, text string")
    terms = R.query_terms(spark.createDataFrame([(1, "harbour w1"), (2, "harbour")], "query_id bigint, text string"))
    ask = lambda: sorted((r["query_id"], r["doc_id"], round(r["score"], 9), r["matched"]) for r in R.bm25(R.postings(docs), R.document_stats(docs), terms).collect())
    whole = ask()
    monkeypatch.setattr(R, "HOT_TERM", 4)
    assert ask() == whole and len(whole) == 100


def test_retrieval_quality(spark):
    res = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2)], "query_id bigint, doc_id bigint, place int")
    rel = spark.createDataFrame([(1, 10), (2, 21)], "query_id bigint, doc_id bigint")
    q = R.retrieval_quality(res, rel, spark.createDataFrame([(1,), (2,)], "query_id bigint"), 2).first()
    assert (q["recall_at_k"], q["precision_at_k"], q["mrr"]) == (1.0, 0.5, 0.75)
    assert R.retrieval_quality(res.limit(0), rel.limit(0), spark.createDataFrame([(1,)], "query_id bigint"), 2).first()["recall_at_k"] == 1.0


def test_budgets(spark):
    row = spark.createDataFrame([(6000, 8000, 800, 300, 2500, 1500), (0, None, 0, 0, 0, 0)], "hard int, raw int, state int, registers int, chronological int, associative int")
    assert [r["raw_budget"] for r in C.allocate_budgets(row).collect()] == [3600, 0]


def test_pack_skips_what_does_not_fit(spark, as_rows):
    items = spark.createDataFrame([("c", "state", "a", 1, 40), ("c", "state", "b", 2, 400), ("c", "state", "d", 3, 20), ("c", "associative", "e", 4, 10), ("c", "nowhere", "f", 5, 10)], "chat_id string, region string, item string, place int, n_chars int")
    raw = spark.createDataFrame([("c", 100)], "chat_id string, raw_chars bigint")
    got = C.pack(items, raw, {"state": 30, "associative": 50}, 100)
    assert as_rows(got, "item", "kept") == [("a", True), ("b", False), ("d", True), ("e", True)]
    assert as_rows(C.pack(items, raw, {"state": 30, "associative": 50}, 60), "item", "kept") == [("a", False), ("b", False), ("d", False), ("e", False)]
    assert C.pack(items.limit(0), raw, {"state": 1}, 5).count() == 0


def test_omitted_indices(spark, as_rows):
    seg = spark.createDataFrame([("c", "a", 0, 1, "valid", None), ("c", "b", 2, 2, "failed", None), ("c", "d", 3, 3, "stale", None), ("c", "e", 1, 1, "valid", False)], "chat_id string, segment_id string, first_index int, last_index int, status string, eligible boolean")
    raw = spark.createDataFrame([("c", i) for i in (2, 3, 4)], "chat_id string, message_index int")
    assert as_rows(C.omitted_indices(seg, raw)) == [("c", 0), ("c", 1)]
    assert as_rows(C.omitted_indices(seg.where("segment_id = 'b'").withColumn("status", F.lit("valid")), raw)) == []


SEG = "chat_id string, segment_id string, first_index int, last_index int, status string, dependency_ids array<string>"


def test_invalidation(spark, as_rows):
    three = spark.createDataFrame([("c", "a", 0, 4, "valid", []), ("c", "b", 5, 9, "valid", []), ("c", "d", 10, 14, "valid", None)], SEG)
    edit = lambda i: spark.createDataFrame([("c", i)], "chat_id string, edit_index int")
    assert as_rows(M.invalidate(three, edit(7)), "segment_id", "status") == [("a", "valid"), ("b", "stale"), ("d", "stale")]
    deps = spark.createDataFrame([("c", "x", 0, 0, "valid", ["y"]), ("c", "y", 10, 12, "valid", []), ("c", "z", 1, 1, "excluded", ["x"])], SEG)
    assert as_rows(M.invalidate(deps, edit(11)), "segment_id", "status", "reason") == [("x", "stale", "dependency"), ("y", "stale", "covers"), ("z", "excluded", "dependency")]
    spans = spark.createDataFrame([("c", "a", 0, 2, "valid", []), ("c", "b", 3, 5, "valid", []), ("c", "d", 6, 8, "valid", [])], SEG)
    assert as_rows(M.shift_ranges(spans, edit(4)), "first_index", "last_index") == [(0, 2), (3, 4), (5, 7)]


@pytest.mark.parametrize("seed", range(3))
def test_reuse_equals_the_greedy_walk(spark, seed):
    import datetime as dt

    r = random.Random(seed)
    rows = [(r.choice("ab"), i, (f := r.randint(0, 40)), f + r.randint(-1, 9), r.choice([True, False, None]), dt.datetime(2024, 1, r.randint(1, 9))) for i in range(60)]
    got = {(x["chat_id"], x["segment_id"]) for x in M.reusable_segments(spark.createDataFrame(rows, "chat_id string, segment_id bigint, first_index int, last_index int, manual boolean, updated_at timestamp")).collect()}
    taken = []
    for x in sorted((x for x in rows if x[2] <= x[3]), key=lambda x: (bool(x[4]), -x[2], x[5], x[1]), reverse=True):
        if not any(x[0] == y[0] and x[2] <= y[3] and x[3] >= y[2] for y in taken):
            taken.append(x)
    assert got == {(x[0], x[1]) for x in taken}
    empty = spark.createDataFrame([], "k string, n bigint, rank int")
    assert greedy_independent(empty, spark.createDataFrame([], "k string, a bigint, b bigint"), ["k"], "n", "rank").count() == 0


REQUEST = "ledger int, session bigint, attempt_id bigint, ts timestamp, day string, projected bigint, actual bigint"


def test_token_guard(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(7, 1, i, t + dt.timedelta(hours=i), "d1" if i < 3 else "d2", p, a) for i, (p, a) in enumerate([(15, 15), (990, 10), (10, 10), (5, 5)])]
    got = [(r["decision"], r["spent_before"]) for r in A.token_guard(spark.createDataFrame(rows, REQUEST), 1000, 24).orderBy("attempt_id").collect()]
    assert got == [("sent", 0), ("session_cap", 15), ("daily_cap", 15), ("sent", 15)]
    assert [r["decision"] for r in A.token_guard(spark.createDataFrame(rows[:1], REQUEST), 8, 0).collect()] == ["session_cap"]
    assert A.token_guard(spark.createDataFrame([], REQUEST), 8, 0).count() == 0
    # 10 in and 5 out of a cap of 1000 leave 985
    one = [(7, 1, 0, t, "d", 15, 15), (7, 1, 1, t, "d", 985, 985), (7, 1, 2, t, "d", 1, 1)]
    assert [r["decision"] for r in A.token_guard(spark.createDataFrame(one, REQUEST), 1000, 0).orderBy("attempt_id").collect()] == ["sent", "sent", "session_cap"]


def test_a_day_is_shared_by_the_sessions_of_a_ledger(spark, as_rows):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(ledger, session, i, t + dt.timedelta(minutes=i), "d1" if i < 4 else "d2", 10, 10, healthy) for i, (ledger, session, healthy) in enumerate([(1, 1, True), (1, 2, None), (1, 3, True), (2, 1, True), (1, 3, True), (1, 1, False)])]
    got = A.token_guard(spark.createDataFrame(rows, REQUEST + ", healthy boolean"), 0, 20)
    assert as_rows(got, "attempt_id", "decision", "day_before") == [(0, "sent", 0), (1, "sent", 10), (2, "daily_cap", 20), (3, "sent", 0), (4, "sent", 0), (5, "ledger_unavailable", 10)]
    assert as_rows(A.token_guard(spark.createDataFrame(rows, REQUEST + ", healthy boolean"), 0, 0).where("decision <> 'sent'")) == []


def test_rules_of_the_reducer(spark, as_rows):
    ids = spark.createDataFrame([("a", "b", "c", None), ("a", "b", "c", "mine"), ("a", None, "c", None)], "actor string, toward string, content string, own string").select(S.commitment_id(F.col("actor"), F.col("toward"), F.col("content"), F.col("own")).alias("id"))
    got = [r["id"] for r in ids.collect()]
    assert got[:2] == ["commit_e689323f6a5f21c7", "mine"] and got[2] != got[0]
    rows = [("c", 1, "Love", "x", "open"), ("c", 2, "debt", "Drama", "open"), ("c", 3, "debt", "who pays", "advanced"), ("c", 4, "debt", "tension", "resolved"), ("c", 5, "key", None, "open")]
    assert as_rows(S.threads(spark.createDataFrame(rows, "chat_id string, seq bigint, key string, description string, transition string"))) == [("c", "debt", "who pays", "active"), ("c", "key", None, "open")]
    negatives = [
        ("c", 1, "Ann  did it", "she refused", None, None), ("c", 2, "ann did IT", "explicitly denied", True, None), ("c", 3, "Bo came", "no reason", True, None), ("c", 4, "Cy won", "whatever", None, True), ("c", 5, "Dee left", "without a word", False, True),
        ("c", 6, "ｆｕｌｌ width", "rejected", None, None), ("c", 7, "Full width", "rejected", None, None), ("c", 8, None, "rejected", None, None), ("c", 9, "Ed ran", None, None, None),
    ]
    got = S.salient_negatives(spark.createDataFrame(negatives, "chat_id string, seq bigint, proposition string, reason string, continuity_relevant boolean, contrastive boolean"))
    assert as_rows(got) == [("c", 1, "Ann  did it"), ("c", 4, "Cy won"), ("c", 6, "ｆｕｌｌ width")]


def test_terms_of_every_field(spark):
    values = {
        "relationship_dimension": {"mutual respect": "trust", "rapport": "emotional_closeness", "Trust ": "trust", "nothing": None}, "commitment_transition": {"fulfilled": "kept", "open": "active", "made": "made"}, "thread_transition": {"closed": "resolved", "still-open": "active"},
        "state_operation": {"update": "revise", "maintain": "set", "persist": "set"}, "relationship_operation": {"confirm": "set", "established": "set"}, "knowledge_operation": {"set": "add", "maintain": "revise"}, "knowledge_kind": {"fact": "knows", "observation": "knows", "assessment": "believes"},
        "temporal_kind": {"timer": "exact", "elapsed": "relative"}, "location_kind": {"present": "presence", "sublocation": "scene"}, "persistence": {"permanent": "durable", "ongoing": "active"}, "salience": {"high": "important", "Medium": "normal"}, "domain": {"boundary": "relationship"},
    }
    for field, pairs in values.items():
        rows = spark.createDataFrame([(k,) for k in pairs], "v string").select("v", X.normalize_term(F.col("v"), field).alias("t")).collect()
        assert {r["v"]: r["t"] for r in rows} == pairs, field
    assert spark.range(1).select(X.normalize_term(F.lit("rapport"), "relationship_dimension", provider=False).alias("t")).first()["t"] is None
    assert [r["d"] for r in spark.createDataFrame([("Social ",), ("physical",), ("what",), (None,), ("boundary",)], "v string").select(X.normalize_domain(F.col("v")).alias("d")).collect()] == ["social", "physical", "other", "other", "relationship"]


def test_all_sections_of_tagged_output(spark, as_rows):
    good = {
        "ENTITIES": "- name=Ann", "EVENTS": "- event=x | domains=social, family", "OBSERVATIONS": "- fact=f | scope=world", "STATE_CHANGES": "- subject=s|path=p|value=1", "KNOWLEDGE": "- holder=h | kind=knows | proposition=p", "RELATIONSHIPS": "- participants=a, b | dimension=trust | change=up",
        "COMMITMENTS": "- actor=a | transition=made | content=c", "THREADS": "- key=k | transition=advance | description=d", "SALIENT_NEGATIVES": "- proposition=p | reason=r | continuity=Yes", "REGISTERS": "- registerKey=r", "INTERPRETATIONS": "- it seems | evidence=weak_inference",
        "TEMPORAL": "- at dawn | kind=exact", "LOCATIONS": "- location=quay | kind=scene",
    }
    bad = {
        "ENTITIES": "- | x=1", "EVENTS": "- event=x | domains=social, nonsense", "OBSERVATIONS": "- only plain", "STATE_CHANGES": "- subject=s|path=p", "KNOWLEDGE": "- holder=h | kind=guesses | proposition=p", "RELATIONSHIPS": "- participants=a | dimension=trust | value=up", "COMMITMENTS": "- actor=a | transition=Made | content=c",
        "THREADS": "- key=k | transition=made | description=d", "SALIENT_NEGATIVES": "- proposition=p | reason=r", "REGISTERS": "- registerKey=r | kind=odd", "INTERPRETATIONS": "- it seems | evidence=explicit", "TEMPORAL": "- at dawn", "LOCATIONS": "- location=quay | kind=where",
    }
    text = "[SYNOPSIS]\nIt was “over.”\n" + "\n".join(f"[{k}]\n{good[k]}\n{bad[k]}\n- None" for k in good) + "\n[UNKNOWN]\n- x"
    rows = spark.createDataFrame([(1, text), (2, "[EVENTS]\n- a"), (3, "[SYNOPSIS]\nIt broke of\n[EVENTS]\n- a"), (4, "[SYNOPSIS]\nNothing.\n[EVENTS]\n- none"), (5, None), (6, "[SYNOPSIS]\nx.\n[EVENTS]\n" + "- e\n" * 103)], "id int, c string")
    got = as_rows(X.parse_tagged(rows.where("id = 1"), "id", "c"), "section", "item_no", "ok")
    assert got == sorted((k, n, n == 1) for k in good for n in (1, 2))
    shown = {r["section"]: r["details"] for r in X.parse_tagged(rows.where("id = 1"), "id", "c").where("item_no = 1").collect()}
    assert shown["OBSERVATIONS"] == "evidence=explicit; persistence=historical; salience=normal" and shown["THREADS"] == "evidence=explicit; transition=advanced" and shown["ENTITIES"] == ""
    out = {r["id"]: (r["reason"], r["n_items"], r["degraded"], r["warnings"]) for r in X.tagged_outcome(rows, "id", "c").collect()}
    assert out[1][:3] == ("ok", 13, False) and out[1][3].count("discarded") == 13
    assert out[2][0] == "missing_synopsis" and out[3][0] == "truncated_synopsis" and out[4] == ("ok", 0, True, "") and 5 not in out
    assert out[6] == ("ok", 100, False, "EVENTS: item cap applied")
    assert {r["id"]: r["reason"] for r in X.tagged_outcome(rows, "id", "c", require_semantic=True).collect()}[4] == "semantic_empty"


def test_usage_and_privacy(spark, as_rows):
    u = spark.createDataFrame([(1, '{"prompt_tokens": 10, "prompt_tokens_details": {"cached_tokens": 4}, "completion_tokens": 3}'), (2, '{"input_tokens": 7}'), (3, None), (4, "{bad")], "id int, usage string")
    assert as_rows(A.normalize_usage(u), "id", "nominal", "cached", "uncached", "output") == [(1, 10, 4, 6, 3), (2, 7, None, None, None), (3, None, None, None, None), (4, None, None, None, None)]
    e = spark.createDataFrame([('{"a": {"Text": "x"}}',), ('{"a": 1}',), (None,)], "j string")
    assert [r["allowed"] for r in A.privacy_guard(e, "j").collect()] == [False, True, True]
    assert one(spark, A.mask_secrets(F.lit("failed: api_key=abc sk-12.3 end"))) == "failed: api_key: [redacted] [redacted] end"
    assert one(spark, A.redact_diagnostic(F.lit('got "a \\" b" or \'c\''))) == "got [redacted] or [redacted]"


def test_percentile_by_nearest_rank(spark):
    df = spark.createDataFrame([("a", x) for x in (5, 1, 9, 9, 3)] + [("b", None)], "k string, v int")
    r = A.nearest_rank(df, ["k"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0}).collect()
    assert len(r) == 1 and (r[0]["p50"], r[0]["p95"], r[0]["p0"], r[0]["n"]) == (5, 9, 1, 5)


def test_proposals(spark):
    reg = spark.createDataFrame([("c", "e1", "peter parker", "p"), ("c", "e2", "mary jane watson", None), ("c", "e3", "alex stone", None), ("c", "e4", "alex rivers", None)], "chat_id string, entity_id string, alias string, sender_id string")
    q = spark.createDataFrame([(1, "c", "peter", None), (2, "c", "alex", None), (3, "c", "mary", None), (4, "c", "peter parker", "p"), (5, "c", "nobody", None), (6, "d", "peter", None), (7, "c", "", None)], "mention_id bigint, chat_id string, name string, sender_id string")
    got = {r["mention_id"]: (r["proposed_entity_id"], r["confidence"], r["requires_confirmation"]) for r in E.propose(q, reg).collect()}
    assert got == {1: ("e1", "uncertain", True), 2: (None, "uncertain", True), 3: (None, "uncertain", True), 4: ("e1", "high", False), 5: (None, "uncertain", True), 6: (None, "new", True)}


def test_extraction_states(spark, as_rows):
    ok = '{"synopsis": "a \\" [ b", "entities": [], "events": [], "stateChanges": [], "threads": [], "salientNegatives": []}'
    rows = [(1, ok), (2, ok[:40]), (3, "{}"), (4, '{"synopsis": "x"}'), (5, "nonsense"), (6, None), (7, ok + " done"), (8, "[1, 2]")]
    got = dict(as_rows(X.parse_structured(spark.createDataFrame(rows, "id int, c string"), "id", "c"), "id", "reason"))
    assert got == {1: "ok", 2: "truncated", 3: "empty_object", 4: "schema_invalid", 5: "invalid_json", 7: "truncated", 8: "empty_object"}
    assert one(spark, X.normalize_evidence(F.lit("It is implied"))) == "strong_inference"
    assert one(spark, X.normalize_evidence(F.lit(None).cast("string"))) == "explicit"
    assert one(spark, X.sanitize(F.lit(" <b>\x01x "))) == "&lt;b&gt;x"
    err = spark.createDataFrame([("quota", None, None, None), (None, 503, None, None), (None, None, "HTTP 429 it says", None), (None, None, None, "Type Error!")], "a string, b int, c string, d string")
    assert [r[0] for r in err.select(X.provider_failure(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == ["provider_quota", "provider_http_503", "provider_http_429", "provider_type_error"]


def test_tagged_lines(spark, as_rows):
    text = "[SYNOPSIS]\nx.\n[EVENTS]\n- description=a | evidence=weak_inference\n- plain event\n- none\n- description=b | evidence=maybe\n[ODD]\n- z=1\n[THREADS]\n- key=k | transition=open\n- Key=k|transition=open|description=d"
    got = as_rows(X.parse_tagged(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, c string"), "id", "c"), "section", "item_no", "main", "ok")
    assert got == [("EVENTS", 1, "a", True), ("EVENTS", 2, "plain event", True), ("EVENTS", 3, "b", False), ("THREADS", 1, "k", False), ("THREADS", 2, "k", True)]


def test_store_rules(spark, as_rows):
    log = spark.createDataFrame([("s", "k", 1, "a", False), ("s", "k", 2, "b", None), ("s", "j", 1, "a", False), ("s", "j", 2, None, True)], "store string, key string, n int, value string, deleted boolean")
    assert as_rows(ST.last_writes(log, ["store", "key"], "n", "value", "deleted")) == [("s", "k", "b")]
    rec = spark.createDataFrame([("r:s1:g:1", "x"), ("r:s1:g:10", "y"), ("r:s1:index", "z"), ("q:s1:g:11", "w")], "key string, value string")
    assert as_rows(ST.latest_by_prefix(rec, "r")) == [("s1", "g", 10, "y")]
    seg = spark.createDataFrame([("a", "excluded", "text", False), ("b", "excluded", "", False), ("d", "valid", "t", True)], "segment_id string, status string, synopsis string, pinned boolean")
    act = spark.createDataFrame([("a", 1, "include", None), ("b", 1, "include", None), ("d", 2, "unpin", None), ("d", 1, "pin", None), ("z", 1, "pin", None)], "segment_id string, seq int, action string, value string")
    assert as_rows(ST.fold_actions(seg, act), "segment_id", "status", "pinned") == [("a", "valid", False), ("b", "pending", False), ("d", "valid", False)]
