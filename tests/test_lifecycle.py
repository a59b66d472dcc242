from pyspark.sql import functions as F

from recallgrid.functions.vocabulary import EVIDENCE
from recallgrid.functions.vocabulary import TERMS as T
from recallgrid.operators import lifecycle as L
from recallgrid.operators import validation as V


def test_profiles(spark, as_rows):
    rows = [("default", None, 1, "upsert", "t", "1"), ("default", None, 3, "upsert", "t", "2"), ("chats", "a", 1, "upsert", "t", "1"), ("chats", "a", 2, "remove", None, None), ("chats", "a", 3, "upsert", "p", "9"), ("chats", "b", 1, "upsert", "t", "1"), ("chats", "b", 2, "upsert", None, None), ("chats", None, 1, "upsert", "t", "1"), ("chats", "a", 3, "upsert", "p", "9")]
    df = spark.createDataFrame(rows, "scope string, id string, seq int, op string, key string, value string")
    assert as_rows(L.profile_catalog(df)) == [("chats", "a", "p", "9"), ("default", "", "t", "2")]
    assert as_rows(L.profile_catalog(df, lambda k, v: v < "9")) == [("default", "", "t", "2")]
    assert L.profile_catalog(df.limit(0)).count() == 0


def test_one_job_at_a_time(spark, as_rows):
    rows = [("c", 1, 0, 10), ("c", 2, 5, 20), ("c", 3, 10, 12), ("c", 4, 11, 30), ("c", 5, 12, None), ("c", 6, 99, 100), ("d", 7, 5, 6), ("d", 8, 5, 6), (None, 9, 1, 2), ("d", 10, None, 3)]
    df = spark.createDataFrame(rows, "chat_id string, job_id int, begun int, ended int")
    assert as_rows(L.single_flight(df), "job_id", "granted") == sorted([(1, True), (2, False), (3, True), (4, False), (5, True), (6, False), (7, True), (8, False)], key=str)
    assert L.single_flight(df.limit(0)).count() == 0


def test_vectors_from_cache_model_or_nowhere(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if any(x == "bad" for x in texts):
            raise ValueError(x for x in texts)
        return [[float(len(x))] for x in texts]

    texts = spark.createDataFrame([(1, "f1", "one"), (2, "f2", "three"), (3, "f2", "three"), (4, "f3", "bad"), (5, None, None), (6, "f4", None)], "id int, fingerprint string, text string")
    cache = spark.createDataFrame([("f1", [7.0]), ("f1", None), ("f9", [1.0])], "fingerprint string, embedding array<double>")
    got = {r["id"]: (r["embedding"], r["source"]) for r in L.embed_with_cache(texts, cache, embed, ["id"]).collect()}
    assert got == {1: ([7.0], "cache"), 2: ([5.0], "model"), 3: ([5.0], "model"), 4: (None, "failed"), 5: (None, "failed"), 6: (None, "failed")}


def test_logs_of_writes(spark, as_rows):
    p = spark.createDataFrame([("c", 1, "k", "a"), ("c", 2, "k", None), ("c", 2, "k", None), ("d", 1, "k", "z")], "chat_id string, seq int, key string, value string")
    assert as_rows(L.fold_preferences(p)) == [("c", "k", None), ("d", "k", "z")]
    assert as_rows(L.revisions(p.withColumn("at", F.col("seq"))), "chat_id", "revision", "updated") == [("c", 2, 2), ("d", 1, 1)]
    now = spark.createDataFrame([("c", 1), ("d", 2)], "chat_id string, v int")
    assert as_rows(L.replace_chats(now, now.where("chat_id = 'c'").withColumn("v", F.lit(9)))) == [("c", 9), ("d", 2)]
    o = spark.createDataFrame([("r", 5, None, "x"), ("r", 2, "race", "y"), ("s", 1, None, "z"), (None, 1, None, "w")], "register string, at int, type string, subject string")
    assert as_rows(L.register_log(o), "register", "type", "observation_no", "subject") == [("r", "race", 1, "y"), ("r", "race", 2, "x"), ("s", "generic", 1, "z")]
    s = spark.createDataFrame([("a", "valid", True), ("b", "valid", False), ("c", "stale", None), ("d", "valid", None)], "segment_id string, status string, eligible boolean")
    assert as_rows(L.semantic_counts(s, {"x": s.unionByName(s), "y": s.where("segment_id = 'b'")})) == [("x", 4)]


def test_sources_of_responses(spark, as_rows):
    q = spark.createDataFrame([(1, "live", "f"), (2, "replay", "f"), (3, "replay", "g"), (4, "offline", "f"), (5, "replay", None)], "request_id int, mode string, fingerprint string")
    r = spark.createDataFrame([("f", 1, "old"), ("f", 2, "new")], "fingerprint string, attempt int, response string")
    assert as_rows(L.generation_source(q, r), "request_id", "source", "response") == [(1, "provider", None), (2, "record", "new"), (3, "replay_missing", None), (4, "unavailable", None), (5, "replay_missing", None)]


def test_further_validators(spark, as_rows):
    e = "ent_" + "0" * 16
    r = spark.createDataFrame([(1, [e, e], "trust", "set", "v", "explicit"), (2, [e], "trust", "set", None, "explicit"), (3, None, "odd", None, "v", None), (4, [e, "Ann"], "trust", "add", "v", "explicit")], "rel_change_id int, participants array<string>, dimension string, operation string, value string, evidence string")
    got = {x["rel_change_id"]: x["errors"] for x in V.validate_relationships(r, T["relationship_dimension"], T["relationship_operation"], EVIDENCE).collect()}
    assert got[1] == "" and got[2] == "at least two participants are required; value is required" and got[3].count(";") == 4 and got[4] == "participants must be EntityIds"
    t = spark.createDataFrame([(1, "x", "exact", "explicit"), (2, " ", None, "explicit")], "mark_id int, description string, kind string, evidence string")
    assert as_rows(V.validate_temporal(t, T["temporal_kind"], EVIDENCE), "mark_id", "ok") == [(1, True), (2, False)]
    s = spark.createDataFrame([(1, e, "p", "remove", None, "active", "explicit"), (2, e, "p", "set", None, "active", "explicit"), (3, None, None, None, None, None, None)], "change_id int, subject string, path string, operation string, value string, persistence string, evidence string")
    assert as_rows(V.validate_state_changes(s, T["state_operation"], T["persistence"], EVIDENCE), "change_id", "ok") == [(1, True), (2, False), (3, False)]
    c = spark.createDataFrame([("s", "p", "a", "b", "unresolved"), ("s", "p", "a", None, "gone")], "subject string, property string, earlier string, later string, status string")
    assert as_rows(V.validate_conflicts(c), "errors", "ok") == [("", True), ("both claims are required; status is unknown", False)]
    assert V.search_records(c, " GONE ", ("subject", "status")).count() == 1 and V.search_records(c, " ", ("subject",)).count() == 2
