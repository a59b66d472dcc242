import itertools
import os
import random
from pathlib import Path

import pytest

from recallgrid.llm import names as N
from recallgrid.llm.names import BANDS, LINK, SIMILARITY, band_keys, bands_for, candidate_pairs, cluster_mentions, core, is_full, mention_pairs, monge_elkan, qgrams, resolve, similarity

DATA = os.environ.get("TEST_DATA_LARGE", "/root/testdata/sf0.1")
SCHEMA = "mention_id bigint, chat_id string, mention string, aliases array<string>, canonical_name_candidate string, name string, entity int"


def table(spark, rows):
    return spark.createDataFrame([(i, chat, m, al, cand, "clash", 1) for i, (chat, m, al, cand) in enumerate(rows)], SCHEMA)


def groups(spark, rows):
    out = {}
    for r in cluster_mentions(table(spark, rows)).collect():
        out.setdefault((r["chat_id"], r["entity"]), set()).add(r["mention_id"])
    return sorted(map(sorted, out.values()))


def test_core_names():
    assert core("  The Elyard  Rowing Club ") == ["elyard", "rowing", "club"]
    assert core("Ivlow, Benjamin (leader)?") == ["ivlow", "benjamin"]
    assert core("JudgeTorpatanzin") == ["torpatanzin"]
    assert core("Desmond Ivríchuson's") == ["desmond", "ivrichuson"]
    for nobody in ("someone", "the crowd", "nobody in particular", "???", ""):
        assert core(nobody) == []
    assert is_full(["benjamin", "ivlow"]) and not is_full(["b.", "ivlow"]) and not is_full(["ben", "ivlow"])


def test_similarity_of_variants_and_of_others():
    full = "benjamin ivlow"
    for variant in ("ivlow benjamin", "b. ivlow", "ben ivlow", "benjamin j. ivlow", "benjamin ivlpw", "bejnamin ivlow", "ivlow"):
        assert similarity(full, variant) >= 0.84, variant
    for other in ("charles ivlow", "benjamin korhurst", "c. ivlow", "isabella ivlow"):
        assert similarity(full, other) < 0.84, other
    assert similarity("rebecca t. josmond", "theodore josmond") < 0.84 and similarity("rebecca t. josmond", "rebecca josmond") >= 0.84
    assert similarity("ixrath ferry trdg co", "ixrath ferry trading company") >= 0.84
    assert similarity("arabella kelmond", "isabella kelmond") < 0.84
    assert similarity("corstone ferry rc", "corstone ferry rowing club") >= 0.84
    assert similarity("halgate hist. soc.", "halgate historical society") >= 0.84


def test_short_names_take_hints_that_agree():
    assert resolve("Peg", None, "Margaret Ethstowenby") == ("margaret ethstowenby", True)
    assert resolve("EGRC", ["x"], "Elyard Granite Rowing Club") == ("elyard granite rowing club", True)
    assert resolve("W Dunsulbelrath", None, "Wilhelmina Lorlund") == ("w dunsulbelrath", False)
    assert resolve("Robert Galdry", None, "Someone Else") == ("robert galdry", True)
    assert resolve(None, None, "Robert Galdry") == ("", False)


def test_collision_curve():
    assert bands_for(0.5, 0.9, 2) == 9
    r, hits, n = random.Random(1), 0, 0
    while n < 400:
        word = "".join(r.choice("abcdefghijklmnop") for _ in range(12))
        other = word[:9] + "".join(r.choice("abcdefghijklmnop") for _ in range(3))
        a, b = qgrams(word), qgrams(other)
        if len(a & b) / len(a | b) >= SIMILARITY:
            n += 1
            hits += bool(set(band_keys(word)) & set(band_keys(other)))
    assert hits / n >= 0.98
    assert len(band_keys("benjamin ivlow")) == BANDS


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_bands_select_in_the_largest_chat_and_lose_hardly_a_link(spark):
    """All pairs of the largest chats' names compared, as the measure of what the bands bring together."""
    resolved = N.resolved_mentions(spark.read.parquet(f"{DATA}/entity_mentions.parquet")).select("chat_id", "name").distinct().toPandas()
    by_chat = {c: sorted(g["name"]) for c, g in resolved.groupby("chat_id")}
    largest = sorted(by_chat, key=lambda c: -len(by_chat[c]))[:40]
    signer, links, met = N.Signer(), 0, 0
    for k, chat in enumerate(largest):
        keys = [set(x) for x in signer.keys(by_chat[chat]).tolist()]
        close = [(bool(keys[i] & keys[j]), similarity(by_chat[chat][i], by_chat[chat][j]) >= LINK) for i, j in itertools.combinations(range(len(keys)), 2)]
        links += sum(s for _, s in close)
        met += sum(m and s for m, s in close)
        if k == 0:
            assert sum(m for m, _ in close) <= sum(s for _, s in close) + 0.05 * len(close)
    assert links > 500 and met >= 0.985 * links


def test_hot_buckets_are_split_without_losing_pairs(spark, monkeypatch):
    rows = [("c", f"ivlowlow {chr(97 + i // 26)}{chr(97 + i % 26)}", 1, True) for i in range(60)]
    names = spark.createDataFrame(rows, "chat_id string, name string, n bigint, is_full boolean")
    whole = {tuple(r) for r in candidate_pairs(names).collect()}
    monkeypatch.setattr(N, "SPLIT", 7)
    assert {tuple(r) for r in candidate_pairs(names).collect()} == whole and len(whole) > 500
    clustered = spark.createDataFrame([(i, "c", f"m{i % 5}", "e") for i in range(50)], "mention_id bigint, chat_id string, mention string, entity string")
    assert mention_pairs(clustered).count() == mention_pairs(clustered).distinct().count() == 50 * 49 // 2 - 5 * 45


def test_rounds_and_one_task_cluster_alike(spark, as_rows):
    r = random.Random(4)
    nodes = {(c, f"n{i:02}"): (r.randint(1, 5), r.random() < 0.6) for c in "xy" for i in range(40)}
    rows = []
    for (c, a), (d, b) in itertools.combinations(nodes, 2):
        if c == d and r.random() < 0.06:
            s = r.choice([0.85, 0.9, 1.0])
            rows += [(c, p, q, s, *nodes[c, p], *nodes[c, q]) for p, q in ((a, b), (b, a))]
    edges = spark.createDataFrame(rows, "chat_id string, a string, b string, s double, n_a bigint, full_a boolean, n_b bigint, full_b boolean")
    one, rounds = (as_rows(N.star_clusters(edges, task_links=k), "chat_id", "name", "entity") for k in (10_000, 0))
    assert one == rounds and len({x[2] for x in one}) > 5


def test_clusters(spark):
    rows = [
        ("c1", "Benjamin Ivlow", None, None), ("c1", "Ivlow, Benjamin", [], ""), ("c1", "Ben Ivlow", None, None), ("c1", "B. Ivlow", None, None), ("c1", "Bnejamin Ivlow", None, None), ("c1", "Benjamin Ivlow", None, None),
        ("c1", "Charles Korhurst", None, None), ("c1", "Chuck", None, "Charles Korhurst"), ("c1", "nobody in particular", None, "Charles Korhurst"), ("c1", None, ["Charles Korhurst"], None), ("c1", "  ", None, None),
        ("c2", "Benjamin Ivlow", None, None), (None, "Benjamin Ivlow", None, None), ("c2", "Elyard Granite Rowing Club", None, None), ("c2", "EGRC", ["wrong name here"], "Elyard Granite Rowing Club"),
    ]
    assert groups(spark, rows) == [[0, 1, 2, 3, 4, 5], [6, 7], [11], [13, 14]]
    pairs = {tuple(r) for r in mention_pairs(cluster_mentions(table(spark, rows))).collect()}
    want = {(a, b) for g in ([0, 1, 2, 3, 4, 5], [6, 7], [13, 14]) for a, b in itertools.combinations(g, 2) if rows[a][1] != rows[b][1]}
    assert pairs == want


def test_short_name_between_two(spark):
    rows = [("c", "Margaret Ethstowenby", None, None), ("c", "Charles Ethstowenby", None, None), ("c", "Mr Ethstowenby", None, None)]
    assert groups(spark, rows) == [[0], [1], [2]]


def test_long_mentions_repeats_and_empty_table(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    assert groups(spark, [("c", long, None, None), ("c", long, None, None), ("c", long + " more", None, None), ("c", "x" * 5000, None, None)]) == [[0, 1, 2], [3]]
    assert cluster_mentions(table(spark, []) if False else table(spark, [("c", "Ann Lee", None, None)]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_planted_variants_are_found(spark, seed):
    r = random.Random(seed)
    first = "Benjamin Charles Dorothea Edward Gregory Harriet Ignatius Josephine Leonard Margaret Nathaniel Ottoline Philippa Quentin Rebecca Susannah Tobias Ursula Veronica Zachary".split()
    syllable = "bra cor dun elg fro hal ix jar kel lor mar nov os pel qui rus sel tor um vos wex yar zel".split()
    rows, truth = [], []
    for e in range(40):
        name = [r.choice(first), "".join(r.sample(syllable, 3)).capitalize()]
        for _ in range(5):
            typo = list(name[1])
            i = r.randrange(1, len(typo) - 1)
            typo[i], typo[i + 1] = typo[i + 1], typo[i]
            text = r.choice([" ".join(name), ", ".join(name[::-1]), f"{name[0][0]}. {name[1]}", f"{name[0]} {''.join(typo)}", " ".join(name).upper(), "".join(name)])
            rows.append((f"c{e % 3}", text, None, None))
            truth.append(e)
    found = {tuple(x) for x in mention_pairs(cluster_mentions(table(spark, rows))).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if truth[a] == truth[b] and rows[a][1] != rows[b][1]}
    assert len(found & want) >= 0.93 * len(want) and len(found & want) >= 0.95 * len(found)
    assert monge_elkan(["a"], ["b"]) == 0
