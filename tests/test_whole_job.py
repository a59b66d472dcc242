"""Planted cases and brute force where a query once did less than the whole job."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recallgrid.functions.greedy import fold_with_skip
from recallgrid.operators import entities as E

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


def propose_by_brute_force(mentions, registry):
    """As in the reference: every entity of the chat is scored."""
    out = {}
    for mention, chat, name, sender in mentions:
        words = set(name.split())
        scores = []
        for entity in sorted({r[1] for r in registry if r[0] == chat}):
            forms = [r for r in registry if r[:2] == (chat, entity)]
            shared = max(1.0 if f[2] == name else 0.7 * len(words & set(f[2].split())) / max(len(words), len(set(f[2].split()))) for f in forms)
            scores.append((-round(shared + 0.2 + (0.5 if sender and forms[0][3] == sender else 0), 9), entity, any(f[2] == name for f in forms)))
        scores.sort()
        best = scores[0] if scores else None
        ambiguous = len(scores) > 1 and scores[1][0] - scores[0][0] < 0.15
        proposed = best[1] if best and not ambiguous and best[0] <= -0.5 else None
        confidence = "new" if not best else "high" if best[2] and not ambiguous else "uncertain"
        out[mention] = (proposed, confidence, best and -best[0], not best or not best[2] or ambiguous)
    return out


def test_proposals_over_all_entities_of_a_chat(spark):
    rng = random.Random(5)
    words, senders = ["ann", "bo", "cy", "dee", "ed", "flo", "gus"], ["p", "q", "r", None]
    registry = []
    for chat in ("c", "d"):
        for k in range(6 if chat == "c" else 2):
            sender = rng.choice(senders)
            registry += [(chat, f"e{k}", " ".join(rng.sample(words, rng.randint(1, 3))), sender) for _ in range(rng.randint(1, 2))]
    mentions = [(i, rng.choice(["c", "d", "z"]), " ".join(rng.sample([*words, "zoe", "yul"], rng.randint(1, 3))), rng.choice([*senders, "s"])) for i in range(200)]
    mentions += [(200, "one", "xan", "p"), (201, "two", "xan", "p")]
    registry += [("one", "e1", "ann", "p"), ("two", "e1", "ann", "p"), ("two", "e2", "bo", "p")]
    got = E.propose(
        spark.createDataFrame(mentions, "mention_id bigint, chat_id string, name string, sender_id string"),
        spark.createDataFrame(registry, "chat_id string, entity_id string, alias string, sender_id string"),
    ).collect()
    assert {r["mention_id"]: (r["proposed_entity_id"], r["confidence"], r["best_score"], r["requires_confirmation"]) for r in got} == (want := propose_by_brute_force(mentions, registry))
    assert want[200] == ("e1", "uncertain", 0.7, True) and want[201] == (None, "uncertain", 0.7, True)


def test_a_list_folded_in_blocks_is_folded_as_a_whole(spark, as_rows):
    rng = random.Random(6)
    items = [(chat, i, rng.randint(0, 9)) for chat, n in (("a", 17), ("b", 3), ("c", 6)) for i in range(n)]
    want = []
    for chat in "abc":
        total = 0
        for _, place, n in (x for x in items if x[0] == chat):
            want.append((chat, place, fits := total + n <= 20))
            total += n if fits else 0
    df = spark.createDataFrame(items, "chat_id string, place int, n bigint")
    starts = df.select("chat_id").distinct().withColumn("state", F.lit(0).cast("bigint"))
    for block in (1, 4, 100):
        got = fold_with_skip(df, starts, "chat_id", lambda s, i: (s + i["n"] <= 20, s + i["n"]), block=block)
        assert as_rows(got, "chat_id", "place", "kept") == sorted(want, key=str)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_state_projection_holds_all_items(spark):
    q = entry.queries()
    got = q["state_projection"](spark, DATA).groupBy("kind").count().collect()
    n = {r["kind"]: r["count"] for r in got}
    assert n["relationship"] == q["relationships"](spark, DATA).select("chat_id", "pair").distinct().count()
    assert n["world_fact"] == q["world_facts"](spark, DATA).count()
    assert n["thread"] == q["threads"](spark, DATA).where("status not in ('resolved', 'abandoned')").count()
    assert n["character"] > 0
    per_chat = {r["chat_id"]: r["count"] for r in q["salient_negatives"](spark, DATA).groupBy("chat_id").count().collect()}
    assert n.get("salient_negative", 0) == sum(min(6, k) for k in per_chat.values()) > 0


def test_extraction_history_takes_all_segments(spark, as_rows, tmp_path):
    rows = [(i, f"s{i:02}", "c", i, i, "valid", "x" * 40 if i >= 10 else "") for i in range(50)]
    spark.createDataFrame(rows, "segment_row_id bigint, segment_id string, chat_id string, first_index int, last_index int, status string, synopsis string").withColumn("updated_at", F.lit(None).cast("timestamp")).write.parquet(f"{tmp_path}/segments.parquet")
    got = dict(as_rows(entry.queries()["extraction_history"](spark, str(tmp_path)), "item", "kept"))
    assert got == {f"s{i:02}": i >= 20 or i < 10 for i in range(50)}


def test_loosely_spelt_removals_remove(spark, as_rows, tmp_path):
    ops = ["set", "remove", " REMOVE ", "Delete", "drop", None]
    rows = [("c", "s", f"p{i}", i, op, "v") for i, op in enumerate(ops)]
    spark.createDataFrame(rows, "chat_id string, subject string, path string, change_id bigint, operation string, value string").write.parquet(f"{tmp_path}/state_changes.parquet")
    spark.createDataFrame([("state_operation", "remove", 0, ["delete", "drop"])], "field_name string, canonical string, list_position int, known_spellings array<string>").write.parquet(f"{tmp_path}/canonical_values.parquet")
    assert as_rows(entry.queries()["kv_last_writes"](spark, str(tmp_path)), "path", "value") == [("p0", "v"), ("p5", "v")]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_plans_hold_every_uncovered_message(spark):
    q = entry.queries()
    planned = q["combined_plans"](spark, DATA).agg(F.sum("planned_tokens")).first()[0]
    assert planned == q["uncovered_islands"](spark, DATA).where("chat_id is not null").agg(F.sum("n_tokens")).first()[0]
    assert q["promoted"](spark, DATA).where("origin = 'promoted' and last_index % 2 = 1").count() > 0
