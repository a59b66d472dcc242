import random

import pytest
from pyspark.sql import functions as F

from recallgrid.functions.runtime import running, running_sum
from recallgrid.operators import bundles as B

MESSAGE = "chat_id string, message_index int, role string, n_tokens bigint, text string, name string, hidden boolean, swipe_id int, boundary_hint string"


def chat(spark, spec, chat_id="c"):
    """spec: (role letter, tokens) or (role letter, tokens, hint) for each message."""
    role = {"u": "user", "a": "assistant", "s": "system"}
    return spark.createDataFrame([(chat_id, i, role[m[0]], m[1], "t", "n", False, 0, m[2] if len(m) > 2 else None) for i, m in enumerate(spec)], MESSAGE)


def walk(roles):
    """Bundles found by walking a chat once."""
    out, start, user, answered = [], 0, False, False
    for i, r in enumerate(roles):
        if i > start and r == "u" and user and answered:
            out.append((start, i - 1))
            start, user, answered = i, False, False
        user = user or r == "u"
        answered = answered or (r == "a" and user)
    return [*out, (start, len(roles) - 1)]


@pytest.mark.parametrize("seed", range(3))
def test_bundles_equal_the_walk(spark, seed):
    r = random.Random(seed)
    chats = {f"c{k}": [r.choice("uuaas") for _ in range(r.randint(1, 40))] for k in range(25)}
    df = None
    for k, roles in chats.items():
        part = chat(spark, [(x, 1) for x in roles], k)
        df = part if df is None else df.unionByName(part)
    got = {}
    for row in B.turn_bundles(df).orderBy("chat_id", "bundle_no").collect():
        got.setdefault(row["chat_id"], []).append((row["first_index"], row["last_index"]))
    assert got == {k: walk(roles) for k, roles in chats.items()}


def test_bundle_kinds(spark, as_rows):
    assert [r[0] for r in as_rows(B.turn_bundles(chat(spark, [("a", 1), ("s", 1)])), "kind")] == ["opening"]
    assert as_rows(B.turn_bundles(chat(spark, [("a", 1), ("u", 1), ("a", 1), ("u", 1)])), "kind", "complete") == [("exchange", True), ("incomplete_user", False)]


@pytest.mark.parametrize("spec,budget,indices,overflow", [
    ([("u", 3), ("a", 3), ("u", 4), ("a", 4)], 11, [1, 2, 3], 0), ([("a", 2), ("u", 9), ("a", 8)], 10, [1, 2], 7), ([("u", 4), ("a", 4), ("u", 6)], 10, [1, 2], 0), ([("u", 4), ("a", 4), ("u", 6)], 9, [2], 0),
])
def test_raw_foreground(spark, spec, budget, indices, overflow):
    fg = B.raw_foreground(chat(spark, spec), budget)
    assert sorted(r["message_index"] for r in fg.collect()) == indices
    s = B.foreground_summary(fg, budget).first()
    assert s["overflow_tokens"] == overflow and (s["reason"] == "within_budget") == (overflow == 0)


def test_frontier_and_coverage(spark, as_rows):
    m = chat(spark, [("u", 3), ("a", 3), ("u", 4), ("a", 4)])
    f = B.compaction_frontier(m, B.foreground_summary(B.raw_foreground(m, 11), 11), 11).first()
    assert (f["eligible_through"], f["eligible_messages"], f["eligible_tokens"], f["should_schedule"]) == (0, 1, 3, True)
    seg = spark.createDataFrame([("c", 0, 1), ("c", 1, 1), ("c", 3, 5), ("c", 9, 8), (None, 0, 3)], "chat_id string, first_index int, last_index int")
    assert as_rows(B.segment_coverage(seg, m)) == [("c", 1, 1, 2, False)]
    assert as_rows(B.uncovered_islands(m, seg), "first_index", "last_index") == [(2, 2)]


def test_running_equals_one_window(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), i, r.randint(-5, 9)) for i in r.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(x["k"], x["o"]): (x["s"], x["m"]) for x in running(df, ["k"], "o", [("sum", "v", "s"), ("max", "v", "m")], block=7).collect()}
    for k, o, _ in rows:
        before = [v for k2, o2, v in rows if k2 == k and o2 < o]
        assert got[k, o] == (sum(before), max(before, default=None))
    assert running_sum(df.limit(0), ["k"], "o", "v", "s").count() == 0


def test_latest_messages(spark, as_rows):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, "c", 0, None, None, None, None, None, None, None, t), (2, "c", 0, "user", "n", "new", False, 1, None, None, t + dt.timedelta(1)), (3, None, 0, "user", "n", "x", False, 1, None, None, t), (4, "c", 1, "system", "n", "x" * 9, None, 1, None, None, None)]
    df = spark.createDataFrame(rows, "message_id bigint, chat_id string, message_index int, role string, name string, text string, hidden boolean, swipe_id int, boundary_hint string, send_date timestamp_ntz, ingested_at timestamp_ntz")
    got = B.latest_messages(df)
    assert as_rows(got, "message_index", "text", "hidden", "n_tokens") == [(0, "new", False, 1), (1, "x" * 9, True, 3)]
    assert B.policy_filter(got).count() == 1 and B.policy_filter(got, include_hidden=True, include_system=True).count() == 2


def test_cosmetic_changes(spark, as_rows):
    old = chat(spark, [("u", 1), ("a", 1), ("u", 1)])
    spaced = old.withColumn("text", F.concat(F.lit("\r\n"), "text", F.lit("  ")))
    other = old.withColumn("text", F.when(F.col("message_index") == 2, "x").otherwise(F.col("text")))
    h = B.bundle_hashes
    assert as_rows(B.bundle_integrity(h(old), h(old))) == [("c", 0, 0, False)]
    assert as_rows(B.bundle_integrity(h(old), h(spaced))) == [("c", 2, 0, True)]
    assert as_rows(B.bundle_integrity(h(old), h(other))) == [("c", 1, 1, False)]
