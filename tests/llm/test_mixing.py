import random

import pytest

from recallgrid.llm.mixing import mix_sources, water_fill

DOCS, TARGETS = "doc_id bigint, text string, source string, copies int", "source string, target_share double, max_repeats int, n_tokens int"


def test_water_fill_clamps_and_redistributes():
    assert water_fill([0.5, 0.5], [100, 100], 100) == [50, 50]
    assert water_fill([0.5, 0.25, 0.25], [10, 100, 100], 100) == [10, 45, 45]
    assert water_fill([0.8, 0.2], [10, 10], 100) == [10, 10]
    assert water_fill([0.5, 0.5], [0, 100], 100) == [0, 100]
    assert water_fill([], [], 0) == []


@pytest.mark.parametrize("seed", range(3))
def test_water_fill_is_feasible_and_proportional(seed):
    r = random.Random(seed)
    for _ in range(200):
        n = r.randint(1, 8)
        shares, room, total = [r.random() for _ in range(n)], [r.choice([0, r.random() * 50]) for _ in range(n)], r.random() * 100
        out = water_fill(shares, room, total)
        assert all(-1e-9 <= o <= c + 1e-9 for o, c in zip(out, room))
        assert abs(sum(out) - min(total, sum(room))) < 1e-6
        free = [o / s for o, s, c in zip(out, shares, room) if o < c - 1e-9]
        assert not free or max(free) - min(free) < 1e-6


def mixture(spark, docs, targets):
    m = mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS))
    return {r["doc_id"]: r for r in m.uses.collect()}, {r["source"]: r for r in m.shares.collect()}


def test_shares_are_reached(spark):
    r = random.Random(3)
    docs = [(i, "word " * r.randint(1, 30), r.choice(["a", "a", "a", "b", "c", "x", None]), 1) for i in range(3000)] + [(5000, None, "a", 1), (5001, "", "b", 1)]
    uses, shares = mixture(spark, docs, [("a", 0.3, 1, 1), ("b", 0.3, 4, 1), ("c", 0.4, 2, 1)])
    total = sum(s["available_tokens"] for s in shares.values())
    assert set(uses) <= {d[0] for d in docs if d[2] in ("a", "b", "c")}
    for name, s in shares.items():
        own = [u for u in uses.values() if u["source"] == name]
        assert s["reached_tokens"] == sum(u["n_tokens"] * u["copies"] for u in own)
        assert max(u["copies"] for u in own) <= s["max_repeats"]
        assert abs(s["reached_tokens"] - s["allotted_tokens"]) <= 31
    assert shares["c"]["shortfall_tokens"] > 0  # its cap binds
    assert abs(sum(s["reached_tokens"] for s in shares.values()) - total) < 100
    again, _ = mixture(spark, docs, [("a", 0.3, 1, 1), ("b", 0.3, 4, 1), ("c", 0.4, 2, 1)])
    assert {k: u["copies"] for k, u in again.items()} == {k: u["copies"] for k, u in uses.items()}


def test_odd_targets_and_empty_tables(spark):
    docs = [(1, "one two", "a", 1), (1, "one two", "a", 1), (2, "three", "b", 1)]
    uses, shares = mixture(spark, docs, [("a", None, 3, 1), ("b", 0.5, None, 1), (None, 0.5, 1, 1), ("gone", 0.5, 2, 1)])
    assert not uses and shares["gone"]["available_tokens"] == 0
    uses, shares = mixture(spark, [], [("a", 1.0, 1, 1)])
    assert not uses and shares["a"]["reached_tokens"] == 0
    assert mixture(spark, docs, []) == ({}, {})
