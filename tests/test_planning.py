import itertools
import random

import pytest

from recallgrid.operators import bundles as B
from recallgrid.operators import planning as P

from test_history import chat


def plan(spark, spec, *budgets):
    return [tuple(r) for r in P.plan_segments(P.message_units(chat(spark, spec)), *budgets).orderBy("first_index").select("first_index", "last_index", "reason").collect()]


def brute(units, target, soft, hard):
    """The rule followed step by step."""
    out, start = [], 0
    while start < len(units):
        if units[start][0] > hard:
            out.append((start, start))
            start += 1
            continue
        found, total = [], 0
        for end in range(start, len(units)):
            total += units[end][0]
            if total > hard:
                break
            final = end == len(units) - 1
            score = units[end][1] * 10 + units[end][2] * 3 + (2 if final else 0) - (100 if total > soft else 0) - abs(total - target) / target
            found.append((final or total >= int(target * 0.7), score, -end))
        start_end = -max(found)[2]
        out.append((start, start_end))
        start = start_end + 1
    return out


def test_literal_plans(spark):
    two = [("u", 2), ("a", 2), ("u", 2), ("a", 2), ("u", 2)]
    assert plan(spark, two, 7, 9, 10)[0] == (0, 3, "pair_boundary")
    assert plan(spark, [("u", 2), ("a", 2), ("u", 2), ("a", 2, "chapter"), ("u", 2), ("a", 2)], 10, 12, 14)[0] == (0, 3, "natural_boundary")
    assert plan(spark, [("u", 99), ("a", 2)], 5, 7, 9)[0] == (0, 0, "oversized_message")


@pytest.mark.parametrize("block", [4096, 8])
def test_equal_to_the_steps(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    r = random.Random(block)
    for _ in range(3):
        spec = [(r.choice("ua"), r.choice([1, 5, 20, 60, 150]), r.choice([None, None, "scene", '["time", "location"]', "x"])) for _ in range(r.randint(1, 60))]
        weight = {None: 0, "scene": 3, '["time", "location"]': 2, "x": 0}
        units = [(t, weight[h], int(role == "a" and (i + 1 == len(spec) or spec[i + 1][0] == "u"))) for i, (role, t, h) in enumerate(spec)]
        got = [p[:2] for p in plan(spark, spec, 60, 90, 120)]
        assert got == brute(units, 60, 90, 120)


def test_pareto_finds_the_optimum(spark):
    spec = [(x, t) for t in (300, 150, 700, 90, 420) for x in "ua"]
    m = chat(spark, spec)
    c = P.adaptive_candidates(P.bundle_units(B.turn_bundles(m), m), hard_max=1500, input_budget=1500)
    by = {(r["unit_start"], r["unit_end"]): r for r in c.collect() if r["safe"]}
    best = []
    for cuts in itertools.product([0, 1], repeat=4):
        ends = [i for i, x in enumerate(cuts) if x] + [4]
        runs = list(zip([0, *(e + 1 for e in ends[:-1])], ends))
        if all(run in by for run in runs):
            best.append((sum(by[run]["total_tokens"] for run in runs), sum(by[run]["wall_ms"] for run in runs)))
    plans = {r["objective"]: r for r in P.adaptive_plans(c).collect()}
    assert set(plans) == {"economic", "fast", "safe", "balanced"}
    assert abs(plans["economic"]["total_tokens"] - min(b[0] for b in best)) < 1e-6
    assert abs(plans["fast"]["wall_ms"] - min(b[1] for b in best)) < 1e-6
    assert plans["safe"]["max_input"] <= plans["economic"]["max_input"] and plans["safe"]["total_tokens"] <= 1.2 * plans["economic"]["total_tokens"]


@pytest.mark.parametrize("tied", [True, False])
def test_frontier_equals_all_pairs(tied):
    r = random.Random(3)
    for _ in range(200):
        paths = []
        for _ in range(r.randint(0, 40)):
            n = r.randint(1, 6)
            paths.append((float(r.randint(1, 9)), n * 2.0, r.randint(1, 6), n * 1.5 if tied else float(r.randint(1, 6)), 0, 0.0, 0.0, n))
        beats = lambda q, p: all(a <= b for a, b in zip(q[:4], p[:4])) and q[:4] != p[:4]
        assert P._frontier(paths, 999) == [p for p in sorted(paths) if not any(beats(q, p) for q in paths)]


def test_empty_history(spark):
    empty = chat(spark, [("u", 1)]).limit(0)
    assert P.plan_segments(P.message_units(empty), 5, 7, 9).count() == 0
    assert P.adaptive_plans(P.adaptive_candidates(P.message_units(empty), 9)).count() == 0
