"""Segment planners: greedy by score, and adaptive by projected cost."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import half_up
from ..functions.runtime import cut, running

#: Weights of the natural boundaries.
BOUNDARY_WEIGHTS = {"chapter": 4, "scene": 3, "time": 2, "location": 1}
#: Units of a chat that one task walks at a time.
BLOCK = 4096


def boundary_weight(hint: Column) -> Column:
    """The weight of a boundary hint, a word or a JSON list of words; the heaviest of a list, 0 for what is none."""
    words = F.when(hint.startswith("["), F.from_json(hint, "array<string>")).otherwise(F.array(hint))
    weights = F.transform(words, lambda w: F.coalesce(*(F.when(w == k, v) for k, v in BOUNDARY_WEIGHTS.items()), F.lit(0)))
    return F.coalesce(F.array_max(F.concat(weights, F.array(F.lit(0)))), F.lit(0))


def message_units(messages: DataFrame) -> DataFrame:
    """Messages as planning units: chat_id, pos (from 0 without gaps), first_index, last_index, n_tokens, natural, pair."""
    one = messages.select("chat_id", "message_index", "role", "n_tokens", "boundary_hint").withColumn("__one", F.lit(1))
    numbered = running(one, ["chat_id"], "message_index", [("sum", "__one", "pos")])
    following = numbered.select("chat_id", (F.col("pos") - 1).alias("pos"), F.col("role").alias("__next"))
    pair = (F.col("role") == "assistant") & (F.col("__next").isNull() | (F.col("__next") == "user"))
    return numbered.join(following, ["chat_id", "pos"], "left").select("chat_id", "pos", F.col("message_index").alias("first_index"), F.col("message_index").alias("last_index"), "n_tokens", boundary_weight(F.col("boundary_hint")).alias("natural"), pair.cast("int").alias("pair"))


def bundle_units(bundled: DataFrame, messages: DataFrame) -> DataFrame:
    """Turn bundles as planning units; the hint is that of a bundle's last message, and every bundle ends a pair."""
    hints = messages.select("chat_id", F.col("message_index").alias("last_index"), boundary_weight(F.col("boundary_hint")).alias("natural"))
    return bundled.join(hints, ["chat_id", "last_index"]).select("chat_id", F.col("bundle_no").alias("pos"), "first_index", "last_index", "n_tokens", "natural", F.lit(1).alias("pair"))


def next_choices(units: DataFrame, target: int, soft: int, hard: int) -> DataFrame:
    """For every unit as a start, the end the greedy rule picks: chat_id, pos, end_pos, first_index, last_index, n_tokens, natural, pair, is_final, oversized.

    Candidates are the ends whose sum is within `hard`; of those that are final or reach 0.7 of the target (of all, if none does) the best score wins, the smaller
    end on a tie. Starts meet ends by blocks of `hard` tokens, an equi-join, so a chat's length doesn't matter.
    """
    summed = running(units, ["chat_id"], "pos", [("sum", "n_tokens", "before")])
    finals = units.groupBy("chat_id").agg(F.max("pos").alias("final_pos"))
    u = cut(summed.join(finals, "chat_id"))
    starts = u.where(F.col("n_tokens") <= hard).select("chat_id", F.col("pos").alias("s"), F.col("before").alias("s_before"), F.col("first_index").alias("s_first"), F.explode(F.array(F.floor(F.col("before") / hard), F.floor(F.col("before") / hard) + 1)).alias("block"))
    ends = u.withColumn("block", F.floor(F.col("before") / hard))
    pairs = starts.join(ends, ["chat_id", "block"]).where("pos >= s").withColumn("total", F.col("before") + F.col("n_tokens") - F.col("s_before")).where(F.col("total") <= hard)
    is_final = F.col("pos") == F.col("final_pos")
    useful = is_final | (F.col("total") >= int(target * 0.7))
    penalty = F.when(F.col("total") > soft, 100).otherwise(0)
    score = F.col("natural") * 10 + F.col("pair") * 3 + F.when(is_final, 2).otherwise(0) - penalty - F.abs(F.col("total") - target) / F.lit(float(target))
    best = F.max(F.struct(useful.cast("int").alias("useful"), score.alias("score"), (-F.col("pos")).alias("minus_end"), F.col("last_index"), F.col("total"), F.col("natural"), F.col("pair"), is_final.alias("is_final"))).alias("b")
    chosen = pairs.groupBy("chat_id", "s", "s_first").agg(best).select("chat_id", F.col("s").alias("pos"), (-F.col("b.minus_end")).alias("end_pos"), F.col("s_first").alias("first_index"), "b.last_index", F.col("b.total").alias("n_tokens"), "b.natural", "b.pair", "b.is_final", F.lit(False).alias("oversized"))
    single = u.where(F.col("n_tokens") > hard).select("chat_id", "pos", F.col("pos").alias("end_pos"), "first_index", "last_index", "n_tokens", "natural", "pair", F.lit(False).alias("is_final"), F.lit(True).alias("oversized"))
    return chosen.unionByName(single)


def _exits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos", ascending=False)
    end, out = (int(key[1]) + 1) * BLOCK, {}
    for pos, after in zip(rows["pos"].tolist(), rows["after"].tolist()):
        out[pos] = out.get(after, after) if after < end else after
    return pd.DataFrame({"chat_id": key[0], "pos": list(out), "exit": list(out.values())})


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    hops = dict(zip(rows["pos"].tolist(), rows["after"].tolist()))
    at, end, out = int(rows["entry"].iloc[0]), (int(key[1]) + 1) * BLOCK, []
    while at in hops and at < end:
        out.append(at)
        at = hops[at]
    return pd.DataFrame({"chat_id": key[0], "pos": out})


def walk(choices: DataFrame) -> DataFrame:
    """The choices a walk from position 0 makes, each next start being behind the last end.

    In blocks of `BLOCK` positions: for every position of a block where a walk would leave it; then, from block to block, where the walk from 0 enters
    (by doubling, so a chat of n blocks takes log n rounds); then each entered block walked on its own.
    """
    hops = cut(choices.select("chat_id", "pos", (F.col("end_pos") + 1).alias("after"), F.floor(F.col("pos") / BLOCK).alias("block")))
    kind = dict(hops.dtypes)["chat_id"]
    exits = hops.groupBy("chat_id", "block").applyInPandas(_exits, f"chat_id {kind}, pos bigint, exit bigint")
    entries = hops.where("pos = 0").select("chat_id", "pos")
    if not hops.where("block > 0").isEmpty():
        jump = cut(exits.select("chat_id", "pos", F.col("exit").alias("to")))
        known = cut(entries)
        while True:
            reached = known.join(jump, ["chat_id", "pos"]).select("chat_id", F.col("to").alias("pos"))
            reached = reached.join(hops.select("chat_id", "pos"), ["chat_id", "pos"], "left_semi")
            fresh = cut(reached.join(known, ["chat_id", "pos"], "left_anti").distinct())
            if fresh.isEmpty():
                break
            known = cut(known.unionByName(fresh))
            jump = cut(jump.alias("a").join(jump.alias("b"), (F.col("a.chat_id") == F.col("b.chat_id")) & (F.col("a.to") == F.col("b.pos")), "left").select("a.chat_id", "a.pos", F.coalesce("b.to", "a.to").alias("to")))
        entries = known
    by_block = entries.select("chat_id", F.floor(F.col("pos") / BLOCK).alias("block"), F.col("pos").alias("entry"))
    walked = hops.join(by_block, ["chat_id", "block"]).groupBy("chat_id", "block").applyInPandas(_walk, f"chat_id {kind}, pos bigint")
    return choices.join(walked, ["chat_id", "pos"], "left_semi")


def plan_segments(units: DataFrame, target: int, soft: int, hard: int, atomic_turns: bool = False) -> DataFrame:
    """The greedy plan: chat_id, first_index, last_index, n_tokens, reason, oversized.

    A unit above `hard` is a segment of its own. Reasons: history_end, natural_boundary, pair_boundary (messages only), hard_limit, target_proximity or turn_batch.
    """
    p = walk(cut(next_choices(units, target, soft, hard)))
    hard_limit = F.col("n_tokens") > soft
    reason = F.when(F.col("oversized"), "oversized_turn" if atomic_turns else "oversized_message").when(F.col("is_final"), "history_end").when(F.col("natural") > 0, "natural_boundary")
    reason = reason.when(hard_limit, "hard_limit").otherwise("turn_batch") if atomic_turns else reason.when(F.col("pair") == 1, "pair_boundary").when(hard_limit, "hard_limit").otherwise("target_proximity")
    return p.select("chat_id", "first_index", "last_index", "n_tokens", reason.alias("reason"), "oversized")


def adaptive_candidates(units: DataFrame, hard_max: int, max_bundles: int = 5, input_budget: int = 8000, safety_ratio: float = 0.8, retry: float = 0.2, latency_ms: int = 2000, cooldown_ms: int = 3000) -> DataFrame:
    """Every run of up to `max_bundles` units with its projected cost: chat_id, unit_start, unit_end, first_index, last_index, source_tokens, input_tokens, output_tokens, attempts, total_tokens, wall_ms, safe, oversized, boundary.

    A run of several units stops before `hard_max`. Projections: input = source, output = at least 600, else 0.45 of the input; attempts = 1 + p + p².
    """
    summed = running(units, ["chat_id"], "pos", [("sum", "n_tokens", "before")])
    starts = summed.select("chat_id", F.col("pos").alias("unit_start"), "first_index", F.col("before").alias("s_before"), F.col("n_tokens").alias("first_tokens"), F.explode(F.sequence(F.col("pos"), F.col("pos") + max_bundles - 1)).alias("pos"))
    ends = summed.select("chat_id", "pos", "last_index", "before", "n_tokens", F.col("natural").alias("boundary"))
    runs = starts.join(ends, ["chat_id", "pos"]).withColumn("source_tokens", F.col("before") + F.col("n_tokens") - F.col("s_before"))
    runs = runs.where((F.col("pos") == F.col("unit_start")) | (F.col("source_tokens") <= hard_max))
    ceiling = max(1, int(input_budget * safety_ratio))
    over = (F.col("first_tokens") > hard_max) | ((F.col("pos") == F.col("unit_start")) & (F.col("source_tokens") > ceiling))
    attempts = 1 + retry + retry * retry
    out = F.greatest(F.lit(600).cast("bigint"), half_up(F.col("source_tokens") * F.lit(0.45)))
    return runs.select(
        "chat_id", "unit_start", F.col("pos").alias("unit_end"), "first_index", "last_index", "source_tokens", F.col("source_tokens").alias("input_tokens"), out.alias("output_tokens"), F.lit(attempts).alias("attempts"),
        ((F.col("source_tokens") + out) * F.lit(attempts)).alias("total_tokens"), F.lit(attempts * (latency_ms + cooldown_ms)).alias("wall_ms"), (over | (F.col("source_tokens") <= ceiling)).alias("safe"), over.alias("oversized"), "boundary",
    )


OBJECTIVES = ("economic", "fast", "safe", "balanced")
#: Places in a path: total tokens, wall time, largest input, requests, boundary score, sum and sum of squares of inputs, segments.
TOTAL, WALL, MOST, REQUESTS, BOUNDARY, SUM, SUM2, N = range(8)
START = (0.0, 0.0, 0, 0.0, 0, 0.0, 0.0, 0)


def _frontier(paths: list[tuple], limit: int) -> list[tuple]:
    """The first `limit` paths, by total and wall time, that no other is at least as good as in total, wall time, largest input and requests and better in one.

    Taken by rising total, a path is beaten if one taken before has no more wall time and no larger input. Those are kept as stairs (wall time rising, largest input falling), so one search
    decides; where requests don't rise with wall time, all taken are compared.
    """
    ordered = sorted(paths)
    by_wall = sorted({(p[WALL], p[REQUESTS]) for p in ordered})
    stairs_do = all(x[1] <= y[1] and x[0] < y[0] for x, y in zip(by_wall, by_wall[1:]))
    kept: list[tuple] = []
    walls: list[float] = []
    steps: list[tuple] = []
    for p in ordered:
        if stairs_do:
            at = bisect_right(walls, p[WALL]) - 1
            best = steps[at] if at >= 0 else None
            if best and best[MOST] <= p[MOST] and best[:4] != p[:4]:
                continue
            if not best or p[MOST] < best[MOST]:
                if best and walls[at] == p[WALL]:
                    steps[at] = p
                else:
                    at += 1
                    walls.insert(at, p[WALL])
                    steps.insert(at, p)
                while at + 1 < len(steps) and steps[at + 1][MOST] >= p[MOST]:
                    del walls[at + 1], steps[at + 1]
        elif any(q[WALL] <= p[WALL] and q[MOST] <= p[MOST] and q[REQUESTS] <= p[REQUESTS] and q[:4] != p[:4] for q in kept):
            continue
        kept.append(p)
        if len(kept) == limit:
            break
    return kept


def _pareto(limit: int, near: float, safe_over: float):
    def variance(p: tuple) -> float:
        return 0.0 if p[N] < 2 else max(0.0, p[SUM2] / p[N] - (p[SUM] / p[N]) ** 2)

    def order(p: tuple, metric: int) -> tuple:
        return (round(p[metric], 6), round(p[TOTAL], 6), round(p[REQUESTS], 6), -p[BOUNDARY], p[MOST], round(variance(p), 6), p[N])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["safe"]]
        columns = ("unit_start", "unit_end", "input_tokens", "attempts", "total_tokens", "wall_ms", "boundary")
        by_start: dict[int, list[tuple]] = {}
        for r in zip(*(rows[c].tolist() for c in columns)):
            by_start.setdefault(r[0], []).append(r)
        n = (max(r[1] for rs in by_start.values() for r in rs) + 1) if by_start else 0
        states: list[list[tuple]] = [[] for _ in range(n + 1)]
        states[0] = [START] if n else []
        for at in range(n):
            here, states[at] = _frontier(states[at], limit), []
            for _, end, tokens, attempts, total, wall, boundary in by_start.get(at, ()):
                square = tokens * tokens
                states[end + 1] += [(p[0] + total, p[1] + wall, p[2] if p[2] > tokens else tokens, p[3] + attempts, p[4] + boundary, p[5] + tokens, p[6] + square, p[7] + 1) for p in here]
        paths = _frontier(states[n], limit) if n else []
        if not paths:
            return pd.DataFrame(columns=["chat_id", "objective", "n_segments", "total_tokens", "wall_ms", "max_input"])
        best = lambda some, metric: min(some, key=lambda p: order(p, metric))
        economic = best(paths, TOTAL)
        cheap = [p for p in paths if p[TOTAL] <= economic[TOTAL] * near]
        within = [p for p in paths if p[TOTAL] <= economic[TOTAL] * safe_over]
        chosen = (economic, best(paths, WALL), best(within, MOST), best(cheap or paths, WALL))
        return pd.DataFrame({"chat_id": key[0], "objective": OBJECTIVES, "n_segments": [p[N] for p in chosen], "total_tokens": [p[TOTAL] for p in chosen], "wall_ms": [p[WALL] for p in chosen], "max_input": [p[MOST] for p in chosen]})

    return run


def adaptive_plans(candidates: DataFrame, frontier_limit: int = 256, near_optimal: float = 1.05, safe_overhead: float = 1.2) -> DataFrame:
    """The four plans of every chat by a Pareto search over bundle boundaries: chat_id, objective, n_segments, total_tokens, wall_ms, max_input.

    Sequential in a chat's bundles: a grouped map that receives six numbers for each run, no texts. Chats without a safe plan have no row.
    """
    kind = dict(candidates.dtypes)["chat_id"]
    slim = candidates.select("chat_id", "unit_start", "unit_end", "input_tokens", "attempts", "total_tokens", "wall_ms", "boundary", "safe")
    return slim.groupBy("chat_id").applyInPandas(_pareto(frontier_limit, near_optimal, safe_overhead), f"chat_id {kind}, objective string, n_segments bigint, total_tokens double, wall_ms double, max_input bigint")


def request_budgets(items: DataFrame, total: int, essential: int, input_budget: int) -> DataFrame:
    """Input budget of each planned request: what is left of `total` after the requests before it, less the essentials of those behind it, at least its own essential and at most `input_budget`."""
    order = Window.partitionBy("chat_id").orderBy("first_index")
    own = F.least(F.col("n_tokens"), F.lit(essential).cast("bigint"))
    behind = F.coalesce(F.sum(own).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.lit(total) - before - behind
    return items.select("chat_id", "first_index", F.least(F.lit(input_budget).cast("bigint"), F.greatest(own, room)).alias("budget"))


def calibration(attempts: DataFrame) -> DataFrame:
    """Per session: n, n_format_failures, retry_probability, output_ratio, median_latency_ms, confidence, from live attempts that the provider answered.

    attempts: session, source_tokens, output_tokens, duration_ms, mode, failure (null, `format` or `provider_...`).
    """
    live = attempts.where("mode = 'live'").dropDuplicates(["session", "attempt_id"]).where("failure is null or not startswith(failure, 'provider')")
    ratio = F.percentile(F.when((F.col("source_tokens") > 0) & F.col("output_tokens").isNotNull(), F.col("output_tokens") / F.col("source_tokens")), 0.5)
    failures = F.sum(F.coalesce(F.col("failure") == "format", F.lit(False)).cast("bigint"))
    n, timed = F.count("*"), F.count("duration_ms")
    clamp = lambda x, a, b: F.least(F.greatest(x, F.lit(a)), F.lit(b))
    return live.groupBy("session").agg(
        n.alias("n"), failures.alias("n_format_failures"), clamp((failures + 1) / (n + 5), 0.05, 0.75).alias("retry_probability"), clamp(F.coalesce(ratio, F.lit(0.45)), 0.05, 1.0).alias("output_ratio"),
        F.percentile("duration_ms", 0.5).alias("median_latency_ms"), F.when((n >= 5) & (timed >= 3), "high").when(n >= 5, "medium").otherwise("low").alias("confidence"),
    )


def usage_projection(plan: DataFrame) -> DataFrame:
    """Per chat: n_requests, minimum, maximum and likely tokens of running a plan (likely = minimum + 0.75 of the way to the maximum)."""
    low = F.sum(F.col("n_tokens") + F.greatest(F.lit(600).cast("bigint"), half_up(F.col("n_tokens") * F.lit(0.45))))
    rows = plan.groupBy("chat_id").agg(F.count("*").alias("n_requests"), low.cast("bigint").alias("min_tokens"))
    rows = rows.withColumn("max_tokens", F.col("min_tokens") * 3)
    return rows.withColumn("likely_tokens", (F.col("min_tokens") + half_up(F.lit(0.75) * (F.col("max_tokens") - F.col("min_tokens")))).cast("bigint"))
