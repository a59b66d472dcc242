"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.runtime import cut, small, spread
from .tokens import RANKS, count_tokens

#: Documents of a source are spread by hash over so many buckets; only one bucket a source is ordered row by row.
BUCKETS = 1 << 16
#: Sources that a mixture may list: their rules are broadcast.
MOST_SOURCES = 10_000


def water_fill(shares: list[float], room: list[float], total: float) -> list[float]:
    """Amounts summing to `total` in proportion to `shares`, none above its `room`; if all room is less, all of it.

    Sources whose proportional part exceeds their room are clamped to it and the excess goes to the others in
    proportion, again and again until none exceeds.
    """
    out, free, left = [0.0] * len(shares), {i for i, s in enumerate(shares) if s > 0 and room[i] > 0}, min(total, sum(r for s, r in zip(shares, room) if s > 0))
    while free:
        weight = sum(shares[i] for i in free)
        full = {i for i in free if left * shares[i] / weight >= room[i]}
        if not full:
            for i in free:
                out[i] = left * shares[i] / weight
            break
        for i in full:
            out[i] = room[i]
        left = max(0.0, left - sum(room[i] for i in full))
        free -= full
    return out


@dataclass(frozen=True)
class Mixture:
    uses: DataFrame
    shares: DataFrame


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 20240, ranks_path: str = RANKS) -> Mixture:
    """A multiset of documents in which each source of `targets` holds its share of all tokens, as far as its cap allows.

    The mixture's size is the token total of the listed sources. `water_fill` gives each source its tokens, a source
    having room for max_repeats times its own. Of a source that gets e whole and f fractional repetitions, every document is used
    e times and a seeded sample of documents holding the fraction f of its tokens once more: documents in the order of
    a seeded hash of doc_id, up to the wanted tokens, the last one taken if more than half of it fits.

    uses: doc_id, source, n_tokens, copies (rows with copies > 0). shares: per listed source its target, tokens
    available, wanted, allotted and reached, the share reached and the shortfall against the target.

    Nulls: documents without source, or of a source not listed, are left out; null and empty texts have 0 tokens and
    are used whole times only. A null target_share or max_repeats counts as 0; a source listed twice has its shares
    added and its smallest cap. Repeated rows are documents of their own; rows with equal hash are ordered by doc_id. Empty tables: no uses.

    Sizes: documents meet no window but in one hash bucket a source. The driver sees one row a listed source.
    """
    spark = documents.sparkSession
    listed = targets.where("source is not null").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    sources = small(listed.select("source"), MOST_SOURCES, "mix targets")
    chosen = spread(documents.select("doc_id", "source", "text")).join(sources, "source", "left_semi")
    sized = cut(
        count_tokens(chosen, ["doc_id", "source"], ranks_path=ranks_path)
        .withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id")))
        .withColumn("bucket", F.pmod(F.shiftrightunsigned(F.col("h"), 20), F.lit(BUCKETS)).cast("int"))
    )
    per_bucket = cut(sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents")))
    totals = listed.join(per_bucket.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents")), "source", "left").orderBy("source").collect()  # one row a listed source
    available = [t["tokens"] or 0 for t in totals]
    total = sum(available)
    allotted = water_fill([t["target_share"] for t in totals], [float(t["max_repeats"] * a) for t, a in zip(totals, available)], float(total))
    plan = []
    for t, have, get in zip(totals, available, allotted):
        whole = min(int(get // have), t["max_repeats"]) if have else 0
        rest = round(get - whole * have) if have and whole < t["max_repeats"] else 0
        plan.append((t["source"], float(t["target_share"]), int(t["max_repeats"]), int(t["documents"] or 0), int(have), float(t["target_share"]) * total, float(get), whole, int(rest)))
    planned = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, documents bigint, available_tokens bigint, wanted_tokens double, allotted_tokens double, whole int, rest bigint")

    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows a source
    starts = per_bucket.withColumn("start", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).join(planned.select("source", "rest"), "source")
    edges = starts.where("start <= rest and start + tokens > rest").groupBy("source").agg(F.min_by(F.struct("bucket", "start"), "bucket").alias("e")).select("source", F.col("e.bucket").alias("edge"), F.col("e.start").alias("edge_start"))
    rules = planned.select("source", "whole", "rest").join(edges, "source", "left")  # one row a listed source
    ruled = sized.join(F.broadcast(rules), "source")  # as many rows as `sources`, which were counted
    surely = ruled.where("edge is null or bucket <> edge").withColumn("extra", (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge"))))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = ruled.where("bucket = edge").withColumn("__before", F.col("edge_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    at_edge = at_edge.withColumn("extra", (F.col("rest") > 0) & (F.col("__before") + F.col("n_tokens") / 2 < F.col("rest"))).drop("__before")
    uses = surely.unionByName(at_edge).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("extra").cast("int")).alias("copies")).where("copies > 0")

    reached = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.sum("copies").alias("uses"), F.max("copies").alias("most_copies"))
    shares = planned.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", "documents", "available_tokens", "wanted_tokens", "allotted_tokens",
        F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
    everything = Window.partitionBy()  # one row a listed source
    shares = shares.withColumn("reached_share", F.when(F.sum("reached_tokens").over(everything) > 0, F.col("reached_tokens") / F.sum("reached_tokens").over(everything)).otherwise(F.lit(0.0)))
    shares = shares.withColumn("shortfall_tokens", F.greatest(F.lit(0.0), F.col("wanted_tokens") - F.col("reached_tokens")))
    return Mixture(uses, shares)
