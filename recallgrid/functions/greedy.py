"""Greedy choice over a conflict graph, in rounds instead of one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut


def greedy_independent(nodes: DataFrame, conflicts: DataFrame, keys: list[str], node: str, rank: str) -> DataFrame:
    """The nodes that a walk down the ranks takes, leaving out those in conflict with one taken before.

    nodes: keys, node, rank (any orderable, distinct within the keys; the largest goes first). conflicts: keys, a, b in both directions.
    Each round takes every node that outranks all its open neighbours and drops theirs: the same set as the walk, in about as many rounds as the
    longest falling chain of ranks, each two joins, whatever the number of nodes.
    """
    free = cut(nodes.select(*keys, node, rank))
    taken = None
    while True:
        near = conflicts.join(free.select(*keys, F.col(node).alias("b"), F.col(rank).alias("__rb")), [*keys, "b"]).groupBy(*keys, F.col("a").alias(node)).agg(F.max("__rb").alias("__best"))
        made = cut(free.join(near, [*keys, node], "left").where(F.col("__best").isNull() | (F.col(rank) > F.col("__best"))).select(*keys, node))
        taken = made if taken is None else taken.unionByName(made)
        gone = made.join(conflicts.select(*keys, F.col("a").alias(node), "b"), [*keys, node]).select(*keys, F.col("b").alias(node)).distinct()
        free = cut(free.join(made, [*keys, node], "left_anti").join(gone, [*keys, node], "left_anti"))
        if free.isEmpty():
            return taken


def fold_with_skip(items: DataFrame, starts: DataFrame, key: str, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 1 << 12) -> DataFrame:
    """items with `kept`: a walk over each key's items in the order of their `place`, of any number.

    starts: key, state, one row per key. step(state, item): whether the item is kept, and the state after keeping it. A list is folded in blocks of `block` items,
    one a round, and the state carried from block to block, so that no row holds more than a block and short lists are done after the first round.
    """
    fields = [c for c in items.columns if c != key]
    number = F.row_number().over(Window.partitionBy(key).orderBy(*("place", *(c for c in fields if c != "place"))))
    placed = items.withColumn("__i", number).withColumn("__b", F.floor((F.col("__i") - 1) / block).cast("int"))
    lists = cut(placed.groupBy(key, "__b").agg(F.array_sort(F.collect_list(F.struct("__i", *fields))).alias("items")))
    rounds = (lists.agg(F.max("__b").alias("n")).first()["n"] or 0) + 1

    def take(s: Column, item: Column) -> Column:
        fits, after = step(s["state"], item)
        return F.struct(F.when(fits, after).otherwise(s["state"]).alias("state"), F.concat(s["kept"], F.array(fits)).alias("kept"))

    state, out = starts, None
    for b in range(rounds):
        first = F.struct(F.col("state"), F.array().cast("array<boolean>").alias("kept"))
        done = lists.where(F.col("__b") == b).join(state, key).select(key, "items", F.aggregate("items", first, take).alias("s"))
        if rounds > 1:
            done = cut(done)
            state = done.select(key, F.col("s.state").alias("state"))
        part = done.select(key, F.inline(F.zip_with("items", F.col("s.kept"), lambda i, k: F.struct(*(i[c].alias(c) for c in fields), k.alias("kept")))))
        out = part if out is None else out.unionByName(part)
    return out
