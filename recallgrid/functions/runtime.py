"""Session helpers: lineage cuts on shared storage, task spreading, skew-free running sums."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in tests: masters `local`, `local[n]` and the like."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: that of `spark.checkpoint.dir`, shared by all executors.

    A folder of this machine is set only where none is named and everything runs in one process; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None and not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="recallgrid-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` on shared storage and drop its lineage, so lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table stored in fewer splits than there are cores, for steps bound by Python time. For scans only: no exchange is run to count the splits.

    A table large enough to fill the cluster has more splits than cores and passes unchanged, without a shuffle. Rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most: int, what: str) -> DataFrame:
    """`df` marked for broadcast after its rows were counted: an error beyond `most`, the bound that `what` is known to keep."""
    found = df.limit(most + 1).count()
    if found > most:
        raise ValueError(f"{what}: more than {most} rows, too many to broadcast")
    return F.broadcast(df)


def running(df: DataFrame, keys: list[str], order: str, specs: list[tuple[str, str, str]], inclusive: bool = False, block: int = 1 << 12) -> DataFrame:
    """Running aggregates over the rows of the same keys with a smaller `order` (an integer, unique per key; with `inclusive` the row itself too).

    specs: (sum, max or min; value column; name of the result). Works in two levels, so that no task holds all rows of a hot key:
    aggregates per block of `block` consecutive order values, running aggregates over those blocks, and running
    aggregates inside each block. Sums start at 0, the others at null. Rows with null keys or order are left out.
    """
    of = {"sum": F.sum, "max": F.max, "min": F.min}
    merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
    b = "__block"
    with_block = df.withColumn(b, F.floor(F.col(order) / F.lit(block)))
    totals = with_block.groupBy(*keys, b).agg(*(of[how](value).alias(f"__t{i}") for i, (how, value, _) in enumerate(specs)))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, b, *(of[how](f"__t{i}").over(before).alias(f"__s{i}") for i, (how, _, _) in enumerate(specs)))
    inside = Window.partitionBy(*keys, b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = with_block.select("*", *(of[how](value).over(inside).alias(f"__i{i}") for i, (how, value, _) in enumerate(specs)))
    joined = local.join(starts, [*keys, b])
    for i, (how, _, out) in enumerate(specs):
        joined = joined.withColumn(out, merge[how](F.col(f"__s{i}"), F.col(f"__i{i}")))
    return joined.drop(b, *(f"__{x}{i}" for x in "si" for i in range(len(specs))))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = 1 << 12) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same keys with a smaller `order`; see `running`."""
    return running(df, keys, order, [("sum", value, out)], block=block)


def null_if_blank(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
