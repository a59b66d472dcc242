"""Writing tables so that a failed write never harms what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def put_file(spark: SparkSession, path: str, content: bytes) -> str:
    """Writes a file, in whatever file system its path names, and gives the path."""
    fs, Path = _fs(spark, path)
    out = fs.create(Path(path), True)
    out.write(bytearray(content))
    out.close()
    return path


def publish(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Writes a new version of a table below `root` and then points to it; gives the version's path.

    The rows go to a folder of their own; only when that is complete is the pointer, a file written beside, renamed over the old one: a single step, so that
    a reader finds the old pointer or the new one, never none. Readers of the old version aren't disturbed.
    """
    spark = df.sparkSession
    fs, Path = _fs(spark, root)
    fs.mkdirs(Path(root))
    jvm = spark.sparkContext._jvm
    versions = [int(s.getPath().getName()[1:]) for s in fs.listStatus(Path(root)) if s.getPath().getName()[:1] == "v" and s.getPath().getName()[1:].isdigit()]
    name = f"v{max(versions, default=0) + 1}"
    target = f"{root}/{name}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
    staged, pointer = f"{root}/CURRENT.{name}", f"{root}/CURRENT"
    put_file(spark, staged, name.encode())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(Path(root).toUri() if Path(root).toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(Path(staged)), fs.makeQualified(Path(pointer)), options)
    return target


def exists(spark: SparkSession, root: str) -> bool:
    """Whether any version of a table was published below `root`."""
    fs, Path = _fs(spark, root)
    return fs.exists(Path(root)) and any(s.getPath().getName() == "CURRENT" or s.getPath().getName()[1:].isdigit() and fs.exists(Path(f"{s.getPath()}/_SUCCESS")) for s in fs.listStatus(Path(root)))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version of a table that its pointer names; where a crash left none, the last complete one."""
    fs, Path = _fs(spark, root)
    pointer = Path(f"{root}/CURRENT")
    if fs.exists(pointer):
        name = spark.read.text(pointer.toString()).first()[0]
    else:
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(Path(root)) if s.getPath().getName()[1:].isdigit() and fs.exists(Path(f"{s.getPath()}/_SUCCESS"))]
        name = f"v{max(done)}"
    return spark.read.parquet(f"{root}/{name}")


def append_ledger(df: DataFrame, path: str) -> None:
    """Appends ledger rows, one folder a day, so that reading a day reads only its own."""
    df.write.mode("append").partitionBy("day").parquet(path)


def cached_by_fingerprint(df: DataFrame, cache: DataFrame, fingerprint: str, value: str, compute) -> DataFrame:
    """df with `value` taken from the cache (fingerprint, value) or, for rows it lacks, from `compute` (a column of df)."""
    hit = df.join(cache.select(fingerprint, value).dropDuplicates([fingerprint]), fingerprint, "left")
    from pyspark.sql import functions as F

    return hit.withColumn(value, F.coalesce(F.col(value), compute))
