"""Chats as files: JSON lines with a header, portable envelopes, and key-value logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import running

LOG_SCHEMA = "user_name string, character_name string, chat_metadata string, is_user boolean, is_system boolean, name string, mes string, swipe_id int, send_date string, extra string"
KV_SCHEMA = "store string, key string, value string, deleted boolean"


def read_chat_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headers (chat_id, metadata) and messages (chat_id, message_index, role, name, text, hidden, swipe_id, send_date) of chat logs.

    One file a chat, its name the chat's. The first line that is not blank is the header, unless it is a message itself; a header that is no JSON has null metadata. Later lines that are no JSON are kept as messages of an
    assistant without text; a line with neither message nor sender likewise. Blank lines don't count.
    Lines are placed by their split's position in the file and their place in the split, so that a file is never sorted in one task.
    """
    raw = spark.read.format("text").load(path).select(F.col("value"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # every line takes a byte at least: the split's start and the lines before in the split order all lines of a file
    splits = raw.groupBy("file", "block").agg(F.min("n").alias("first"))
    lines = raw.where(F.trim("value") != "").join(splits, ["file", "block"]).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("chat_id"), (F.col("block") + F.col("n") - F.col("first")).alias("at"), "value")
    parsed = lines.select("chat_id", "at", F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", LOG_SCHEMA)).alias("m"))
    tops = parsed.groupBy("chat_id").agg(F.min("at").alias("top"))
    placed = parsed.join(tops, "chat_id").withColumn("is_header", (F.col("at") == F.col("top")) & F.col("m.is_user").isNull() & F.col("m.mes").isNull())
    headers = placed.where("is_header").select("chat_id", F.col("m.chat_metadata").alias("metadata"))
    role = F.when(F.col("m.is_system"), "system").when(F.col("m.is_user"), "user").otherwise("assistant")
    numbered = running(placed.where("not is_header").withColumn("__one", F.lit(1)), ["chat_id"], "at", [("sum", "__one", "__i")])
    messages = numbered.select("chat_id", F.col("__i").cast("int").alias("message_index"), role.alias("role"), F.coalesce("m.name", F.lit("")).alias("name"), F.coalesce("m.mes", F.lit("")).alias("text"), F.coalesce("m.is_system", F.lit(False)).alias("hidden"), F.coalesce("m.swipe_id", F.lit(0)).alias("swipe_id"), F.col("m.send_date").alias("send_date"))
    return headers, messages


def read_kv_log(spark: SparkSession, path: str) -> DataFrame:
    """store, key, value, deleted, line_no of a log-structured key-value file or a folder of them; see `store.last_writes`.

    line_no orders lines by file (last change, then name), place of the split in it, and line, however splits are spread over tasks.
    """
    raw = spark.read.schema(KV_SCHEMA).json(path).select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("line_no"))
    return raw


def write_kv_log(df: DataFrame, path: str) -> None:
    """Appends rows (store, key, value, deleted) as JSON lines."""
    df.select("store", "key", "value", "deleted").write.mode("append").json(path)


ENVELOPE_VERSION = 2


def to_envelopes(segments: DataFrame, part_size: int = 10_000) -> DataFrame:
    """chat_id, part, envelope: the stored segments of each chat as JSON texts of at most `part_size` segments each, in order."""
    from ..operators.state import segment_ordinals

    fields = ["segment_id", "first_index", "last_index", "status", "synopsis", "pinned", "manually_edited"]
    placed = segments.select("chat_id", *fields).join(segment_ordinals(segments).select("segment_id", "ordinal"), "segment_id")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", *fields))), lambda x: x.dropFields("ordinal"))
    parts = placed.groupBy("chat_id", F.floor((F.col("ordinal") - 1) / part_size).cast("int").alias("part")).agg(rows.alias("segments"))
    return parts.select("chat_id", "part", F.to_json(F.struct(F.lit(ENVELOPE_VERSION).alias("version"), "chat_id", "segments"), {"ignoreNullFields": "false"}).alias("envelope"))


ENVELOPE = "version int, chat_id string, segments array<struct<segment_id:string,first_index:int,last_index:int,status:string,synopsis:string,pinned:boolean,manually_edited:boolean>>, summaries array<struct<segment_id:string,first_index:int,last_index:int,status:string,synopsis:string,pinned:boolean,manually_edited:boolean>>"


def from_envelopes(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments read back from envelopes, and the rejected ones (chat_id, error).

    An envelope must be JSON, of version 1 (segments under `summaries`) or 2, and name the chat it is stored under.
    """
    e = envelopes.withColumn("e", F.from_json("envelope", ENVELOPE))
    error = F.when(F.try_parse_json("envelope").isNull(), "not JSON").when(~F.coalesce(F.col("e.version").isin(1, 2), F.lit(False)), "unknown version").when(~F.coalesce(F.col("e.chat_id") == F.col("chat_id"), F.lit(False)), "other chat")
    checked = e.withColumn("error", error)
    good = checked.where("error is null").select("chat_id", F.inline(F.coalesce("e.segments", "e.summaries")))
    return good, checked.where("error is not null").select("chat_id", "error")


def diagnostics(df: DataFrame, narrative: tuple[str, ...] = ("text", "synopsis", "content", "description", "evidence_text", "value", "mention", "structured_trace")) -> DataFrame:
    """The columns of a table that hold no story text."""
    return df.drop(*narrative)
