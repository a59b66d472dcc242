"""Stored rows that change: upserts, action logs, journals and key-value logs as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_segments(rows: DataFrame) -> DataFrame:
    """One row per segment_id: a row edited by hand wins over rebuilt ones, then the last updated, then the last arrived (segment_row_id)."""
    order = Window.partitionBy("segment_id").orderBy(F.coalesce("manually_edited", F.lit(False)).desc(), F.col("updated_at").desc_nulls_last(), F.col("segment_row_id").desc())
    return rows.where("segment_id is not null").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def fold_actions(segments: DataFrame, actions: DataFrame) -> DataFrame:
    """segments with status, pinned and synopsis after a log of actions (segment_id, seq, action, value): pin, unpin, exclude, include, edit; the last of each kind counts.

    Taking an exclusion back makes a segment valid if it has a synopsis, else pending. Actions on unknown segments have no effect.
    """
    of = lambda *names: F.max(F.when(F.col("action").isin(*names), F.struct("seq", "action", "value")))
    last = actions.groupBy("segment_id").agg(of("pin", "unpin").alias("p"), of("exclude", "include").alias("x"), of("edit").alias("e"))
    both = segments.join(last, "segment_id", "left")
    synopsis = F.when(F.col("e").isNotNull(), F.col("e.value")).otherwise(F.col("synopsis"))
    restored = F.when(F.coalesce(synopsis, F.lit("")) != "", "valid").otherwise("pending")
    status = F.when(F.col("x.action") == "exclude", "excluded").when((F.col("x.action") == "include") & (F.col("status") == "excluded"), restored).otherwise(F.col("status"))
    pinned = F.when(F.col("p").isNotNull(), F.col("p.action") == "pin").otherwise(F.col("pinned"))
    return both.withColumn("status", status).withColumn("pinned", pinned).withColumn("synopsis", synopsis).drop("p", "x", "e")


def retire_commitments(state: DataFrame, retirements: DataFrame) -> DataFrame:
    """state with status `obsolete` for open commitments named in `retirements`, by id or, all digits, by place in the chat (from 0, by id); others stay as they are.

    state: chat_id, commitment_id, status; retirements: chat_id, target.
    """
    order = Window.partitionBy("chat_id").orderBy("commitment_id")
    placed = state.withColumn("__place", (F.row_number().over(order) - 1).cast("string"))
    wanted = retirements.distinct().withColumn("__r", F.lit(True))
    by_index = wanted.where(F.col("target").rlike("^[0-9]+$")).select("chat_id", F.col("target").alias("__place"), F.col("__r").alias("__by_index"))
    by_id = wanted.where(~F.col("target").rlike("^[0-9]+$")).select("chat_id", F.col("target").alias("commitment_id"), F.col("__r").alias("__by_id"))
    both = placed.join(by_index, ["chat_id", "__place"], "left").join(by_id, ["chat_id", "commitment_id"], "left")
    hit = F.coalesce("__by_index", "__by_id", F.lit(False)) & F.col("status").isin("made", "active", "unknown")
    return both.withColumn("status", F.when(hit, "obsolete").otherwise(F.col("status"))).drop("__place", "__by_index", "__by_id")


def attempt_journal(rows: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """key, payload, attempt: an append-only journal: the same payload under a key is one attempt, another the next number."""
    first = rows.groupBy(key, payload).agg(F.min(order).alias("__first"))
    return first.withColumn("attempt", F.row_number().over(Window.partitionBy(key).orderBy("__first"))).drop("__first")


def last_writes(log: DataFrame, keys: list[str], order: str, value: str, deleted: str) -> DataFrame:
    """keys, value of a key-value log with tombstones: the last write of each key, deleted ones left out."""
    last = log.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.coalesce(F.col(deleted), F.lit(False)).alias("d"))).alias("m"))
    return last.where("not m.d").select(*keys, F.col("m.v").alias(value))


def latest_by_prefix(records: DataFrame, prefix: str) -> DataFrame:
    """session, segment, attempt, value of the keys `<prefix>:<session>:<segment>:<attempt>`: the last attempt of each."""
    p = F.split("key", ":")
    rows = records.where(F.col("key").startswith(prefix + ":") & (F.size(p) == 4)).select(F.get(p, 1).alias("session"), F.get(p, 2).alias("segment"), F.get(p, 3).try_cast("int").alias("attempt"), "value")
    return rows.groupBy("session", "segment").agg(F.max("attempt").alias("attempt"), F.max_by("value", "attempt").alias("value"))


def pick_session(sessions: DataFrame, attempts: DataFrame, by: list[str]) -> DataFrame:
    """The session of each group to replay: the one with most recorded attempts, then the newest, then the smallest id. sessions: by, session, updated; attempts: session."""
    counted = sessions.join(attempts.groupBy("session").agg(F.count("*").alias("n_attempts")), "session", "left").withColumn("n_attempts", F.coalesce("n_attempts", F.lit(0)))
    order = Window.partitionBy(*by).orderBy(F.col("n_attempts").desc(), F.col("updated").desc(), "session")
    return counted.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*by, "session", "n_attempts")


def content_digest(messages: DataFrame) -> DataFrame:
    """chat_id, n_messages, digest: a digest of each chat's messages that changes with any of them, for comparing before and after.

    Digests of single messages, of which the first 52 bits are summed with their places, so that a chat of any length needs no order.
    """
    row = F.sha2(F.concat_ws("\x1f", F.col("message_index").cast("string"), "role", "name", "text"), 256)
    part = F.conv(F.substring(row, 1, 13), 16, 10).cast("decimal(38,0)")
    return messages.groupBy("chat_id").agg(F.count("*").alias("n_messages"), F.sum(part).cast("string").alias("digest"))
