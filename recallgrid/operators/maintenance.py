"""Keeping derived rows right while their sources change: invalidation, shifting, promotion, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.greedy import greedy_independent
from ..functions.runtime import cut, running


def invalidate(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """chat_id, segment_id, status, reason: segments after an edit in each of some chats.

    edits: chat_id, edit_index, at most one a chat. Segments that cover the index go stale, all that begin at or behind the first of them, and whatever depends on a stale one,
    directly or through others (reason: covers, suffix, dependency). Excluded ones keep their status. The closure follows dependencies step by step from the new ones only.
    """
    s = cut(segments.select("chat_id", "segment_id", "first_index", "last_index", "status", "dependency_ids"))
    covering = s.join(edits, "chat_id").where("first_index <= edit_index and last_index >= edit_index")
    earliest = covering.groupBy("chat_id").agg(F.min("first_index").alias("earliest"))
    stale = s.join(earliest, "chat_id").join(edits, "chat_id").where("first_index >= earliest or (first_index <= edit_index and last_index >= edit_index)")
    stale = cut(stale.select("chat_id", "segment_id", F.when(F.expr("first_index <= edit_index and last_index >= edit_index"), "covers").otherwise("suffix").alias("reason")))
    needs = s.select("chat_id", "segment_id", F.explode("dependency_ids").alias("on"))
    fresh = stale
    while True:
        hit = needs.join(fresh.select("chat_id", F.col("segment_id").alias("on")), ["chat_id", "on"], "left_semi").select("chat_id", "segment_id").distinct()
        fresh = cut(hit.join(stale, ["chat_id", "segment_id"], "left_anti").withColumn("reason", F.lit("dependency")))
        if fresh.isEmpty():
            break
        stale = stale.unionByName(fresh)
    out = s.join(stale, ["chat_id", "segment_id"], "left")
    status = F.when(F.col("reason").isNotNull() & (F.col("status") != "excluded"), "stale").otherwise(F.col("status"))
    return out.select("chat_id", "segment_id", status.alias("status"), "reason")


def shift_ranges(segments: DataFrame, deletes: DataFrame) -> DataFrame:
    """chat_id, segment_id, first_index, last_index after a message is deleted (deletes: chat_id, edit_index): bounds behind it move up by one; a bound at it stays, and first never passes last."""
    d = segments.select("chat_id", "segment_id", "first_index", "last_index").join(deletes, "chat_id", "left")
    moved = lambda c: F.when(F.col(c) > F.col("edit_index"), F.col(c) - 1).otherwise(F.col(c))
    return d.select("chat_id", "segment_id", F.least(moved("first_index"), moved("last_index")).alias("first_index"), moved("last_index").alias("last_index"))


def select_branch(swipes: DataFrame, branches: DataFrame) -> DataFrame:
    """swipes with cache_hit: whether the state belonging to the chosen version of a message was kept. Both: chat_id, message_index, fingerprint."""
    kept = branches.select("chat_id", "message_index", "fingerprint").distinct().withColumn("cache_hit", F.lit(True))
    return swipes.join(kept, ["chat_id", "message_index", "fingerprint"], "left").withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def committable(jobs: DataFrame, current: DataFrame) -> DataFrame:
    """jobs with can_commit: a job may commit if it is the last begun under its id, in the same chat, on the same source.

    jobs: job_id, begun, chat_id, source_fp; current: chat_id, job_id, source_fp as it is now.
    """
    order = Window.partitionBy("job_id").orderBy(F.col("begun").desc())
    last = jobs.withColumn("__last", F.row_number().over(order) == 1)
    now = current.select("job_id", F.col("chat_id").alias("__chat"), F.col("source_fp").alias("__fp"))
    both = last.join(now, "job_id", "left")
    ok = F.col("__last") & F.coalesce(F.col("chat_id") == F.col("__chat"), F.lit(False)) & F.coalesce(F.col("source_fp") == F.col("__fp"), F.lit(False))
    return both.withColumn("can_commit", ok).drop("__last", "__chat", "__fp")


def archive_session(items: DataFrame) -> DataFrame:
    """items (chat_id, place, segment_id, status) with archived_status: from the first broken item (failed or stale) of a chat on, valid ones are stale."""
    broken = items.withColumn("__b", F.col("status").isin("failed", "stale").cast("int"))
    seen = running(broken, ["chat_id"], "place", [("max", "__b", "__seen")], inclusive=True)
    return seen.withColumn("archived_status", F.when((F.col("__seen") == 1) & (F.col("status") == "valid"), "stale").otherwise(F.col("status"))).drop("__b", "__seen")


def _opened(ranges: DataFrame, *keep: str) -> DataFrame:
    return ranges.where("first_index <= last_index").select("chat_id", *keep, F.explode(F.sequence("first_index", "last_index")).alias("message_index"))


def promote(current: DataFrame, candidates: DataFrame) -> DataFrame:
    """chat_id, first_index, last_index, origin: the ranges after promoting a rebuilt plan.

    Kept of the current ones: edited by hand, excluded, or touching no range of the plan. Candidates that touch a protected (edited or
    excluded) range are dropped. current: chat_id, segment_id, first_index, last_index, manual, status; candidates: chat_id, first_index, last_index.
    """
    protected = F.coalesce("manual", F.lit(False)) | (F.col("status") == "excluded")
    planned = _opened(candidates).distinct()
    touching = _opened(current, "segment_id").join(planned, ["chat_id", "message_index"], "left_semi").select("segment_id").distinct().withColumn("__t", F.lit(True))
    kept = current.join(touching, "segment_id", "left").where(protected | F.col("__t").isNull())
    guarded = _opened(current.where(protected)).distinct()
    blocked = _opened(candidates.withColumn("__f", F.col("first_index")).withColumn("__l", F.col("last_index")), "__f", "__l").join(guarded, ["chat_id", "message_index"], "left_semi").select("chat_id", F.col("__f").alias("first_index"), F.col("__l").alias("last_index")).distinct()
    free = candidates.join(blocked, ["chat_id", "first_index", "last_index"], "left_anti")
    return kept.select("chat_id", "first_index", "last_index", F.lit("kept").alias("origin")).unionByName(free.select("chat_id", "first_index", "last_index", F.lit("promoted").alias("origin")))


def reusable_segments(segments: DataFrame) -> DataFrame:
    """The segments a plan can reuse: of overlapping ones those edited by hand go first, then by first index, last update and id, greedily.

    segments: chat_id, segment_id, first_index, last_index, manual, updated_at. The greedy walk is done in rounds over the overlaps, found through opened ranges.
    """
    rank = F.struct(F.coalesce("manual", F.lit(False)).cast("int").alias("m"), (-F.col("first_index")).alias("f"), F.col("updated_at").alias("u"), F.col("segment_id").alias("i"))
    nodes = segments.where("first_index <= last_index").select("chat_id", "segment_id", rank.alias("rank"))
    opened = _opened(segments, "segment_id")
    a, b = opened.alias("a"), opened.alias("b")
    same = (F.col("a.chat_id") == F.col("b.chat_id")) & (F.col("a.message_index") == F.col("b.message_index")) & (F.col("a.segment_id") != F.col("b.segment_id"))
    overlaps = cut(a.join(b, same).select("a.chat_id", F.col("a.segment_id").alias("a"), F.col("b.segment_id").alias("b")).distinct())
    return greedy_independent(nodes, overlaps, ["chat_id"], "segment_id", "rank")


def rebuild_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """chat_id, first_index, last_index, synopsis, manual: rebuilt rows, where a row of the same range edited by hand is kept."""
    keys = ["chat_id", "first_index", "last_index"]
    hand = old.where("manual").groupBy(*keys).agg(F.max("synopsis").alias("old_synopsis"))
    both = new.select(*keys, F.col("synopsis").alias("new_synopsis")).join(hand, keys, "full")
    return both.select(*keys, F.coalesce("old_synopsis", "new_synopsis").alias("synopsis"), F.col("old_synopsis").isNotNull().alias("manual"))


def replay_cursor(attempts: DataFrame, consumed: DataFrame) -> DataFrame:
    """session, attempt_id, place: the next recorded attempt of each session behind those consumed; replays themselves don't count. consumed: session, n_consumed."""
    order = Window.partitionBy("session").orderBy("attempt_id")
    recorded = attempts.where("mode <> 'replay'").withColumn("place", F.row_number().over(order)).join(consumed, "session", "left")
    return recorded.where(F.col("place") == F.coalesce("n_consumed", F.lit(0)) + 1).select("session", "attempt_id", "place")


def session_summary(items: DataFrame) -> DataFrame:
    """Per chat: n_items, n_done, n_failed, source_tokens, baseline_fingerprint of its plan items (chat_id, segment_id, status, n_tokens), the fingerprint independent of order."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "segment_id", "status")), 1, 10), 16, 10).cast("bigint")
    return items.groupBy("chat_id").agg(F.count("*").alias("n_items"), F.sum((F.col("status") == "valid").cast("bigint")).alias("n_done"), F.sum((F.col("status") == "failed").cast("bigint")).alias("n_failed"), F.sum("n_tokens").cast("bigint").alias("source_tokens"), F.sum(h).alias("baseline_fingerprint"))
