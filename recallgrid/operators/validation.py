"""Predicates over stored rows: validators that return all errors, source checks, search and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of a segment.
STATUSES = ("pending", "valid", "stale", "failed", "excluded")
#: Fixed value: the form of an entity's id.
ENTITY_ID = "^ent_[0-9a-f]{16}$"


def errors_of(checks: dict[str, Column]) -> Column:
    """All messages whose check is not met, joined; a check that is null is not met. Empty if all is well."""
    return F.concat_ws("; ", *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in checks.items()))


def filled(c: Column) -> Column:
    return F.trim(c) != ""


def validate_segments(segments: DataFrame) -> DataFrame:
    """segment_row_id, errors, ok."""
    checks = {
        "id must be a segment id": F.col("segment_id").rlike("^seg_[0-9a-f]{16}$"), "source range is invalid": F.col("first_index") <= F.col("last_index"), "dependencyIds must be an array": F.col("dependency_ids").isNotNull(),
        "sourceTokenCount must be a non-negative integer": F.col("source_token_count") >= 0, "status is unknown": F.col("status").isin(*STATUSES), "promptVersion is required": F.col("prompt_version") >= 1,
        "summary.synopsis is required": (F.col("status") != "valid") | filled(F.col("synopsis")), "createdAt is required": F.col("created_at").isNotNull(), "updatedAt is required": F.col("updated_at").isNotNull(),
        "manuallyEdited must be boolean": F.col("manually_edited").isNotNull(), "pinned must be boolean": F.col("pinned").isNotNull(),
    }
    return segments.select("segment_row_id", errors_of(checks).alias("errors")).withColumn("ok", F.col("errors") == "")


def validate_commitments(commitments: DataFrame, statuses: tuple[str, ...], evidence: tuple[str, ...]) -> DataFrame:
    """commitment_row_id, errors, ok."""
    checks = {
        "actor must be an EntityId": F.col("actor").rlike(ENTITY_ID), "toward must be an EntityId": F.col("toward").isNull() | F.col("toward").rlike(ENTITY_ID), "content is required": filled(F.col("content")),
        "transition is unknown": F.col("transition").isin(*statuses), "evidence is unknown": F.col("evidence").isin(*evidence),
    }
    return commitments.select("commitment_row_id", errors_of(checks).alias("errors")).withColumn("ok", F.col("errors") == "")


def validate_events(events: DataFrame, domains: tuple[str, ...], evidence: tuple[str, ...], salience: tuple[str, ...]) -> DataFrame:
    """event_row_id, errors, ok."""
    allowed = F.array(*(F.lit(x) for x in domains))
    checks = {
        "description is required": filled(F.col("description")), "participants must be an array": F.col("participants").isNotNull(), "evidence is unknown": F.col("evidence").isin(*evidence), "salience is unknown": F.col("salience").isin(*salience),
        "domains are unknown": F.col("domains").isNotNull() & F.forall("domains", lambda x: F.coalesce(F.array_contains(allowed, x), F.lit(False))),
    }
    return events.select("event_row_id", errors_of(checks).alias("errors")).withColumn("ok", F.col("errors") == "")


def validate_relationships(rows: DataFrame, dimensions: tuple[str, ...], operations: tuple[str, ...], evidence: tuple[str, ...]) -> DataFrame:
    """rel_change_id, errors, ok."""
    checks = {
        "at least two participants are required": F.size("participants") >= 2, "participants must be EntityIds": F.col("participants").isNotNull() & F.forall("participants", lambda x: F.coalesce(x.rlike(ENTITY_ID), F.lit(False))), "dimension is unknown": F.col("dimension").isin(*dimensions),
        "operation is unknown": F.col("operation").isin(*operations), "value is required": F.col("value").isNotNull(), "evidence is unknown": F.col("evidence").isin(*evidence),
    }
    return rows.select("rel_change_id", errors_of(checks).alias("errors")).withColumn("ok", F.col("errors") == "")


def validate_temporal(rows: DataFrame, kinds: tuple[str, ...], evidence: tuple[str, ...]) -> DataFrame:
    """mark_id, errors, ok."""
    checks = {"description is required": filled(F.col("description")), "kind is unknown": F.col("kind").isin(*kinds), "evidence is unknown": F.col("evidence").isin(*evidence)}
    return rows.select("mark_id", errors_of(checks).alias("errors")).withColumn("ok", F.col("errors") == "")


def validate_state_changes(rows: DataFrame, operations: tuple[str, ...], persistence: tuple[str, ...], evidence: tuple[str, ...]) -> DataFrame:
    """change_id, errors, ok."""
    checks = {
        "subject must be an EntityId": F.col("subject").rlike(ENTITY_ID), "path is required": filled(F.col("path")), "operation is unknown": F.col("operation").isin(*operations), "value is required": (F.col("operation") == "remove") | F.col("value").isNotNull(),
        "persistence is unknown": F.col("persistence").isin(*persistence), "evidence is unknown": F.col("evidence").isin(*evidence),
    }
    return rows.select("change_id", errors_of(checks).alias("errors")).withColumn("ok", F.col("errors") == "")


def validate_conflicts(conflicts: DataFrame, statuses: tuple[str, ...] = ("unresolved", "resolved", "dismissed")) -> DataFrame:
    """conflicts with errors and ok: both claims, what they are about and a known status are required."""
    checks = {"subject is required": filled(F.col("subject")), "property is required": filled(F.col("property")), "both claims are required": F.col("earlier").isNotNull() & F.col("later").isNotNull(), "status is unknown": F.col("status").isin(*statuses)}
    return conflicts.withColumn("errors", errors_of(checks)).withColumn("ok", F.col("errors") == "")


def search_records(rows: DataFrame, needle: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows any of whose columns, joined by blanks, holds the needle, in any case; blanks around the needle don't count, an empty one finds all."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(needle.strip().lower())))


def injectable(segments: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Valid segments that may stand in for their messages (eligible is true or null) and, if given, whose range fingerprint is in `allowed` (range_fp)."""
    kept = segments.where("status = 'valid' and coalesce(eligible, true)")
    return kept.join(allowed.select("range_fp").distinct(), "range_fp", "left_semi") if allowed is not None else kept


def source_matches(segments: DataFrame, messages: DataFrame) -> DataFrame:
    """chat_id, segment_id, n_present, matches: whether every message of a segment's range is there."""
    opened = segments.where("chat_id is not null and first_index <= last_index").select("chat_id", "segment_id", F.explode(F.sequence("first_index", "last_index")).alias("message_index"))
    there = opened.join(messages.select("chat_id", "message_index", F.lit(1).alias("there")), ["chat_id", "message_index"], "left")
    return there.groupBy("chat_id", "segment_id").agg(F.count("there").alias("n_present"), (F.count("there") == F.count("*")).alias("matches"))


def before_raw(segments: DataFrame, raw_first: DataFrame) -> DataFrame:
    """Segments that end before their chat's raw part; one without an end, or a chat without a raw part, doesn't qualify."""
    return segments.join(raw_first, "chat_id").where("last_index < raw_first").drop("raw_first")


def search_timeline(segments: DataFrame, needle: str) -> DataFrame:
    """Segments whose id, state or synopsis holds the needle, case aside; an empty needle keeps all."""
    text = F.lower(F.concat_ws(" ", "segment_id", "status", "synopsis"))
    return segments.where(F.contains(text, F.lit(needle.strip().lower())))


def sensitive_segments(events: DataFrame) -> DataFrame:
    """chat_id, segment_id of segments with an event of a romantic or sexual domain."""
    return events.where(F.exists("domains", lambda x: F.coalesce(x.isin("romantic", "sexual"), F.lit(False)))).select("chat_id", "segment_id").distinct()


def message_health(messages: DataFrame, segments: DataFrame, omitted: DataFrame) -> DataFrame:
    """chat_id, message_index, segment_id, health, context: the state of the memory that covers each message.

    Of several segments over a message the first by first index, then id, counts. health: green, stale, excluded, pending (also failed), none. context: summarized for a
    green message that is omitted from the prompt, else raw. segments: chat_id, segment_id, first_index, last_index, status, eligible.
    """
    opened = segments.where("chat_id is not null and first_index <= last_index").select("chat_id", F.struct("first_index", "segment_id", "status", F.coalesce("eligible", F.lit(True)).alias("eligible")).alias("s"), F.explode(F.sequence("first_index", "last_index")).alias("message_index"))
    first = opened.groupBy("chat_id", "message_index").agg(F.min("s").alias("s"))
    both = messages.select("chat_id", "message_index").join(first, ["chat_id", "message_index"], "left").join(omitted.select("chat_id", "message_index", F.lit(True).alias("gone")), ["chat_id", "message_index"], "left")
    status = F.col("s.status")
    health = F.when(F.col("s").isNull(), "none").when(status.isin("stale", "excluded"), status).when((status == "valid") & F.col("s.eligible"), "green").when(status.isin("pending", "failed"), "pending").otherwise("raw")
    return both.withColumn("health", health).select("chat_id", "message_index", F.col("s.segment_id").alias("segment_id"), "health", F.when((F.col("health") == "green") & F.coalesce("gone", F.lit(False)), "summarized").otherwise("raw").alias("context"))
