"""Views that bring several families together: sources, texts, plans, repairs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import entity_id, half_up
from ..functions.runtime import running
from .extraction import normalize_domain


def source_of(segments: DataFrame, messages: DataFrame) -> DataFrame:
    """chat_id, segment_id, message_index, role, n_tokens: the messages of each segment's range."""
    ranges = segments.where("chat_id is not null and first_index <= last_index")
    opened = ranges.select("chat_id", "segment_id", F.explode(F.sequence("first_index", "last_index")).alias("message_index"))
    return opened.join(messages.select("chat_id", "message_index", "role", "n_tokens"), ["chat_id", "message_index"])


def combine_plans(planned: DataFrame, reused: DataFrame) -> DataFrame:
    """Per chat: n_planned, n_reused, planned_tokens, most_tokens of a plan with the segments it reuses. Both: chat_id, n_tokens."""
    rows = planned.select("chat_id", "n_tokens", F.lit(0).alias("r")).unionByName(reused.select("chat_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.lit(1).alias("r")))
    new = F.col("r") == 0
    zero = F.lit(0).cast("bigint")
    return rows.groupBy("chat_id").agg(F.sum(new.cast("bigint")).alias("n_planned"), F.sum(F.col("r").cast("bigint")).alias("n_reused"), F.coalesce(F.sum(F.when(new, F.col("n_tokens"))), zero).alias("planned_tokens"), F.coalesce(F.max("n_tokens"), zero).alias("most_tokens"))


def qualification(messages: DataFrame, credit_rate: float = 0.5) -> DataFrame:
    """Per chat: n_messages, n_user, isolated_users (not answered before the next message), source_tokens, projected_tokens, projected_credits."""
    one = messages.withColumn("__one", F.lit(1))
    numbered = running(one, ["chat_id"], "message_index", [("sum", "__one", "__pos")])
    following = numbered.select("chat_id", (F.col("__pos") - 1).alias("__pos"), F.col("role").alias("__next"))
    both = numbered.join(following, ["chat_id", "__pos"], "left")
    alone = (F.col("role") == "user") & F.coalesce(F.col("__next") != "assistant", F.lit(True))
    rows = both.groupBy("chat_id").agg(F.count("*").alias("n_messages"), F.sum((F.col("role") == "user").cast("bigint")).alias("n_user"), F.sum(alone.cast("bigint")).alias("isolated_users"), F.sum("n_tokens").alias("source_tokens"))
    projected = (F.col("source_tokens") + F.greatest(F.lit(600).cast("bigint"), half_up(F.col("source_tokens") * F.lit(0.45)))).cast("bigint")
    return rows.withColumn("projected_tokens", projected).withColumn("projected_credits", F.col("projected_tokens") * F.lit(credit_rate))


def repair_domains(domains: Column) -> Column:
    """The domains of a list: each entry's term, `other` for what names none, each once, in order of first use. A null list stays null."""
    return F.array_distinct(F.transform(domains, normalize_domain))


def resolve_references(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """mention_id, resolved_id, is_new: the entity each name means: the only one of its chat with that form, else a new one with a deterministic id.

    mentions: mention_id, chat_id, name (normal form, not empty); registry: chat_id, alias, entity_id.
    """
    sole = registry.groupBy("chat_id", "alias").agg(F.min("entity_id").alias("found"), F.count_distinct("entity_id").alias("n")).where("n = 1").select("chat_id", F.col("alias").alias("name"), "found")
    both = mentions.join(sole, ["chat_id", "name"], "left")
    new = entity_id(F.concat(F.lit("chat:"), F.col("chat_id"), F.lit(":mention:"), F.col("name")))
    return both.select("mention_id", F.coalesce("found", new).alias("resolved_id"), F.col("found").isNull().alias("is_new"))


def resolve_conflicts(conflicts: DataFrame, actions: DataFrame) -> DataFrame:
    """conflicts with status: unresolved, or that of the last action on it. A conflict found again after the action is unresolved. actions: chat_id, subject, property, seq, action."""
    keys = ["chat_id", "subject", "property"]
    last = actions.groupBy(*keys).agg(F.max(F.struct(F.col("seq").alias("s"), F.col("action").alias("a"))).alias("m"))
    both = conflicts.join(last, keys, "left")
    return both.withColumn("status", F.when(F.col("m.s") >= F.col("seq"), F.col("m.a")).otherwise("unresolved")).drop("m")


def inspect_relationships(changes: DataFrame, segments: DataFrame) -> DataFrame:
    """change_key, chat_id, segment_id, pair, dimension, operation, value: the changes of valid segments, each with an id of segment and place."""
    order = Window.partitionBy("segment_id").orderBy("rel_change_id")
    valid = segments.where("status = 'valid'").select("segment_id")
    rows = changes.join(valid, "segment_id", "left_semi").withColumn("__n", F.row_number().over(order) - 1)
    return rows.select(F.concat_ws(":", "segment_id", F.col("__n").cast("string")).alias("change_key"), "chat_id", "segment_id", F.array_join("participants", "|").alias("pair"), "dimension", "operation", "value")


def semantic_text(segments: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    """segment_id, text: the synopsis of each segment with the texts of its records, family by family, in order. families: segment_id, seq, text."""
    out = segments.select("segment_id", F.coalesce("synopsis", F.lit("")).alias("__t0"))
    for i, df in enumerate(families.values(), 1):
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
        out = out.join(df.where("text <> ''").groupBy("segment_id").agg(lines.alias(f"__t{i}")), "segment_id", "left")
    parts = [F.col(f"__t{i}") for i in range(len(families) + 1)]
    return out.select("segment_id", F.concat_ws(" ", *(F.when(p != "", p) for p in parts)).alias("text"))


def stale_suffix(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """chat_id, segment_id, status: from a chat's first segment whose source no longer matches on, all but excluded ones are stale. segments: chat_id, segment_id, ordinal, status; matches: segment_id, matches."""
    broken = segments.join(matches.select("segment_id", "matches"), "segment_id", "left").withColumn("__b", (~F.coalesce("matches", F.lit(False))).cast("int"))
    seen = running(broken, ["chat_id"], "ordinal", [("max", "__b", "__seen")], inclusive=True)
    return seen.select("chat_id", "segment_id", F.when((F.col("__seen") == 1) & (F.col("status") != "excluded"), "stale").otherwise(F.col("status")).alias("status"))


def replay_status(plan: DataFrame, records: DataFrame) -> DataFrame:
    """Per chat: n_planned, n_available, n_missing, n_conflicting: recorded artifacts against a plan. plan: chat_id, segment_id; records: segment_id, payload; two payloads under one id conflict."""
    per = records.groupBy("segment_id").agg(F.count_distinct("payload").alias("k"))
    both = plan.join(per, "segment_id", "left")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return both.groupBy("chat_id").agg(F.count("*").alias("n_planned"), count(F.col("k").isNotNull()).alias("n_available"), count(F.col("k").isNull()).alias("n_missing"), count(F.col("k") > 1).alias("n_conflicting"))


def status_view(messages: DataFrame, segments: DataFrame, entities: DataFrame, commitments: DataFrame) -> DataFrame:
    """Per chat: n_messages, last_index, n_valid, coverage (share of messages up to the last segment's end), n_entities, n_open_commitments."""
    m = messages.groupBy("chat_id").agg(F.count("*").alias("n_messages"), F.max("message_index").alias("last_index"))
    s = segments.groupBy("chat_id").agg(F.sum((F.col("status") == "valid").cast("bigint")).alias("n_valid"), F.max("last_index").alias("__end"))
    e = entities.groupBy("chat_id").agg(F.count("*").alias("n_entities"))
    c = commitments.where("status in ('active', 'made', 'unknown')").groupBy("chat_id").agg(F.count("*").alias("n_open_commitments"))
    rows = m.join(s, "chat_id", "left").join(e, "chat_id", "left").join(c, "chat_id", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("chat_id", "n_messages", "last_index", F.coalesce("n_valid", zero).alias("n_valid"), F.coalesce((F.col("__end") + 1) / (F.col("last_index") + 1), F.lit(0.0)).alias("coverage"), F.coalesce("n_entities", zero).alias("n_entities"), F.coalesce("n_open_commitments", zero).alias("n_open_commitments"))


def compact(value: Column) -> Column:
    """A struct as JSON text without its null members."""
    return F.to_json(value)
