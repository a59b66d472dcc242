"""Event-sourced state: last-write-wins maps, lifecycles, conflicts, ages and their projection to ranked text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.exprs import fnv1a64
from ..functions.runtime import running

OPEN_COMMITMENTS = ("active", "made", "unknown")
#: Threads too vague to follow.
VAGUE_THREADS = ("love", "life", "drama", "tension")


def preference_gate(changes: DataFrame) -> DataFrame:
    """Adds `occurrence` and `accepted` to ordered changes (chat_id, change_seq, subject, path, value, evidence, persistence).

    identity.* takes explicit evidence only; preferences.* durable ones that are explicit or, strongly inferred, at least the second
    of the same subject, path and value; possessions.* durable or active ones that aren't weak. All else passes.
    """
    same = ["chat_id", "subject", "path", "value"]
    first = F.min("change_seq").over(Window.partitionBy(*same))
    seen = changes.withColumn("repeated", F.col("change_seq") > first)
    root = F.element_at(F.split("path", r"\."), 1)
    explicit, strong = F.coalesce(F.col("evidence") == "explicit", F.lit(False)), F.coalesce(F.col("evidence") == "strong_inference", F.lit(False))
    durable = F.coalesce(F.col("persistence") == "durable", F.lit(False))
    lasting = durable | F.coalesce(F.col("persistence") == "active", F.lit(False))
    weak = F.coalesce(F.col("evidence") == "weak_inference", F.lit(False))
    ok = F.when(root == "identity", explicit).when(root == "preferences", durable & (explicit | (strong & F.col("repeated")))).when(root == "possessions", lasting & ~weak).otherwise(F.lit(True))
    return seen.withColumn("accepted", ok)


def last_facts(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """chat_id, fact, value: the last value of every key of a chat, the subject playing no part."""
    return rows.where(F.col(key).isNotNull()).groupBy("chat_id", F.col(key).alias("fact")).agg(F.max_by(value, F.struct(*order)).alias("value"))


def knowledge(rows: DataFrame, order: list[str]) -> DataFrame:
    """chat_id, holder, proposition, kind: what is known after the last change of each, removals taken out. rows: holder, proposition, kind, op."""
    last = rows.groupBy("chat_id", "holder", "proposition").agg(F.max_by(F.struct("kind", "op"), F.struct(*order)).alias("m"))
    return last.where("m.op <> 'remove'").select("chat_id", "holder", "proposition", F.col("m.kind").alias("kind"))


def relationships(rows: DataFrame) -> DataFrame:
    """chat_id, pair, dimension, values (in order): the relationship of sorted participants in a dimension.

    rows: chat_id, seq, participants, dimension, op, value. A set replaces, a removal clears, an add appends to what was added since
    the last set or removal; an add after a set value drops that value.
    """
    pair = F.array_join(F.array_sort("participants"), "|")
    keyed = rows.where("participants is not null and dimension is not null").select("chat_id", pair.alias("pair"), "dimension", "seq", "op", "value")
    last_reset = F.max(F.when(F.col("op") != "add", F.struct("seq", "op", "value")))
    state = keyed.groupBy("chat_id", "pair", "dimension").agg(last_reset.alias("reset"))
    both = keyed.join(state, ["chat_id", "pair", "dimension"])
    added = (F.col("op") == "add") & (F.col("reset").isNull() | (F.col("seq") > F.col("reset.seq")))
    kept = both.where(added | ((F.col("op") != "add") & (F.col("seq") == F.col("reset.seq")) & (F.col("op") != "remove")))
    values = kept.groupBy("chat_id", "pair", "dimension").agg(F.max(added.cast("int")).alias("has_adds"), F.array_sort(F.collect_list(F.struct("seq", "op", "value"))).alias("v"))
    adds = F.transform(F.filter("v", lambda x: x["op"] == "add"), lambda x: x["value"])
    one = F.transform(F.slice("v", -1, 1), lambda x: x["value"])
    return values.select("chat_id", "pair", "dimension", F.when(F.col("has_adds") == 1, adds).otherwise(one).alias("values"))


def commitment_id(actor: Column, toward: Column, content: Column, own: Column | None = None) -> Column:
    """The id of a commitment: its own, else by the hash of who promised what to whom."""
    empty = F.lit("")
    made = F.concat(F.lit("commit_"), fnv1a64(F.concat(F.coalesce(actor, empty), F.lit("|"), F.coalesce(toward, empty), F.lit("|"), F.coalesce(content, empty))))
    return made if own is None else F.coalesce(own, made)


def commitments(rows: DataFrame) -> DataFrame:
    """chat_id, commitment_id, actor, toward, content, status, evidence, touches: each commitment with its first wording and last status.

    rows: chat_id, seq, actor, toward, content, transition, evidence, and `id` where commitments may bring one. `made` counts as active.
    """
    status = F.when(F.col("transition") == "made", "active").otherwise(F.col("transition"))
    own = F.col("id") if "id" in rows.columns else None
    keyed = rows.withColumn("commitment_id", commitment_id(F.col("actor"), F.col("toward"), F.col("content"), own)).withColumn("status", status)
    first = F.min(F.struct("seq", "actor", "toward", "content")).alias("f")
    last = F.max(F.struct("seq", "status", "evidence")).alias("l")
    return keyed.groupBy("chat_id", "commitment_id").agg(first, last, F.count("*").alias("touches")).select("chat_id", "commitment_id", "f.actor", "f.toward", "f.content", "l.status", "l.evidence", "touches")


def threads(rows: DataFrame) -> DataFrame:
    """chat_id, key, description, status: threads by last transition; advanced counts as active. Rows whose key or description is too vague change nothing. rows: chat_id, seq, key, description, transition."""
    last = F.max(F.struct("seq", "description", "transition")).alias("l")
    vague = F.coalesce(F.lower("key").isin(*VAGUE_THREADS) | F.lower("description").isin(*VAGUE_THREADS), F.lower("key").isin(*VAGUE_THREADS))
    kept = rows.where(F.col("key").isNotNull() & ~vague).groupBy("chat_id", "key").agg(last)
    return kept.select("chat_id", "key", "l.description", F.when(F.col("l.transition") == "advanced", "active").otherwise(F.col("l.transition")).alias("status"))


#: What a reason speaks of that sets a proposition against what might have been expected.
CONTRASTIVE = r"(?i)(attempt|explicit|refus|reject|did not|not occur|disqualif|without)"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def proposition_key(proposition: Column) -> Column:
    """A proposition as compared: compatibility characters unified, lower case, one blank between words. Python sees only texts with other than ASCII characters."""
    odd = proposition.rlike(r"[^\x00-\x7F]")
    unified = F.when(odd, _nfkc(F.when(odd, proposition))).otherwise(proposition)
    return F.trim(F.regexp_replace(F.lower(unified), r"\s+", " "))


def salient_negatives(rows: DataFrame) -> DataFrame:
    """chat_id, seq, proposition: what is worth remembering as not having happened, each proposition once per chat, the first telling.

    rows: chat_id, seq, proposition, reason, and where known continuity_relevant and contrastive (booleans). A row counts unless it is marked as irrelevant to what follows, and if it is marked as contrastive or its reason says so.
    """
    flag = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in rows.columns else F.lit(default)
    kept = rows.where(flag("continuity_relevant", True) & (flag("contrastive", False) | F.coalesce(F.col("reason").rlike(CONTRASTIVE), F.lit(False))) & F.col("proposition").isNotNull())
    keyed = kept.withColumn("__k", proposition_key(F.col("proposition")))
    return keyed.groupBy("chat_id", "__k").agg(F.min(F.struct("seq", "proposition")).alias("m")).select("chat_id", "m.seq", "m.proposition")


def conflicts(claims: DataFrame) -> DataFrame:
    """chat_id, subject, property, seq, earlier, later: the last claim of each property that contradicts the claim before it.

    claims: chat_id, seq, subject, property, value, superseding; seq distinct within a property. Values are compared as text. Rows without chat, subject, property or seq are left out.
    """
    told = claims.where("chat_id is not null and subject is not null and property is not null and seq is not null").withColumn("__v", F.struct("seq", "value"))
    before = running(told, ["chat_id", "subject", "property"], "seq", [("max", "__v", "__before")]).withColumn("earlier", F.col("__before.value"))
    clash = before.where("earlier is not null and value is not null and earlier <> value and not superseding")
    last = clash.groupBy("chat_id", "subject", "property").agg(F.max(F.struct("seq", "earlier", F.col("value").alias("later"))).alias("m"))
    return last.select("chat_id", "subject", "property", "m.seq", "m.earlier", "m.later")


def segment_ordinals(segments: DataFrame) -> DataFrame:
    """chat_id, segment_id, first_index, last_index, ordinal: place of each segment of a chat by first index and id, from 1.

    A two-level count: segments are few beside messages, but a chat may be long.
    """
    keyed = segments.where("chat_id is not null and first_index is not null").select("chat_id", "segment_id", "first_index", "last_index")
    per_index = keyed.groupBy("chat_id", "first_index").agg(F.count("*").alias("n"))
    before = running(per_index, ["chat_id"], "first_index", [("sum", "n", "__before")])
    inside = Window.partitionBy("chat_id", "first_index").orderBy("segment_id")
    placed = keyed.join(before.select("chat_id", "first_index", "__before"), ["chat_id", "first_index"])
    return placed.withColumn("ordinal", F.col("__before") + F.row_number().over(inside)).select("chat_id", "segment_id", "first_index", "last_index", "ordinal")


def provenance(touches: DataFrame, ordinals: DataFrame) -> DataFrame:
    """chat_id, kind, key, segment_id, ordinal, last_index: the latest segment that touched each key. touches: chat_id, segment_id, kind, key."""
    found = touches.join(ordinals, ["chat_id", "segment_id"])
    last = found.groupBy("chat_id", "kind", "key").agg(F.max(F.struct("ordinal", "segment_id", "last_index")).alias("m"))
    return last.select("chat_id", "kind", "key", "m.segment_id", "m.ordinal", "m.last_index")


def commitment_ageout(state: DataFrame, origin: DataFrame, ordinals: DataFrame, max_segments: int = 8) -> DataFrame:
    """state with age_segments and aged_out: open commitments last touched `max_segments` segments ago or more; 0 turns it off, no provenance keeps."""
    newest = ordinals.groupBy("chat_id").agg(F.max("ordinal").alias("newest"))
    touched = origin.where("kind = 'commitment'").select("chat_id", F.col("key").alias("commitment_id"), "ordinal")
    aged = state.join(touched, ["chat_id", "commitment_id"], "left").join(newest, "chat_id", "left").withColumn("age_segments", F.when(F.col("ordinal").isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.col("newest") - F.col("ordinal"))))
    out = F.col("status").isin(*OPEN_COMMITMENTS) & F.coalesce(F.col("age_segments") >= max_segments, F.lit(False)) & F.lit(max_segments > 0)
    return aged.withColumn("aged_out", out).drop("ordinal", "newest")


#: Ranks of the kinds of state items.
PRIORITY = {"commitment": 140, "relationship": 130, "character": 120, "thread": 110, "world_fact": 100, "narrator_fact": 90, "salient_negative": 70}


def state_items(parts: dict[str, DataFrame], origin: DataFrame, limit: int | None = None) -> DataFrame:
    """chat_id, kind, key, text, priority, last_index, ordinal, place: state items of all kinds ranked for a context.

    parts: by kind, chat_id, key, text. Order: priority, last message, ordinal, id; `limit` keeps a chat's first so many.
    """
    rows = None
    for kind, df in parts.items():
        part = df.select("chat_id", F.lit(kind).alias("kind"), "key", "text", F.lit(PRIORITY[kind]).alias("priority"))
        rows = part if rows is None else rows.unionByName(part)
    known = rows.join(origin.select("chat_id", "kind", "key", "last_index", "ordinal"), ["chat_id", "kind", "key"], "left")
    order = Window.partitionBy("chat_id").orderBy(F.col("priority").desc(), F.coalesce("last_index", F.lit(-1)).desc(), F.coalesce("ordinal", F.lit(-1)).desc(), F.concat_ws(":", F.lit("state"), "kind", "key"))
    ranked = known.withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= limit) if limit is not None else ranked


def checkpoints(segments: DataFrame, every: int = 50) -> DataFrame:
    """chat_id, frontier, segment_id, prefix_fingerprint: snapshot points every so many usable segments and at the end.

    segments: chat_id, segment_id, ordinal (of usable ones, from 1), row_hash (a 48-bit number). The fingerprint of a prefix is the sum, modulo 2^61 - 1, of
    the rows' hashes mixed with their places, so that it needs no chain and one pass over any length.
    """
    mixed = segments.withColumn("__m", F.pmod(F.col("row_hash") * 8191 + F.col("ordinal") * 131071, F.lit((1 << 40) - 87)))
    summed = running(mixed, ["chat_id"], "ordinal", [("sum", "__m", "__s")], inclusive=True)
    last = segments.groupBy("chat_id").agg(F.max("ordinal").alias("__last"))
    points = summed.join(last, "chat_id").where((F.col("ordinal") % every == 0) | (F.col("ordinal") == F.col("__last")))
    return points.select("chat_id", F.col("ordinal").alias("frontier"), "segment_id", F.pmod("__s", F.lit((1 << 61) - 1)).alias("prefix_fingerprint"))


def resume_point(points: DataFrame, current: DataFrame, start: DataFrame) -> DataFrame:
    """chat_id, frontier: the newest checkpoint at or before `start` whose prefix still has its fingerprint; none, no row. points, current: of `checkpoints`."""
    same = points.join(current.select("chat_id", "frontier", "prefix_fingerprint"), ["chat_id", "frontier", "prefix_fingerprint"], "left_semi")
    return same.join(start, "chat_id").where(F.col("frontier") <= F.col("start_ordinal")).groupBy("chat_id").agg(F.max("frontier").alias("frontier"))
