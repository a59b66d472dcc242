"""Applying a change feed: the current state of a table of nested paths, resolved newest first."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.runtime import cut, small

#: Rows of the feed that one batch resolves.
BATCH_ROWS = 50_000_000
#: Batches at most; beyond that they grow.
MOST_BATCHES = 60
#: Spellings that the reference list may give for removal: they are broadcast.
MOST_SPELLINGS = 10_000
LEAVES = T.ArrayType(T.StructType([T.StructField("tail", T.StringType()), T.StructField("value", T.StringType())]))


class _Number(str):
    """A JSON number kept as written."""


def _text(value: object) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(_text(x) for x in value) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_text(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def flatten_object(text: str | None) -> list[dict] | None:
    """The leaves of a JSON object as (tail below the object's path, JSON text); None if `text` is no JSON object."""
    if text is None or not text.lstrip().startswith("{"):
        return None
    try:
        top = json.loads(text, parse_float=_Number, parse_int=_Number)
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out, stack = {}, [("", top)]
    while stack:
        tail, node = stack.pop()
        for name, value in node.items():
            below = ".".join(x for x in (tail, *(p.strip() for p in name.split("."))) if x)
            if isinstance(value, dict):
                stack.append((below, value))
            else:
                out[below] = _text(value)
    return [{"tail": k, "value": v} for k, v in sorted(out.items())]


@F.pandas_udf(LEAVES)
def _flattened(texts: pd.Series) -> pd.Series:
    return texts.map(flatten_object)


def normal_path(path: Column) -> Column:
    """Names between dots: blanks around them and empty names dropped, joined by single dots; null if none is left."""
    names = F.filter(F.transform(F.split(path, r"\."), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.size(names) > 0, F.array_join(names, "."))


def operation_key(text: Column) -> Column:
    """An operation as compared: lower case, outer signs dropped, runs of blanks, dashes and underscores as one blank."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s_\-]+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def removing_spellings(canonical_values: DataFrame, field: str = "state_operation", remove: str = "remove") -> DataFrame:
    """The compared spellings (column `op_key`) that mean removal, from the reference list."""
    rows = canonical_values.where((F.col("field_name") == field) & (F.col("canonical") == remove))
    words = F.concat(F.array("canonical"), F.coalesce("known_spellings", F.array().cast("array<string>")))
    return rows.select(F.explode(words).alias("w")).select(operation_key(F.col("w")).alias("op_key")).distinct()


def latest_revisions(changes: DataFrame) -> DataFrame:
    """One row per (chat_id, change_seq): that of the highest revision. Rows without change_seq, subject or path are left out.

    A null revision ranks below all. Rows that share chat, sequence and revision but differ are resolved by the
    greatest (subject, path, operation, value), so the result doesn't depend on the order of arrival.
    """
    usable = changes.select(
        "chat_id", "change_seq", F.coalesce("revision", F.lit(-(2**31))).alias("revision"), "subject",
        normal_path(F.col("path")).alias("path"), operation_key(F.coalesce("operation", F.lit(""))).alias("op_key"), "value",
    ).where("change_seq is not null and subject is not null and path is not null")
    best = F.max(F.struct("revision", "subject", "path", "op_key", "value")).alias("r")
    return usable.groupBy("chat_id", "change_seq").agg(best).select("chat_id", "change_seq", "r.*")


def apply_changes(changes: DataFrame, canonical_values: DataFrame, base: DataFrame | None = None, batches: int | None = None) -> DataFrame:
    """The live leaves (chat_id, subject, path, value) after all changes, however their rows arrived.

    Newest-first resolution. The change log is brought to one row per (chat, sequence), opened into leaf images
    (path set to a value) and tombstones (path and all below dropped: a removal, or the reset that an object value
    implies), and pre-aggregated per path and batch, a batch being a range of change_seq. Then the batches are taken
    backwards: a batch's images whose path is already resolved, or lies at or below a newer tombstone, are
    anti-joined away; what is left is recorded with the batch's tombstones. Last come the rows of `base` (the state
    before the feed, same columns) that nothing resolved. Unless told, there is a batch for every BATCH_ROWS rows, at least two.

    Paths are compared through their prefixes, exploded to an equi-join, so no task gathers a subject. Nulls: see
    `latest_revisions`; a set with a null value leaves a leaf with null value. Blank paths count as null. Repeated rows count once.
    Extra columns are ignored. Empty feed: `base`, or no rows.
    """
    latest = latest_revisions(changes)
    removing = small(removing_spellings(canonical_values).withColumn("is_removal", F.lit(True)), MOST_SPELLINGS, "spellings of removals")
    marked = latest.join(removing, "op_key", "left").withColumn("is_removal", F.coalesce("is_removal", F.lit(False)))
    holds_object = ~F.col("is_removal") & F.col("value").rlike(r"^\s*\{")
    opened = marked.withColumn("leaves", _flattened(F.when(holds_object, F.col("value"))))
    resets = F.col("is_removal") | F.col("leaves").isNotNull()
    tomb = F.struct(F.col("path"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("tomb"))
    own = F.struct(F.col("path"), F.col("value"), F.lit(False).alias("tomb"))
    below = F.transform("leaves", lambda x: F.struct(F.concat_ws(".", "path", F.when(x["tail"] != "", x["tail"])).alias("path"), x["value"].alias("value"), F.lit(False).alias("tomb")))
    entries = F.when(F.col("is_removal"), F.array(tomb)).when(resets, F.concat(F.array(tomb), below)).otherwise(F.array(own))
    log = opened.select("chat_id", "subject", "change_seq", F.inline(entries))

    bounds: list[int] = []
    if batches != 1:  # counted, and cut at a handful of split points, in one pass over one column
        found = changes.where("change_seq is not null").agg(F.count("*").alias("n"), F.percentile_approx("change_seq", [k / MOST_BATCHES for k in range(1, MOST_BATCHES)], 1000).alias("q")).first()
        wanted = min(MOST_BATCHES, batches or max(2, -(-found["n"] // BATCH_ROWS)))
        bounds = sorted({found["q"][round(k * MOST_BATCHES / wanted) - 1] for k in range(1, wanted)}) if found["q"] else []
    batch = sum((F.when(F.col("change_seq") > b, 1).otherwise(0) for b in bounds), F.lit(0))
    images = F.max(F.when(~F.col("tomb"), F.struct("change_seq", "value"))).alias("image")
    tombs = F.max(F.when(F.col("tomb"), F.col("change_seq"))).alias("tomb_seq")
    per_path = cut(log.withColumn("batch", batch.cast("int")).groupBy("chat_id", "subject", "path", "batch").agg(images, tombs))

    resolved = None
    for k in range(len(bounds), -1, -1):
        part = per_path.where(F.col("batch") == k)
        own_tombs = part.where("tomb_seq is not null").select("chat_id", "subject", "path", "tomb_seq")
        candidates = part.where("image is not null").select("chat_id", "subject", "path", F.col("image.change_seq").alias("seq"), F.col("image.value").alias("value"))
        if resolved is None:
            live = _unresolved(candidates, own_tombs, None)
        else:  # tombstones of newer batches lie behind every change of this one
            newer = resolved.where("tomb").select("chat_id", "subject", "path", F.lit(None).cast("long").alias("tomb_seq"))
            live = _unresolved(candidates, own_tombs.unionByName(newer), resolved.where("not tomb"))
        seen = live.select("chat_id", "subject", "path", "value", F.lit(False).alias("tomb")).unionByName(
            own_tombs.select("chat_id", "subject", "path", F.lit(None).cast("string").alias("value"), F.lit(True).alias("tomb"))
        )
        resolved = seen if resolved is None else resolved.unionByName(seen)
        if k:
            resolved = cut(resolved)
    if base is not None:
        old = base.select("chat_id", "subject", normal_path(F.col("path")).alias("path"), "value", F.lit(None).cast("long").alias("seq")).where("subject is not null and path is not null")
        kept = _unresolved(old, resolved.where("tomb").select("chat_id", "subject", "path", F.lit(None).cast("long").alias("tomb_seq")), resolved.where("not tomb"))
        resolved = resolved.unionByName(kept.select("chat_id", "subject", "path", "value", F.lit(False).alias("tomb")))
    return resolved.where("not tomb").select("chat_id", "subject", "path", "value")


def _unresolved(candidates: DataFrame, tombs: DataFrame, images: DataFrame | None) -> DataFrame:
    """`candidates` without those at or below a later tombstone (one with null tomb_seq is later than all) or with an image."""
    names = F.split("path", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "."))
    if images is not None:
        candidates = candidates.alias("c").join(images.alias("i"), _same("c", "i"), "left_anti")
    under = candidates.select("chat_id", "subject", "path", "seq", F.explode(prefixes).alias("prefix")).alias("c")
    hit = (
        under.join(tombs.alias("t"), F.col("c.chat_id").eqNullSafe(F.col("t.chat_id")) & (F.col("c.subject") == F.col("t.subject")) & (F.col("c.prefix") == F.col("t.path")))
        .where("t.tomb_seq is null or t.tomb_seq > c.seq")
        .select("c.chat_id", "c.subject", "c.path")
    )
    return candidates.alias("c").join(hit.alias("h"), _same("c", "h"), "left_anti")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.chat_id").eqNullSafe(F.col(f"{b}.chat_id")) & (F.col(f"{a}.subject") == F.col(f"{b}.subject")) & (F.col(f"{a}.path") == F.col(f"{b}.path"))
