"""Logs of writes folded to what they leave behind: preferences, profiles, registers; claims, cached vectors, counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import running


def semantic_counts(segments: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    """family, n: the records of each family in valid segments that may stand for their source. segments: segment_id, status, eligible (null counts as true); families: segment_id."""
    kept = segments.where("status = 'valid' and coalesce(eligible, true)").select("segment_id").distinct()
    rows = None
    for name, df in families.items():
        part = df.select(F.lit(name).alias("family"), "segment_id")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(kept, "segment_id", "left_semi").groupBy("family").agg(F.count("*").alias("n"))


def fold_preferences(patches: DataFrame) -> DataFrame:
    """chat_id, key, value: preferences after a log of patches (chat_id, seq, key, value), the last value of each key; a null value is a value."""
    return patches.groupBy("chat_id", "key").agg(F.max(F.struct("seq", "value")).alias("m")).select("chat_id", "key", F.col("m.value").alias("value"))


def revisions(writes: DataFrame) -> DataFrame:
    """chat_id, revision, updated: how many writes each chat's store has seen, and when the last was. writes: chat_id, seq, at; repeated ones (same seq) count once."""
    return writes.groupBy("chat_id", "seq").agg(F.max("at").alias("at")).groupBy("chat_id").agg(F.count("*").alias("revision"), F.max("at").alias("updated"))


def replace_chats(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows of `current` with those of every chat in `incoming` replaced by the incoming ones; same columns, chat_id among them."""
    return current.join(incoming.select("chat_id").distinct(), "chat_id", "left_anti").select(*incoming.columns).unionByName(incoming)


def profile_catalog(actions: DataFrame, valid: Callable | None = None) -> DataFrame:
    """scope, id, key, value: profile definitions after a log of actions (scope, id, seq, op, key, value).

    upsert merges a key into the definition; remove, or an upsert without a key, drops the definition. `valid` (a function from key and value columns to a condition) keeps other values out. Rows without id count only in the scope `default`.
    """
    usable = actions.where("id is not null or scope = 'default'").withColumn("id", F.coalesce("id", F.lit("")))
    reset = (F.col("op") == "remove") | F.col("key").isNull()
    last = usable.where(reset).groupBy("scope", "id").agg(F.max("seq").alias("reset"))
    kept = usable.where(~reset).join(last, ["scope", "id"], "left").where("reset is null or seq > reset")
    if valid is not None:
        kept = kept.where(valid(F.col("key"), F.col("value")))
    return kept.groupBy("scope", "id", "key").agg(F.max(F.struct("seq", "value")).alias("m")).select("scope", "id", "key", F.col("m.value").alias("value"))


def register_log(observations: DataFrame) -> DataFrame:
    """register, type, lifecycle, policy, observation_no and all columns of the observations: each register's observations numbered in order, with where they come from.

    observations: register, at (an integer, unique in a register), type and others. The type is that of the register's first observation, `generic` if it has none. A register read from segments is active and injected where relevant.
    """
    first = observations.where("register is not null").groupBy("register").agg(F.min(F.struct("at", "type")).alias("f")).select("register", F.coalesce("f.type", F.lit("generic")).alias("type"))
    numbered = running(observations.drop("type").withColumn("__one", F.lit(1)), ["register"], "at", [("sum", "__one", "__before")])
    return numbered.join(first, "register").withColumn("observation_no", (F.col("__before") + 1).cast("bigint")).withColumn("lifecycle", F.lit("active")).withColumn("policy", F.lit("relevant")).drop("__one", "__before")


def single_flight(claims: DataFrame) -> DataFrame:
    """chat_id, job_id, granted: of jobs that claim a chat (chat_id, job_id, begun, ended; integers or times), those that found no granted one running. In the order of begun, then job_id.

    A job that is refused holds nothing, so each grant depends on those before: chats stream through tasks sorted, of each only the end of its running job is held. A job without an end holds the chat for good.
    """
    types = dict(claims.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, until, free = object(), None, True
        for b in batches:
            out = []
            for own, begun, ended in zip(*(b.column(c).to_pylist() for c in ("chat_id", "begun", "ended"))):
                if own != chat:
                    chat, until, free = own, None, True
                granted = free or (until is not None and begun >= until)
                if granted:
                    until, free = ended, False
                out.append(granted)
            yield pa.RecordBatch.from_arrays([b.column("chat_id"), b.column("job_id"), pa.array(out, pa.bool_())], ["chat_id", "job_id", "granted"])

    ordered = claims.select("chat_id", "job_id", "begun", "ended").where("chat_id is not null and begun is not null").repartition("chat_id").sortWithinPartitions("chat_id", "begun", "job_id")
    return ordered.mapInArrow(run, f"chat_id {types['chat_id']}, job_id {types['job_id']}, granted boolean")


def generation_source(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests (request_id, mode, fingerprint, ...) with `source` and `response`: how each is answered. live: by the provider; replay: by the recorded response of its fingerprint, else not at all; offline: not at all."""
    known = recorded.groupBy("fingerprint").agg(F.max(F.struct("attempt", "response")).alias("r"))
    both = requests.join(known, "fingerprint", "left")
    found = (F.col("mode") == "replay") & F.col("r").isNotNull()
    source = F.when(F.col("mode") == "live", "provider").when(found, "record").when(F.col("mode") == "replay", "replay_missing").otherwise("unavailable")
    return both.withColumn("source", source).withColumn("response", F.when(found, F.col("r.response"))).drop("r")


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], keep: list[str]) -> DataFrame:
    """keep, embedding, source: vectors of texts, from the cache by fingerprint, else by the model; null where it fails.

    texts: keep, fingerprint, text; cache: fingerprint, embedding. `embed` takes a batch of texts; if it raises, each text of the batch is tried by itself, and those that fail have no vector. Each missing
    fingerprint is computed once, however many rows share it. source: cache, model or failed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("text").to_pylist()
            try:
                found = embed(rows)
            except Exception:
                found = []
                for text in rows:
                    try:
                        found += embed([text])
                    except Exception:
                        found.append(None)
            yield pa.RecordBatch.from_arrays([b.column("fingerprint"), pa.array(found, pa.list_(pa.float64()))], ["fingerprint", "made"])

    stored = cache.groupBy("fingerprint").agg(F.first("embedding", ignorenulls=True).alias("stored")).where("stored is not null")
    missing = texts.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("text").alias("text")).where("text is not null").join(stored, "fingerprint", "left_anti")
    made = missing.mapInArrow(run, "fingerprint string, made array<double>")
    both = texts.join(stored, "fingerprint", "left").join(made, "fingerprint", "left")
    source = F.when(F.col("stored").isNotNull(), "cache").when(F.col("made").isNotNull(), "model").otherwise("failed")
    return both.select(*keep, F.coalesce("stored", "made").alias("embedding"), source.alias("source"))
