"""Usage, cost, caps, percentiles and layered settings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Credits for a token.
PRICES = {"uncached": 0.5, "cached": 0.1, "output": 0.7}


def normalize_usage(raw: DataFrame, json: str = "usage") -> DataFrame:
    """Adds nominal, cached, uncached, output tokens read from a JSON text under the names providers use; what isn't told stays null."""
    at = lambda *paths: F.coalesce(*(F.get_json_object(json, f"$.{p}").try_cast("bigint") for p in paths))
    nominal, cached = at("input_tokens", "prompt_tokens"), at("cached_input_tokens", "prompt_tokens_details.cached_tokens", "cache_read_input_tokens")
    uncached = F.coalesce(at("uncached_input_tokens"), F.when(nominal.isNotNull() & cached.isNotNull(), F.greatest(F.lit(0).cast("bigint"), nominal - cached)))
    return raw.withColumn("nominal", nominal).withColumn("cached", cached).withColumn("uncached", uncached).withColumn("output", at("output_tokens", "completion_tokens"))


def credits(nominal: Column, cached: Column, uncached: Column, output: Column) -> Column:
    """Credits of an attempt; null if nothing of its usage is known. Uncached tokens not told are nominal less cached ones."""
    zero = F.lit(0)
    un = F.coalesce(uncached, F.when(nominal.isNotNull(), F.greatest(zero, nominal - F.coalesce(cached, zero))))
    total = F.coalesce(un, zero) * PRICES["uncached"] + F.coalesce(cached, zero) * PRICES["cached"] + F.coalesce(output, zero) * PRICES["output"]
    return F.when(un.isNotNull() | cached.isNotNull() | output.isNotNull(), total)


def attempt_costs(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Totals by `by`: tokens of each kind, credits of live and of replayed attempts, how many of each. attempts: nominal, cached, uncached, output, mode."""
    c = credits(F.col("nominal"), F.col("cached"), F.col("uncached"), F.col("output"))
    live, replay = F.col("mode") != "replay", F.col("mode") == "replay"
    zero = F.lit(0.0)
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    return attempts.withColumn("__c", c).groupBy(*by).agg(
        total("nominal").alias("nominal_tokens"), total("cached").alias("cached_tokens"), total("output").alias("output_tokens"), F.coalesce(F.sum(F.when(live, F.col("__c"))), zero).alias("credits"),
        F.coalesce(F.sum(F.when(replay, F.col("__c"))), zero).alias("replayed_credits"), F.sum(live.cast("bigint")).alias("n_live"), F.sum(replay.cast("bigint")).alias("n_replay"),
    )


def daily_spend(attempts: DataFrame) -> DataFrame:
    """day, n_requests, total_tokens of live attempts."""
    return attempts.where("mode = 'live'").groupBy("day").agg(F.count("*").alias("n_requests"), F.sum(F.coalesce("nominal", F.lit(0)) + F.coalesce("output", F.lit(0))).cast("bigint").alias("total_tokens"))


_GUARDED = ("ledger", "session", "attempt_id", "day", "projected", "decision", "spent_before", "day_before")


def token_guard(requests: DataFrame, session_cap: int, daily_cap: int) -> DataFrame:
    """ledger, session, attempt_id, day, projected, decision, spent_before, day_before: requests let through or blocked by caps (0: none), in order.

    requests: ledger, session, attempt_id, ts, day, projected, actual, healthy. The session's cap counts what the session spent, the day's cap what all sessions of the ledger spent that day. A blocked
    request spends nothing, so each decision depends on those before it: a walk over a ledger (one installation's requests) in the order of ts and attempt_id. With a daily cap a request is blocked while the ledger cannot
    be written (healthy false; null counts as true), since what the day has spent is not known then. decision: sent, session_cap, daily_cap or ledger_unavailable.

    Ledgers are walked side by side, each streaming through one task in sorted batches of numbers: of a ledger only its sessions' sums and its day's are held.
    """
    types = dict(requests.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, today, spent, by_day = object(), None, {}, 0
        for b in batches:
            out = []
            for own, session, _, day, projected, actual, healthy in zip(*(b.column(c).to_pylist() for c in ("ledger", "session", "attempt_id", "day", "projected", "actual", "healthy"))):
                if own != ledger:
                    ledger, today, spent, by_day = own, None, {}, 0
                if day != today:
                    today, by_day = day, 0
                before = spent.get(session, 0)
                blocked = "ledger_unavailable" if daily_cap and healthy is False else "session_cap" if session_cap and before + projected > session_cap else "daily_cap" if daily_cap and by_day + projected > daily_cap else ""
                out.append((blocked or "sent", before, by_day))
                if not blocked:
                    spent[session] = before + actual
                    by_day += actual
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _GUARDED[:5]), *made], list(_GUARDED))

    slim = requests.select("ledger", "session", "attempt_id", "ts", F.col("day").cast("string").alias("day"), F.col("projected").cast("bigint"), F.col("actual").cast("bigint"), F.col("healthy").cast("boolean") if "healthy" in types else F.lit(None).cast("boolean").alias("healthy"))
    ordered = slim.repartition("ledger").sortWithinPartitions("ledger", "ts", "attempt_id")
    return ordered.mapInArrow(run, f"ledger {types['ledger']}, session {types['session']}, attempt_id {types['attempt_id']}, day string, projected bigint, decision string, spent_before bigint, day_before bigint")


def nearest_rank(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """by, n, average and, for each name, the percentile by nearest rank: the smallest value at or below which the fraction of the rows lies. Values are counted first, so that windows run over distinct values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumn("__cum", F.sum("__n").over(order)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    picks = [F.min(F.when(F.col("__cum") >= F.greatest(F.lit(1), F.ceil(F.col("__all") * f)), F.col(value))).alias(name) for name, f in fractions.items()]
    return run.groupBy(*by).agg(F.sum("__n").alias("n"), (F.sum(F.col(value) * F.col("__n")) / F.sum("__n")).alias("average"), *picks)


#: Settings that are ratios, with their upper bound.
UPPER_BOUNDS = {"top_p": 1.0, "preemptive_ratio": 1.0, "safety_ratio": 1.0, "temperature": 2.0}
#: Layers of settings, the last valid value winning.
LAYERS = ("base", "default", "character", "group", "chat", "override")


def resolve_profiles(layers: DataFrame) -> DataFrame:
    """chat_id, key, value, source: the effective settings. layers: chat_id, layer, key, value (text).

    Numbers must be finite, at least 0 and within the setting's bound; other values of such keys are passed over. `source` names the layer that gave the value.
    """
    number = F.col("value").try_cast("double")
    bound = F.lit(float("inf"))
    for key, top in UPPER_BOUNDS.items():
        bound = F.when(F.col("key") == key, F.lit(top)).otherwise(bound)
    valid = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number <= bound) & (number < float("inf"))
    place = F.array_position(F.array(*(F.lit(x) for x in LAYERS)), F.col("layer"))
    kept = layers.where(valid & (place > 0)).groupBy("chat_id", "key").agg(F.max(F.struct(place.alias("p"), "value", "layer")).alias("m"))
    return kept.select("chat_id", "key", F.col("m.value").try_cast("double").alias("value"), F.col("m.layer").alias("source"))


def last_events(events: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The last n events of each group: a ring buffer read back."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return events.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


#: Keys whose values are story text and never leave through metrics.
NARRATIVE_KEYS = ("text", "prompt", "synopsis", "content", "message", "messages", "summary", "narrative")


def privacy_guard(events: DataFrame, json: str) -> DataFrame:
    """Adds allowed: false for an event whose JSON has a narrative key at any depth."""
    names = "|".join(re.escape(k) for k in NARRATIVE_KEYS)
    return events.withColumn("allowed", ~F.coalesce(F.col(json), F.lit("")).rlike(rf'(?i)"({names})"\s*:'))


def redact_diagnostic(text: Column) -> Column:
    """Quoted values masked, at most 160 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "[redacted]"), r"'(?:[^'\\]|\\.)*'", "[redacted]"), F.lit(160))


#: How keys and tokens are written in error messages, what stands in for them, and how much of a message is kept.
SECRET_NAMED = r"(?i)(api[_-]?key|authorization|bearer)\s*[:=]\s*\S+"
SECRET_TOKEN = r"\bsk-[A-Za-z0-9._-]+\b"
REDACTED, MESSAGE_CHARS = "[redacted]", 280


def mask_secrets(text: Column) -> Column:
    """Keys and bearer tokens in an error message masked, at most MESSAGE_CHARS characters."""
    named = F.regexp_replace(text, SECRET_NAMED, f"$1: {REDACTED}")
    return F.left(F.regexp_replace(named, SECRET_TOKEN, REDACTED), F.lit(MESSAGE_CHARS))
