"""Packing ranked memory into bounded contexts, and what that leaves out of the raw chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import tokens
from ..functions.greedy import fold_with_skip

#: Regions of a context in the order they are packed, with the heading each opens with.
REGIONS = {"state": "[STATE]", "registers": "[REGISTERS]", "chronological": "[RECENT HISTORY]", "associative": "[OLDER MEMORY]"}
FRAME_CHARS = 160


def allocate_budgets(config: DataFrame) -> DataFrame:
    """Adds raw_budget to rows with hard, raw, state, registers, chronological, associative: the raw part gives way to a reserve for memory.

    Reserve: what the memory regions ask for (history counts up to 1,024, older memory up to 768), at most 0.4 of the hard budget.
    """
    zero = F.lit(0).cast("bigint")
    at_least = lambda c: F.greatest(zero, F.coalesce(F.col(c).cast("bigint"), zero))
    hard = at_least("hard")
    asked = F.coalesce(F.col("state"), zero) + F.coalesce(F.col("registers"), zero) + F.least(F.lit(1024), at_least("chronological")) + F.least(F.lit(768), at_least("associative"))
    reserve = F.least(hard, asked, F.floor(hard * 0.4))
    return config.withColumn("raw_budget", F.least(at_least("raw"), F.greatest(zero, hard - reserve)).cast("bigint"))


def region_candidates(segments: DataFrame, scored: DataFrame, raw_first: DataFrame, recent: int = 8) -> DataFrame:
    """chat_id, region, item, first_index, last_index, text, priority: memory items that may enter a context, each range once.

    segments: valid ones (chat_id, segment_id, first_index, last_index, pinned, synopsis). The `recent` last ones before the raw part are
    chronological, older ones associative with their score (scored: segment_id, score; none counts 0) and 80 for explicit evidence. Pinned ones come first.
    Ranges that touch the raw part (raw_first: chat_id, raw_first) are left out; of equal ranges the chronological one stays.
    """
    from pyspark.sql import Window

    before = segments.join(raw_first, "chat_id", "left").where("raw_first is null or last_index < raw_first").where("synopsis is not null and synopsis <> ''")
    newest = Window.partitionBy("chat_id").orderBy(F.col("last_index").desc(), F.col("first_index").desc(), F.col("segment_id"))
    placed = before.withColumn("__n", F.row_number().over(newest)).join(scored.groupBy("segment_id").agg(F.max("score").alias("score")), "segment_id", "left")
    region = F.when(F.col("__n") <= recent, "chronological").otherwise("associative")
    pinned = F.coalesce(F.col("pinned"), F.lit(False))
    priority = F.when(F.col("__n") <= recent, F.when(pinned, 200.0).otherwise(60.0)).otherwise(F.coalesce("score", F.lit(0.0)) + 80 + F.when(pinned, 200).otherwise(0))
    same = Window.partitionBy("chat_id", "first_index", "last_index").orderBy("__n")
    label = F.when(F.col("first_index") == F.col("last_index"), F.concat(F.lit("[msg "), "first_index", F.lit("] "))).otherwise(F.concat(F.lit("[msgs "), "first_index", F.lit("-"), "last_index", F.lit("] ")))
    rows = placed.select("chat_id", region.alias("region"), F.col("segment_id").alias("item"), "first_index", "last_index", F.concat(label, "synopsis").alias("text"), priority.alias("priority"), F.row_number().over(same).alias("__same"))
    return rows.where("__same = 1").drop("__same")


def pack(items: DataFrame, raw: DataFrame, budgets: dict[str, int], hard: int) -> DataFrame:
    """chat_id, region, item, place, kept: which items enter each context. Greedy with skip: an item is kept if its region and the whole stay within budget.

    items: chat_id, region, item, place (order of packing over all regions), n_chars; ranked lists of any length, folded in blocks. raw: chat_id, raw_chars.
    Tokens are those of the joined text: a region's heading and its items, one a line; regions two line ends apart inside a frame; so characters are
    summed along the fold and divided at the end.
    """
    names = list(REGIONS)
    region_no = F.lit(None).cast("int")
    for i, name in enumerate(names):
        region_no = F.when(F.col("region") == name, i).otherwise(region_no)
    heads = F.array(*(F.lit(len(h)) for h in REGIONS.values()))
    limits = F.array(*(F.lit(budgets.get(n, 0)) for n in names))
    rows = items.withColumn("region_no", region_no).where("region_no is not null and n_chars > 0")
    raw_tokens = F.ceil(F.coalesce("raw_chars", F.lit(0)) / 4)
    starts = rows.select("chat_id").distinct().join(raw, "chat_id", "left").select("chat_id", F.struct(F.transform(heads, lambda h: F.lit(0)).alias("chars"), raw_tokens.alias("raw")).alias("state"))

    def step(state: Column, item: Column) -> tuple[Column, Column]:
        r = item["region_no"]
        now = F.get(state["chars"], r)
        grown = F.when(now == 0, F.get(heads, r)).otherwise(now) + 1 + item["n_chars"]
        after = F.transform(state["chars"], lambda c, i: F.when(i == r, grown).otherwise(c))
        open_ = F.filter(after, lambda c: c > 0)
        block = F.aggregate(open_, F.lit(0), lambda s, c: s + c) + 2 * (F.size(open_) - 1) + FRAME_CHARS
        fits = (F.ceil(grown / 4) <= F.get(limits, r)) & (F.ceil(block / 4) + state["raw"] <= hard)
        return fits, F.struct(after.alias("chars"), state["raw"].alias("raw"))

    ranked = rows.select("chat_id", "place", "region_no", F.col("n_chars").cast("int").alias("n_chars"), "region", "item")
    return fold_with_skip(ranked, starts, "chat_id", step).select("chat_id", "region", "item", "place", "kept")


def context_accounting(packed: DataFrame, items: DataFrame, raw: DataFrame, hard: int) -> DataFrame:
    """Per chat: tokens of each region and of the raw part, total, utilization, overflow, n_dropped."""
    kept = packed.join(items.select("chat_id", "region", "item", "n_chars"), ["chat_id", "region", "item"])
    per = kept.groupBy("chat_id").agg(
        *(F.sum(F.when(F.col("kept") & (F.col("region") == n), F.col("n_chars") + 1)).alias(f"{n}_chars") for n in REGIONS), F.sum((~F.col("kept")).cast("bigint")).alias("n_dropped")
    ).join(raw, "chat_id", "left")
    chars = {n: F.coalesce(F.col(f"{n}_chars") + len(h), F.lit(0)) for n, h in REGIONS.items()}
    opened = sum(((c > 0).cast("int") for c in chars.values()), F.lit(0))
    block = F.when(opened > 0, sum(chars.values(), F.lit(0)) + 2 * (opened - 1) + FRAME_CHARS).otherwise(0)
    total = (F.ceil(block / 4) + F.ceil(F.coalesce("raw_chars", F.lit(0)) / 4)).cast("bigint")
    return per.select(
        "chat_id", *(F.ceil(c / 4).cast("bigint").alias(f"{n}_tokens") for n, c in chars.items()), F.ceil(F.coalesce("raw_chars", F.lit(0)) / 4).cast("bigint").alias("raw_tokens"), total.alias("total_tokens"),
        (total / F.lit(float(hard))).alias("utilization"), (total > hard).alias("overflow"), "n_dropped",
    )


def omitted_indices(segments: DataFrame, raw_indices: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """chat_id, message_index: messages that memory replaces: all of valid, eligible segments that touch no raw message, and of selected ranges those that aren't raw.

    segments: chat_id, segment_id, first_index, last_index, status, eligible.
    """
    ok = segments.where("status = 'valid' and coalesce(eligible, true) and chat_id is not null and first_index <= last_index")
    opened = ok.select("chat_id", "segment_id", F.explode(F.sequence("first_index", "last_index")).alias("message_index"))
    raw = raw_indices.select("chat_id", "message_index").distinct()
    touching = opened.join(raw, ["chat_id", "message_index"], "left_semi").select("segment_id").distinct()
    out = opened.join(touching, "segment_id", "left_anti").select("chat_id", "message_index")
    if selected is not None:
        more = selected.select("chat_id", F.explode(F.sequence("first_index", "last_index")).alias("message_index")).join(raw, ["chat_id", "message_index"], "left_anti")
        out = out.unionByName(more)
    return out.distinct()


def virtualize(messages: DataFrame, omitted: DataFrame, boundary: DataFrame) -> DataFrame:
    """Per chat: n_messages, n_omitted, depth (kept messages at or behind the boundary). boundary: chat_id, raw_first."""
    marked = messages.select("chat_id", "message_index").join(omitted.withColumn("gone", F.lit(True)), ["chat_id", "message_index"], "left").join(boundary, "chat_id", "left")
    gone = F.coalesce("gone", F.lit(False))
    behind = ~gone & F.coalesce(F.col("message_index") >= F.col("raw_first"), F.lit(False))
    return marked.groupBy("chat_id").agg(F.count("*").alias("n_messages"), F.sum(gone.cast("bigint")).alias("n_omitted"), F.sum(behind.cast("bigint")).alias("depth"))


def external_budget(prompts: DataFrame, max_tokens: int) -> DataFrame:
    """Per chat: n_entries, measured_tokens and reserve of what others put into the prompt. prompts: chat_id, text, excluded.

    Excluded and empty entries don't count; the reserve is capped at half of `max_tokens`, or 0 where that is below 1,024.
    """
    counts = ~F.coalesce("excluded", F.lit(False)) & (F.coalesce(F.length("text"), F.lit(0)) > 0)
    rows = prompts.groupBy("chat_id").agg(F.sum(counts.cast("bigint")).alias("n_entries"), F.sum(F.when(counts, tokens(F.col("text"))).otherwise(0)).alias("measured_tokens"))
    cap = max_tokens // 2 if max_tokens >= 1024 else 0
    return rows.withColumn("reserve", F.least(F.col("measured_tokens"), F.lit(cap).cast("bigint")))


def prompt_audit(prompts: DataFrame, blocks: DataFrame) -> DataFrame:
    """chat_id, occurrences, outcome: how often a chat's block stands in its final prompt: verified (once), mismatch (more), missing. prompts: chat_id, prompt; blocks: chat_id, block."""
    both = blocks.join(prompts, "chat_id", "left")
    times = F.when(F.length("block") > 0, F.floor((F.length("prompt") - F.length(F.replace(F.col("prompt"), F.col("block"), F.lit("")))) / F.length("block"))).otherwise(0)
    n = F.coalesce(times, F.lit(0)).cast("bigint")
    return both.select("chat_id", n.alias("occurrences"), F.when(n == 1, "verified").when(n > 1, "mismatch").otherwise("missing").alias("outcome"))


def pack_recent(items: DataFrame, budget: int, newest_first: bool = True) -> DataFrame:
    """chat_id, item, kept: greedy with skip over all of each chat's items, newest first, on summed tokens. items: chat_id, item, place (1 = newest), n_tokens."""
    place = F.col("place") if newest_first else -F.col("place")
    ranked = items.select("chat_id", place.alias("place"), "item", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    starts = ranked.select("chat_id").distinct().withColumn("state", F.lit(0).cast("bigint"))
    return fold_with_skip(ranked, starts, "chat_id", lambda s, i: (s + i["n_tokens"] <= budget, s + i["n_tokens"])).select("chat_id", "item", "kept")
