"""Messages, turn bundles, raw foreground and coverage: the history of a chat cut by turns and token budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import narrative_form, tokens
from ..functions.runtime import running

#: Roles taken into the foreground unless a policy says otherwise.
DEFAULT_POLICY = ("user", "assistant")


def latest_messages(messages: DataFrame, *columns: str) -> DataFrame:
    """One row per (chat_id, message_index): of several arrived copies the last ingested (ties: the largest message_id).

    Columns: message_id, role, name, text, hidden, swipe_id, boundary_hint, send_date, n_tokens, or those of them named, so that texts aren't moved where only their
    counts matter. Roles are user, assistant or system; system rows count as hidden. Null texts and names are empty, a null hidden flag is false.
    `n_tokens` is counted from the text, whatever the stored count says. Rows without chat or index are left out.
    """
    made = {
        "role": F.coalesce("role", F.lit("assistant")), "name": F.coalesce("name", F.lit("")), "text": F.coalesce("text", F.lit("")),
        "hidden": F.coalesce("hidden", F.lit(False)) | F.coalesce(F.col("role") == "system", F.lit(False)), "swipe_id": F.coalesce("swipe_id", F.lit(0)), "boundary_hint": F.col("boundary_hint"), "send_date": F.col("send_date"), "n_tokens": tokens(F.col("text")),
    }
    wanted = [c for c in made if not columns or c in columns]
    usable = messages.where("chat_id is not null and message_index is not null").select("chat_id", "message_index", "ingested_at", "message_id", *(made[c].alias(c) for c in wanted))
    best = F.max(F.struct("ingested_at", "message_id", *wanted)).alias("m")
    return usable.groupBy("chat_id", "message_index").agg(best).select("chat_id", "message_index", "m.message_id", *(F.col(f"m.{c}").alias(c) for c in wanted))


def policy_filter(messages: DataFrame, include_hidden: bool = False, include_system: bool = False, include_user: bool = True, include_assistant: bool = True) -> DataFrame:
    """The messages a policy takes in; being hidden is tested first."""
    roles = [r for r, on in (("system", include_system), ("user", include_user), ("assistant", include_assistant)) if on]
    shown = messages if include_hidden else messages.where(~F.col("hidden"))
    return shown.where(F.col("role").isin(roles))


def with_bundles(messages: DataFrame) -> DataFrame:
    """Adds bundle_no (from 0): a bundle ends before a user's message once an assistant has answered a user in it.

    Closed form of the walk: a break is a user's row before which the last assistant's row comes after the last user's row, both existing.
    """
    m = messages.withColumn("__u", F.when(F.col("role") == "user", F.col("message_index"))).withColumn("__a", F.when(F.col("role") == "assistant", F.col("message_index")))
    seen = running(m, ["chat_id"], "message_index", [("max", "__u", "__lu"), ("max", "__a", "__la")])
    broken = seen.withColumn("__brk", ((F.col("role") == "user") & F.coalesce(F.col("__la") > F.col("__lu"), F.lit(False))).cast("int"))
    numbered = running(broken, ["chat_id"], "message_index", [("sum", "__brk", "bundle_no")], inclusive=True)
    return numbered.drop("__u", "__a", "__lu", "__la", "__brk")


def turn_bundles(messages: DataFrame) -> DataFrame:
    """One row per bundle: chat_id, bundle_no, first_index, last_index, n_messages, n_tokens, kind, complete.

    kind: opening (no user), exchange (an assistant after the first user), incomplete_user.
    """
    first_user = F.min(F.when(F.col("role") == "user", F.col("message_index")))
    last_assistant = F.max(F.when(F.col("role") == "assistant", F.col("message_index")))
    kind = F.when(first_user.isNull(), "opening").when(last_assistant > first_user, "exchange").otherwise("incomplete_user")
    rows = with_bundles(messages).groupBy("chat_id", "bundle_no").agg(F.min("message_index").alias("first_index"), F.max("message_index").alias("last_index"), F.count("*").alias("n_messages"), F.sum("n_tokens").alias("n_tokens"), kind.alias("kind"))
    return rows.withColumn("complete", F.col("kind") != "incomplete_user")


def bundle_hashes(messages: DataFrame) -> DataFrame:
    """chat_id, bundle_no, first_index, last_index, exact_hash, narrative_hash of every bundle.

    The exact hash covers index, role, name, text, hidden flag and swipe of its messages; the narrative hash their `narrative_form`. A
    digest of each message, which holds its index, is cut in two numbers of 52 bits; their sums over the bundle make its hash, so that a bundle of any length is never gathered.
    """
    sep = F.lit("\x1f")
    index = F.col("message_index").cast("string")
    exact = F.md5(F.concat_ws("\x1f", index, "role", "name", "text", F.col("hidden").cast("string"), F.col("swipe_id").cast("string")))
    story = F.md5(F.concat(index, sep, F.col("role"), sep, narrative_form(F.col("name")), sep, narrative_form(F.col("text"))))
    rows = with_bundles(messages.withColumn("__e", exact).withColumn("__n", story).select("chat_id", "message_index", "role", "__e", "__n"))
    half = lambda c, at: F.sum(F.conv(F.substring(c, at, 13), 16, 10).cast("decimal(20,0)")).cast("string")
    digest = lambda c: F.md5(F.concat_ws("-", half(c, 1), half(c, 14)))
    return rows.groupBy("chat_id", "bundle_no").agg(F.min("message_index").alias("first_index"), F.max("message_index").alias("last_index"), digest("__e").alias("exact_hash"), digest("__n").alias("narrative_hash"))


def bundle_integrity(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """chat_id, exact_changed, narrative_changed, cosmetic_only: bundles of two states of the chats compared place by place."""
    keys = ["chat_id", "bundle_no"]
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("first_index", "last_index", "exact_hash", "narrative_hash")))
    both = side(expected, "e").join(side(actual, "a"), keys, "full")
    same = lambda *cs: [F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")) for c in cs]
    here = same("first_index", "last_index")
    exact = ~(here[0] & here[1] & same("exact_hash")[0])
    story = ~(here[0] & here[1] & same("narrative_hash")[0])
    out = both.groupBy("chat_id").agg(F.sum(exact.cast("int")).alias("exact_changed"), F.sum(story.cast("int")).alias("narrative_changed"))
    return out.withColumn("cosmetic_only", (F.col("exact_changed") > 0) & (F.col("narrative_changed") == 0))


def raw_foreground(messages: DataFrame, budget: int) -> DataFrame:
    """The messages kept raw: chat_id, message_index, n_tokens, required.

    The suffix from the latest user's message (else the last message) is required; before it messages are taken
    backwards while the sum stays within the budget and end at the first that doesn't fit.
    `messages`: already filtered by policy.
    """
    last_user = F.max(F.when(F.col("role") == "user", F.col("message_index")))
    forced = messages.groupBy("chat_id").agg(F.coalesce(last_user, F.max("message_index")).alias("__forced"))
    slim = messages.select("chat_id", "message_index", "n_tokens").withColumn("__back", -F.col("message_index"))
    summed = running(slim, ["chat_id"], "__back", [("sum", "n_tokens", "__sum")], inclusive=True)
    placed = summed.join(forced, "chat_id").withColumn("required", F.col("message_index") >= F.col("__forced"))
    return placed.where(F.col("required") | (F.col("__sum") <= budget)).select("chat_id", "message_index", "n_tokens", "required")


def foreground_summary(foreground: DataFrame, budget: int) -> DataFrame:
    """Per chat: first_index, last_index, n_messages, total_tokens, overflow_tokens, reason."""
    rows = foreground.groupBy("chat_id").agg(F.min("message_index").alias("first_index"), F.max("message_index").alias("last_index"), F.count("*").alias("n_messages"), F.sum("n_tokens").alias("total_tokens"))
    over = F.greatest(F.lit(0).cast("bigint"), F.col("total_tokens") - budget)
    return rows.withColumn("overflow_tokens", over).withColumn("reason", F.when(F.col("overflow_tokens") > 0, "required_current_turn_exceeds_budget").otherwise("within_budget"))


def compaction_frontier(messages: DataFrame, summary: DataFrame, budget: int, ratio: float = 0.85) -> DataFrame:
    """Per chat: eligible_through, eligible_messages, eligible_tokens, utilization, should_schedule. `summary`: of the raw foreground; a chat without one has all of its messages eligible."""
    joined = messages.select("chat_id", "message_index", "n_tokens").join(summary.select("chat_id", "first_index", "total_tokens"), "chat_id", "left")
    eligible = F.col("first_index").isNull() | (F.col("message_index") < F.col("first_index"))
    rows = joined.groupBy("chat_id").agg(
        F.coalesce(F.max("first_index") - 1, F.max("message_index")).alias("eligible_through"), F.sum(eligible.cast("bigint")).alias("eligible_messages"),
        F.sum(F.when(eligible, F.col("n_tokens")).otherwise(0)).alias("eligible_tokens"), (F.coalesce(F.max("total_tokens"), F.lit(0)) / F.lit(float(budget))).alias("utilization"),
    )
    return rows.withColumn("should_schedule", (F.col("eligible_messages") > 0) & (F.col("utilization") >= ratio))


def covered_indices(segments: DataFrame) -> DataFrame:
    """(chat_id, message_index), once for each segment that covers the index: ranges opened, so that joins with messages are equi-joins."""
    ranges = segments.where("chat_id is not null and first_index is not null and last_index is not null and first_index <= last_index")
    return ranges.select("chat_id", F.explode(F.sequence("first_index", "last_index")).alias("message_index"))


def segment_coverage(segments: DataFrame, messages: DataFrame) -> DataFrame:
    """Per chat: n_duplicate, n_missing, n_unexpected indices, ok."""
    covered = covered_indices(segments).groupBy("chat_id", "message_index").agg(F.count("*").alias("times"))
    both = covered.join(messages.select("chat_id", "message_index", F.lit(1).alias("there")), ["chat_id", "message_index"], "full")
    count = lambda c: F.sum(c.cast("bigint"))
    rows = both.groupBy("chat_id").agg(
        count(F.coalesce(F.col("times") > 1, F.lit(False))).alias("n_duplicate"), count(F.col("times").isNull()).alias("n_missing"), count(F.col("there").isNull()).alias("n_unexpected")
    )
    return rows.withColumn("ok", (F.col("n_duplicate") == 0) & (F.col("n_missing") == 0) & (F.col("n_unexpected") == 0))


def uncovered_islands(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """Runs of neighbouring messages that no segment covers: chat_id, first_index, last_index, n_messages, n_tokens.

    Neighbours are messages with nothing but each other between them in the chat, covered messages breaking a run.
    """
    taken = covered_indices(segments).distinct().withColumn("taken", F.lit(1))
    marked = messages.select("chat_id", "message_index", "n_tokens").join(taken, ["chat_id", "message_index"], "left").withColumn("__c", F.coalesce("taken", F.lit(0)))
    numbered = running(marked, ["chat_id"], "message_index", [("sum", "__c", "__island")])
    open_rows = numbered.where("taken is null")
    return open_rows.groupBy("chat_id", "__island").agg(F.min("message_index").alias("first_index"), F.max("message_index").alias("last_index"), F.count("*").alias("n_messages"), F.sum("n_tokens").alias("n_tokens")).drop("__island")


def uncovered_messages(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """The messages that no segment covers, with the `island` they are in; see `uncovered_islands`."""
    taken = covered_indices(segments).distinct().withColumn("taken", F.lit(1))
    marked = messages.join(taken, ["chat_id", "message_index"], "left").withColumn("__c", F.coalesce("taken", F.lit(0)))
    return running(marked, ["chat_id"], "message_index", [("sum", "__c", "island")]).where("taken is null").drop("taken", "__c")


def timeline_page(segments: DataFrame, page: int, size: int = 10) -> DataFrame:
    """A page (from 1, clamped to those there are) of every chat's segments by first index and id: chat_id, page, pages, segment_id, first_index."""
    order = Window.partitionBy("chat_id").orderBy("first_index", "segment_id")
    numbered = segments.select("chat_id", "segment_id", "first_index").withColumn("__n", F.row_number().over(order))
    pages = segments.groupBy("chat_id").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("pages"))
    at = F.greatest(F.lit(1), F.least(F.lit(page), F.col("pages")))
    return numbered.join(pages, "chat_id").withColumn("page", at).where(F.ceil(F.col("__n") / size) == F.col("page")).select("chat_id", "page", "pages", "segment_id", "first_index")


def token_audit(messages: DataFrame) -> DataFrame:
    """message_id, stored, counted, status of the stored token counts: cached (right), stale (wrong) or missing."""
    counted = tokens(F.col("text"))
    status = F.when(F.col("token_count").isNull(), "missing").when(F.col("token_count") == counted, "cached").otherwise("stale")
    return messages.select("message_id", F.col("token_count").cast("bigint").alias("stored"), counted.alias("counted"), status.alias("status"))
