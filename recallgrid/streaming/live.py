"""Chats as streams: bundles kept up per chat, and per-batch upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "chat_id string, message_index int, role string, n_tokens bigint, sent timestamp"
BUNDLE = "chat_id string, kind string, first_index int, last_index int, n_messages int, n_tokens bigint"
_COLUMNS = [c.split()[0] for c in BUNDLE.split(", ")]
#: Milliseconds after which a chat without messages is taken as ended for now.
IDLE_MS = 6 * 3600 * 1000
STATE = "last int, first int, saw_user boolean, saw_assistant boolean, n_messages int, n_tokens bigint, kind string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = IDLE_MS) -> Iterator[pd.DataFrame]:
    """Feeds a chat's new messages, in order, to its open bundle. Emits bundles as they close, and `edit` rows for messages at or before the last one seen.

    A chat that stayed idle has its open bundle emitted and its state dropped.
    """
    if state.hasTimedOut:
        last, first, user, assistant, n, tokens, _ = state.get
        kind = "opening" if not user else "exchange" if assistant else "incomplete_user"
        state.remove()
        yield pd.DataFrame([(key[0], kind, first, last, n, tokens)] if n else [], columns=_COLUMNS)
        return
    rows = pd.concat(list(batches)).sort_values("message_index")
    last, first, user, assistant, n, tokens, _ = state.get if state.exists else (-1, -1, False, False, 0, 0, "")
    out = []
    for index, role, size in zip(rows["message_index"].tolist(), rows["role"].tolist(), rows["n_tokens"].tolist()):
        if index <= last:
            out.append((key[0], "edit", index, index, 1, size))
            continue
        if n and role == "user" and user and assistant:
            out.append((key[0], "exchange", first, last, n, tokens))
            user = assistant = False
            n = tokens = 0
        first = index if n == 0 else first
        user = user or role == "user"
        assistant = assistant or (role == "assistant" and user)
        last, n, tokens = index, n + 1, tokens + int(size or 0)
    state.update((last, first, user, assistant, n, tokens, ""))
    if idle_ms is not None:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(out, columns=_COLUMNS)


def live_bundles(messages: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Closed turn bundles of a stream of messages, and `edit` rows for indices already seen, which are for invalidation.

    State of a chat: where its open bundle began and what it has seen; seven values, dropped, with the open bundle emitted, once the chat was idle for `idle_ms`. Messages after that open a new bundle, whatever their index.
    Without `idle_ms` nothing times out: for queries that read what is there and end, which a timeout would keep alive.
    messages: chat_id, message_index, role, n_tokens.
    """
    slim = messages.select("chat_id", "message_index", "role", F.col("n_tokens").cast("bigint").alias("n_tokens"))

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _advance(key, batches, state, idle_ms)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return slim.groupBy("chat_id").applyInPandasWithState(advance, BUNDLE, STATE, "append", timeout)


def spend_by_window(ledger: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, n_requests, total_tokens of a stream of ledger rows (ts, total_tokens), rows later than `late` left out."""
    w = ledger.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n_requests"), F.sum("total_tokens").alias("total_tokens"))
    return w.select(F.col("w.start").alias("start"), "n_requests", "total_tokens")


def due_chats(progress: DataFrame, batch: DataFrame, every: int = 5) -> tuple[DataFrame, DataFrame]:
    """For a batch of new messages: the chats that have `every` unhandled messages now (chat_id), and the progress to store (chat_id, n_new).

    progress: chat_id, n_new as stored after the batch before.
    """
    counted = progress.select("chat_id", "n_new").unionByName(batch.groupBy("chat_id").agg(F.count("*").alias("n_new"))).groupBy("chat_id").agg(F.sum("n_new").alias("n_new"))
    return counted.where(F.col("n_new") >= every).select("chat_id"), counted.withColumn("n_new", F.when(F.col("n_new") >= every, 0).otherwise(F.col("n_new")))


def upsert_batch(path: str, key: str, order: list[str]):
    """A function for foreachBatch that keeps the newest row of each key in the table published below `path`.

    Each batch writes a new version of the table; for tables too large for that, give every partition of keys a path of its own.
    """
    from ..sources.sinks import current, exists, publish

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = current(batch.sparkSession, path).unionByName(batch) if exists(batch.sparkSession, path) else batch
        columns = [c for c in rows.columns if c != key]
        best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("m")).select(key, "m.*")
        publish(best, path)

    return handle
