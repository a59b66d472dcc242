import json
import os

import pytest
from pyspark.sql import functions as F

from recallgrid.operators.store import content_digest, last_writes
from recallgrid.sources import chatlog, sinks
from recallgrid.streaming import live


def test_chat_log(spark, tmp_path, as_rows):
    lines = [{"user_name": "U", "character_name": "C", "chat_metadata": {"x": 1}}, {"is_user": True, "is_system": False, "name": "U", "mes": "hi"}, {"is_user": False, "is_system": False, "name": "C", "mes": "hello", "swipe_id": 2}, {"is_user": False, "is_system": True, "name": "S", "mes": "note"}]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    headers, messages = chatlog.read_chat_log(spark, str(tmp_path))
    assert [r["chat_id"] for r in headers.collect()] == ["one"]
    assert as_rows(messages, "message_index", "role", "text", "hidden", "swipe_id") == [(0, "user", "hi", False, 0), (1, "assistant", "hello", False, 2), (2, "system", "note", True, 0)]
    before, after = content_digest(messages).first(), content_digest(messages.withColumn("text", F.concat("text", F.lit("!")))).first()
    assert before["n_messages"] == 3 and before["digest"] != after["digest"]


def test_chat_log_with_broken_lines(spark, tmp_path, as_rows):
    good = json.dumps({"is_user": True, "name": "U", "mes": "hi"})
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"user_name": "U"}), good, "{broken", good, "{}"]))
    (tmp_path / "b.jsonl").write_text("\n".join(["{broken header", "", good]))
    (tmp_path / "c.jsonl").write_text("\n".join([good, good]))
    headers, messages = chatlog.read_chat_log(spark, str(tmp_path))
    assert as_rows(headers, "chat_id") == [("a",), ("b",)]
    want = [("a", 0, "user", "hi"), ("a", 1, "assistant", ""), ("a", 2, "user", "hi"), ("a", 3, "assistant", ""), ("b", 0, "user", "hi"), ("c", 0, "user", "hi"), ("c", 1, "user", "hi")]
    assert as_rows(messages, "chat_id", "message_index", "role", "text") == want


def test_chat_log_in_many_splits(spark, tmp_path):
    lines = [json.dumps({"user_name": "U"})] + [json.dumps({"is_user": i % 2 == 0, "mes": f"m{i}" + "x" * (i % 50)}) for i in range(400)]
    (tmp_path / "long.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        headers, messages = chatlog.read_chat_log(spark, str(tmp_path))
        got = {r["message_index"]: r["text"].rstrip("x") for r in messages.collect()}
        assert headers.count() == 1 and got == {i: f"m{i}" for i in range(400)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


class State:
    def __init__(self, value=None, timed_out=False):
        self.get, self.exists, self.hasTimedOut, self.wait = value, value is not None, timed_out, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_idle_chats_emit_their_open_bundle_and_lose_their_state():
    import pandas as pd

    state = State()
    rows = pd.DataFrame({"message_index": [0, 1], "role": ["user", "assistant"], "n_tokens": [3, 4]})
    assert sum(len(x) for x in live._advance(("c",), iter([rows]), state)) == 0 and state.wait == live.IDLE_MS
    ended = State(state.get, timed_out=True)
    assert pd.concat(live._advance(("c",), iter([]), ended)).values.tolist() == [["c", "exchange", 0, 1, 2, 7]] and not ended.exists
    assert sum(len(x) for x in live._advance(("c",), iter([]), State((5, -1, False, False, 0, 0, ""), timed_out=True))) == 0


def test_envelopes_round_trip(spark, as_rows):
    seg = spark.createDataFrame([("c", "s1", 0, 3, "valid", "a \"b\"", True, False), ("c", "s2", 4, 5, "stale", None, None, None)], "chat_id string, segment_id string, first_index int, last_index int, status string, synopsis string, pinned boolean, manually_edited boolean")
    for size, parts in ((10, 1), (1, 2)):
        envelopes = chatlog.to_envelopes(seg, size)
        good, bad = chatlog.from_envelopes(envelopes)
        assert as_rows(good) == as_rows(seg) and bad.count() == 0 and envelopes.count() == parts
    odd = spark.createDataFrame([("c", "{"), ("c", '{"version": 9, "chat_id": "c"}'), ("c", '{"version": 2, "chat_id": "d", "segments": []}'), ("c", '{"version": 1, "chat_id": "c", "summaries": [{"segment_id": "s9"}]}')], "chat_id string, envelope string")
    good, bad = chatlog.from_envelopes(odd)
    assert as_rows(good, "segment_id") == [("s9",)] and as_rows(bad, "error") == [("not JSON",), ("other chat",), ("unknown version",)]
    assert chatlog.diagnostics(seg).columns == ["chat_id", "segment_id", "first_index", "last_index", "status", "pinned", "manually_edited"]


def test_kv_log(spark, tmp_path, as_rows):
    path = str(tmp_path / "kv")
    for key, value, gone in (("a", "1", False), ("a", "2", False), ("b", "1", False), ("b", None, True)):
        (tmp_path / "kv").mkdir(exist_ok=True)
        with open(tmp_path / "kv" / "log.json", "a") as f:
            f.write(json.dumps({"store": "s", "key": key, "value": value, "deleted": gone}) + "\n")
    log = chatlog.read_kv_log(spark, path)
    assert as_rows(last_writes(log, ["store", "key"], "line_no", "value", "deleted")) == [("s", "a", "2")]
    chatlog.write_kv_log(log, str(tmp_path / "copy"))
    assert spark.read.json(str(tmp_path / "copy")).count() == 4


def test_publishing(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.publish(spark.range(3), root)
    old = sinks.current(spark, root)
    sinks.publish(spark.range(5), root)
    assert sinks.current(spark, root).count() == 5 and old.count() == 3
    with pytest.raises(Exception):
        sinks.publish(spark.range(2).select(F.raise_error(F.lit("x")).alias("id")), root)
    assert sinks.current(spark, root).count() == 5
    sinks.append_ledger(spark.range(2).withColumn("day", F.lit("2024-01-01")), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).where("day = '2024-01-01'").count() == 2
    cache = spark.createDataFrame([("f", 7)], "fp string, n int")
    got = sinks.cached_by_fingerprint(spark.createDataFrame([("f",), ("g",)], "fp string"), cache, "fp", "n", F.lit(1))
    assert sorted((r["fp"], r["n"]) for r in got.collect()) == [("f", 7), ("g", 1)]


def stream(spark, tmp_path, name, batches, schema):
    src = tmp_path / name
    src.mkdir()
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # read in this order
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def test_live_bundles(spark, tmp_path, as_rows):
    m = lambda i, role: {"chat_id": "c", "message_index": i, "role": role, "n_tokens": 2}
    s = stream(spark, tmp_path, "in", [[m(0, "user"), m(1, "assistant"), m(2, "user")], [m(1, "user"), m(3, "assistant")], [m(4, "user"), m(5, "user")]], live.MESSAGE)
    q = live.live_bundles(s, idle_ms=None).writeStream.format("memory").queryName("bundles").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert as_rows(spark.table("bundles"), "kind", "first_index", "last_index", "n_messages", "n_tokens") == [("edit", 1, 1, 1, 2), ("exchange", 0, 1, 2, 4), ("exchange", 2, 3, 2, 4)]


def test_spend_and_upserts(spark, tmp_path, as_rows):
    r = lambda k, ts, n: {"k": k, "ts": ts, "total_tokens": n}
    s = stream(spark, tmp_path, "in", [[r("a", "2024-01-01T10:01:00", 5), r("b", "2024-01-01T10:59:00", 6)], [r("a", "2024-01-01T12:00:00", 7)], [r("a", "2024-01-01T12:10:00", 7)], [r("z", "2024-01-01T10:00:00", 99)], [r("b", "2024-01-01T14:00:00", 1)], [r("b", "2024-01-01T14:01:00", 1)]], "k string, ts timestamp, total_tokens bigint")
    q = live.spend_by_window(s).writeStream.format("memory").queryName("spend").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert as_rows(spark.table("spend"), "n_requests", "total_tokens") == [(2, 11), (2, 14)]
    root = str(tmp_path / "table")
    handle = live.upsert_batch(root, "k", ["ts"])
    handle(spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "k string, ts int, n int"), 0)
    handle(spark.createDataFrame([("a", 2, 7), ("b", 0, 9)], "k string, ts int, n int"), 1)
    assert as_rows(sinks.current(spark, root)) == [("a", 2, 7), ("b", 1, 6)]


def test_due_chats(spark, as_rows):
    progress = spark.createDataFrame([("a", 4), ("b", 1)], "chat_id string, n_new bigint")
    due, left = live.due_chats(progress, spark.createDataFrame([("a",), ("b",), ("d",)], "chat_id string"))
    assert as_rows(due) == [("a",)] and as_rows(left) == [("a", 0), ("b", 2), ("d", 1)]
