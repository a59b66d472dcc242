import itertools
import json
import random

import pytest

from recallgrid.operators.changefeed import apply_changes, flatten_object

SCHEMA = "chat_id string, change_seq bigint, revision int, subject string, path string, operation string, value string, batch int, tomb boolean"
LIST = [("state_operation", "add", ["insert"]), ("state_operation", "remove", ["delete", "drop"]), ("state_operation", "set", None), ("other", "remove", ["zap"]), (None, None, None)]


def run(spark, rows, base=None, batches=3):
    feed = spark.createDataFrame([(*r, 1, True) for r in rows], SCHEMA)
    values = spark.createDataFrame(LIST, "field_name string, canonical string, known_spellings array<string>")
    base = spark.createDataFrame(base, "chat_id string, subject string, path string, value string, seq int") if base is not None else None
    return sorted((tuple(r) for r in apply_changes(feed, values, base, batches).collect()), key=str)


def brute(rows, base=()):
    """The changes applied one by one to a dictionary."""
    state = {(c, s, ".".join(x.strip() for x in p.split(".") if x.strip())): v for c, s, p, v, *_ in base}
    best = {}
    for c, q, rev, s, p, o, v in rows:
        path = ".".join(x.strip() for x in (p or "").split(".") if x.strip())
        if q is None or s is None or p is None or not path:
            continue
        key = (-1 << 31 if rev is None else rev, s, path, (o or "").strip().lower(), v or "")
        if (c, q) not in best or key > best[c, q][0]:
            best[c, q] = (key, (s, path, (o or "").strip().lower(), v))
    for (c, _), (_, (s, path, o, v)) in sorted(best.items(), key=lambda kv: (str(kv[0][0]), kv[0][1])):
        def clear():
            for k in [k for k in state if k[0] == c and k[1] == s and (k[2] == path or k[2].startswith(path + "."))]:
                del state[k]
        if o in ("remove", "delete", "drop"):
            clear()
        elif (leaves := flatten_object(v)) is not None:
            clear()
            for leaf in leaves:
                state[c, s, ".".join(x for x in (path, leaf["tail"]) if x)] = leaf["value"]
        else:
            state[c, s, path] = v
    return sorted((c, s, p, v) for (c, s, p), v in state.items())


@pytest.mark.parametrize("seed,batches", list(itertools.product(range(4), (1, 3))))
def test_equal_to_applying_one_by_one(spark, seed, batches):
    r = random.Random(seed)
    paths = ["a", "a.b", "a.b.c", "a . b", ".a.bb", "d", "d..e", "ab"]
    values = ['"x"', "1", "true", "{}", '{"b": 2}', '{"b": {"c": "y", "k": {}}, "e": [1, {"z": 2}]}', '{"broken', None]
    rows = [(r.choice(["c1", "c2"]), r.choice([None, *range(60)]) if r.random() < 0.05 else r.randrange(60), r.choice([0, 0, 1, None]), r.choice(["s1", "s2", None]), r.choice([*paths, None, " . "]), r.choice(["add", " Remove", "DELETE", "drop", "zap", None]), r.choice(values)) for _ in range(150)]
    rows += rows[:20]
    r.shuffle(rows)
    base = [("c1", "s1", "a.b.q", '"old"', 1), ("c1", "s2", "d", "7", 1), ("c3", "s1", "a", "8", 1)]
    assert run(spark, rows, base, batches) == brute(rows, base)


def test_stated_cases(spark):
    assert run(spark, [("c", 1, 0, "s", "p", "set", '{"a": {"b": 1}}'), ("c", 2, 0, "s", "p.a", "set", "5")]) == [("c", "s", "p.a", "5"), ("c", "s", "p.a.b", "1")]
    assert run(spark, [("c", 2, 0, "s", "p", "remove", '"x"'), ("c", 1, 0, "s", "p.a", "set", "5")]) == []
    assert run(spark, [("c", 1, 0, "s", "p", "set", "1"), ("c", 1, 1, "s", "q", "set", "2")]) == [("c", "s", "q", "2")]
    assert run(spark, [("c", 1, 0, "s", "p", "set", None)]) == [("c", "s", "p", None)]
    assert run(spark, [(None, 1, 0, "s", "p", "set", "1")]) == [(None, "s", "p", "1")]


def test_empty_feed(spark):
    assert run(spark, []) == []
    assert run(spark, [], [("c", "s", "p", "1", 1)]) == [("c", "s", "p", "1")]


def test_flatten_keeps_numbers_and_long_texts():
    assert flatten_object('{"a": 1.50, "b.c": "é", "d": [1, "x"], "e": {}}') == [{"tail": "a", "value": "1.50"}, {"tail": "b.c", "value": '"é"'}, {"tail": "d", "value": '[1, "x"]'}]
    assert flatten_object("[1]") is None and flatten_object("{bad") is None and flatten_object(None) is None
    assert flatten_object(json.dumps({"a": "x" * 1_000_000}))[0]["value"] == '"' + "x" * 1_000_000 + '"'
    assert flatten_object('{"a":' * 100_000) is None
