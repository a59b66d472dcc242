import random

import pytest

from recallgrid.llm.splitting import HINTS, oversized, split_runs, split_texts


def check_pieces(text, pieces, limit, overlap):
    back = overlap * 4
    assert pieces[0][1] == 0 and pieces[-1][2] == len(text)
    for no, (piece_no, start, end, tokens, piece) in enumerate(pieces):
        assert piece_no == no and text[start:end] == piece and tokens == -(-len(piece) // 4) <= limit
        if no:
            assert pieces[no - 1][2] - start == back
    fresh = "".join(p[4][(back if i else 0) :] for i, p in enumerate(pieces))
    assert fresh == text


@pytest.mark.parametrize("seed", range(4))
def test_pieces_cover_the_text(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(["word ", "a", "end. ", "stop!\n", "\n\n", ", ", "é", "漢字", "👩‍🚀"]) for _ in range(r.randint(0, 3000))) for _ in range(12)] + ["x" * 20_000, "y" * 3600, "y" * 3601, " " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for row in split_texts(df, ["id"]).orderBy("id", "piece_no").collect():
        got.setdefault(row["id"], []).append((row["piece_no"], row["start_pos"], row["end_pos"], row["n_tokens"], row["text"]))
    for i, text in enumerate(texts):
        check_pieces(text, got[i], 900, 60)
        assert (len(got[i]) > 1) == (len(text) > 3600)
    assert sorted(r["id"] for r in oversized(df, "id").collect()) == [i for i, t in enumerate(texts) if len(t) > 3600]


def test_boundaries_by_strength(spark):
    text = "a" * 2000 + ". " + "b" * 900 + "\n\n" + "c" * 300 + ". " + "d" * 3000
    first = split_texts(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).where("piece_no = 0").first()
    assert first["boundary"] == "paragraph" and first["end_pos"] == 2000 + 2 + 900 + 2
    text = "a" * 2000 + ". " + "b" * 5000
    first = split_texts(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).where("piece_no = 0").first()
    assert first["boundary"] == "sentence" and first["end_pos"] == 2002


def test_nulls_repeats_clashes_and_empty_tables(spark, as_rows):
    df = spark.createDataFrame([(1, None, 7), (2, "", 8), (2, "", 8), (3, "x" * 4000, 9)], "id int, text string, piece_no int")
    assert as_rows(split_texts(df, ["id"]), "id", "n_pieces", "piece_no") == [(2, 1, 0), (2, 1, 0), (3, 2, 0), (3, 2, 1)]
    assert split_texts(df.limit(0), ["id"]).count() == 0


MESSAGES = "message_id bigint, chat_id string, message_index int, text string, boundary_hint string, ingested_at timestamp_ntz, block int"


def test_runs_cover_every_chat_above_the_limit(spark):
    import datetime as dt

    r = random.Random(5)
    t = dt.datetime(2024, 1, 1)
    rows, want = [], {}
    for chat, n in (("big", 900), ("small", 3), ("mid", 60)):
        for i in range(n):
            text = " ".join(r.choice(["alpha", "beta.", "gamma,"]) for _ in range(r.choice([0, 5, 40, 900 if r.random() < 0.02 else 60])))
            rows.append((len(rows), chat, i, text, r.choice([None, "scene", '["time","chapter"]', "beat"]), t, 1))
            want.setdefault(chat, []).append(text)
    rows.append((9999, "big", 5, "late copy", None, t + dt.timedelta(days=1), 1))
    want["big"][5] = "late copy"
    rows += [(10000, None, 1, "x" * 9000, None, t, 1), (10001, "big", None, "y", None, t, 1), (10002, "gone", 1, None, None, None, 1)]
    got = {}
    for p in split_runs(spark.createDataFrame(rows, MESSAGES), block_pieces=4).orderBy("chat_id", "start_pos").collect():
        got.setdefault(p["chat_id"], []).append(p)
    assert set(got) == {"big", "mid"}
    for chat, pieces in got.items():
        whole = "".join(x + "\n" for x in want[chat])
        assert pieces[0]["start_pos"] == 0 and pieces[-1]["end_pos"] == len(whole)
        for a, b in zip(pieces, pieces[1:]):
            assert a["end_pos"] - b["start_pos"] == 240
        for p in pieces:
            assert p["text"] == whole[p["start_pos"] : p["end_pos"]] and p["n_tokens"] <= 900
        assert {p["boundary"] for p in pieces} & set(HINTS)
    assert split_runs(spark.createDataFrame([], MESSAGES)).count() == 0


def test_overlap_over_short_messages_and_block_ends_at_the_strongest_hint(spark):
    texts = ["g" * 15_000, "short", "s", "", "h" * 15_000, *(f"message {i} " + "w " * 60 for i in range(200))]
    rows = [(i, "c", i, x, "chapter" if i == 100 else "scene" if i % 7 == 0 else None, None, 1) for i, x in enumerate(texts)]
    pieces = split_runs(spark.createDataFrame(rows, MESSAGES), block_pieces=4).orderBy("start_pos").collect()
    assert all(a["end_pos"] - b["start_pos"] == 240 for a, b in zip(pieces, pieces[1:]))
    whole = "".join(x + "\n" for x in texts)
    assert all(p["text"] == whole[p["start_pos"] : p["end_pos"]] for p in pieces)
    assert len("".join(x + "\n" for x in texts[:101])) in {p["end_pos"] for p in pieces if p["boundary"] == "chapter"}
