import random

import pytest

from recallgrid.llm.tokens import count_tokens, decode_corpus, decode_tree, encode_corpus, encode_tree, encoding

BITS = ["a", "b", " ", "\n", "'s", "'", "1", "é", "—", " ", "　", "漢", "\x1c", "  ", "The", " the", "!!", "é", "<|endoftext|>", "👩‍🚀", "͸"]


@pytest.mark.parametrize("leaf", [3, 17, 64])
def test_tree_equals_encoding_at_once(leaf):
    enc, r = encoding(), random.Random(leaf)
    for _ in range(300):
        text = "".join(r.choice(BITS) for _ in range(r.randint(0, 300)))
        ids = encode_tree(text, enc, leaf)
        assert ids == enc.encode_ordinary(text)
        assert decode_tree(ids, enc) == text


def test_long_run_without_a_boundary():
    enc = encoding()
    assert encode_tree("a" * 50_000, enc) == enc.encode_ordinary("a" * 50_000)


def test_same_ids_as_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ("Hello <|endoftext|> world", "Ça va — 漢字 👩‍🚀\r\n\tх", "don't  stop   "):
        assert encode_tree(text) == t.encode(text, add_special_tokens=False).ids


def test_corpus(spark, as_rows):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hi there", 7), (3, "hi there", 7), (None, "x " * 20_000, 8)], "doc_id bigint, text string, ids int")
    ids = encode_corpus(df, ["doc_id"])
    assert dict(ids.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got[1] == [] and got[2] == [] and got[3] == encoding().encode_ordinary("hi there") and len(got[None]) >= 20_000
    assert as_rows(count_tokens(df, ["doc_id"]).where("doc_id is not null")) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert as_rows(decode_corpus(ids, ["doc_id"]).where("doc_id is not null")) == [(1, ""), (2, ""), (3, "hi there"), (3, "hi there")]
    assert encode_corpus(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("leaf", [5, 64])
def test_long_runs_among_other_text(leaf):
    enc, r = encoding(), random.Random(leaf + 100)
    for _ in range(60):
        text = "".join(r.choice(["a" * r.randint(1, 900), " " * r.randint(1, 400), "!?" * r.randint(1, 300), "word ", "1" * 300]) for _ in range(r.randint(1, 8)))
        assert encode_tree(text, enc, leaf) == enc.encode_ordinary(text)


def test_leaf_is_a_parameter_that_changes_no_ids(spark, as_rows):
    df = spark.createDataFrame([(i, "It was the end of " + "a very long tale, " * i) for i in range(60)], "doc_id bigint, text string")
    assert as_rows(encode_corpus(df, ["doc_id"], leaf=8)) == as_rows(encode_corpus(df, ["doc_id"], leaf=100_000))
