"""Encoding a corpus with a public byte-level BPE, by a tree reduction whose joins re-encode only a window."""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Fixed value: the pre-tokenizer's pattern that belongs to the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Most bytes of a rank file: it is read by the driver and broadcast.
MOST_RANK_BYTES = 64 << 20
#: Characters that a leaf of the tree holds at most; a parameter of the operators.
LEAF_CHARS = 512


def _built(name: str, content: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def encoding(ranks_path: str = RANKS):
    """The tokenizer of a rank file, once per process. Special tokens: none."""
    return _built(Path(ranks_path).stem, Path(ranks_path).read_bytes())


_SHIPPED: dict = {}


def _shipped_encoding(ranks: Broadcast):
    """The tokenizer whose rank file the driver broadcast, built once per worker process."""
    content = ranks.value
    key = hash(content)
    if key not in _SHIPPED:
        _SHIPPED.clear()
        _SHIPPED[key] = _built("shipped", content)
    return _SHIPPED[key]


def _ranks(df: DataFrame, ranks_path: str) -> Broadcast:
    """The rank file, read by the driver, so that executors need no copy of it."""
    content = Path(ranks_path).read_bytes()
    if len(content) > MOST_RANK_BYTES:
        raise ValueError(f"{ranks_path}: more than {MOST_RANK_BYTES} bytes, too many to broadcast")
    return df.sparkSession.sparkContext.broadcast(content)


def _kind(c: str) -> str:
    category = unicodedata.category(c)
    if c in " \t\r\n":
        return "S"
    if c.isspace() or category in ("Cn", "Zs", "Zl", "Zp"):
        return "?"  # read differently by different Unicode versions or libraries: no boundary is claimed here
    return category[0] if category[0] in "LN" else "P"


def is_hard(text: str, p: int) -> bool:
    """Whether the pre-tokenizer splits before `text[p]` whatever else surrounds it.

    No alternative of the pattern runs on from a visible character to white space, nor from one of the classes
    letter, number, other to another, but for contractions, which start with an apostrophe. White space before a
    visible character is no such place.
    """
    a, b = _kind(text[p - 1]), _kind(text[p])
    if a in "S?" or b == "?":
        return False
    return a != b and text[p - 1] != "'"


def _boundary(text: str, start: int, stop: int, step: int) -> int | None:
    return next((p for p in range(start, stop, step) if is_hard(text, p)), None)


def _join(enc, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
    """The ids of text[lo:hi] from those of its halves: a window around `mid` is encoded again, between two hard boundaries."""
    if hi == mid or lo == mid:
        return left + right
    if is_hard(text, mid):
        return left + right
    width, a, b = 32, None, None
    while a is None or b is None:
        if a is None:
            a = lo if mid - width <= lo else _boundary(text, mid - width, max(lo, mid - 2 * width), -1)
        if b is None:
            b = hi if mid + width >= hi else _boundary(text, mid + width, min(hi, mid + 2 * width), 1)
        width *= 2
    keep, size = len(left), len(text[a:mid].encode())
    while size > 0:
        keep -= 1
        size -= len(enc.decode_single_token_bytes(left[keep]))
    skip, rest = 0, len(text[mid:b].encode())
    while rest > 0:
        rest -= len(enc.decode_single_token_bytes(right[skip]))
        skip += 1
    if size or rest:
        raise AssertionError("a hard boundary lies inside a token")
    return left[:keep] + enc.encode_ordinary(text[a:b]) + right[skip:]


def encode_tree(text: str, enc=None, leaf: int = LEAF_CHARS) -> list[int]:
    """The ids of a text: halves are encoded by themselves and joined, so no step sees more than a leaf and a window.

    Equal to encoding the text at once: outside a join's window the tokens end at hard boundaries (`is_hard`), which
    no neighbour can move. A text is halved in its middle, or, where the middle lies in a run longer than a leaf without any such boundary (one class of characters throughout), at an end of
    that run; such a run is encoded once, as a whole. Texts of up to `leaf` characters are leaves.
    """
    enc = enc or encoding()

    def reduce(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return enc.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        if _boundary(text, mid, max(lo, mid - leaf), -1) is None or _boundary(text, mid, min(hi, mid + leaf), 1) is None:
            before, after = _boundary(text, mid, lo, -1), _boundary(text, mid, hi, 1)
            if before is None and after is None:
                return enc.encode_ordinary(text[lo:hi])
            mid = before if after is None or (before is not None and mid - before <= after - mid) else after
        return _join(enc, text, lo, mid, hi, reduce(lo, mid), reduce(mid, hi))

    return reduce(0, len(text))


def decode_tree(ids: list[int], enc=None) -> str:
    """The text of ids: bytes of halves are concatenated up the tree and decoded once at its root."""
    enc = enc or encoding()

    def reduce(lo: int, hi: int) -> bytes:
        if hi - lo <= LEAF_CHARS:
            return enc.decode_bytes(ids[lo:hi])
        mid = (lo + hi) // 2
        return reduce(lo, mid) + reduce(mid, hi)

    return reduce(0, len(ids)).decode(errors="replace")


def _slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of a column of about `chars` characters, so that a batch's ids don't pile up."""
    at, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append(text.as_py())
        size += len(part[-1] or "")
        if size >= chars:
            yield at, part
            at, part, size = i + 1, [], 0
    if part:
        yield at, part


def _encoder(ranks: Broadcast, keep: list[str], text: str, counts: bool, leaf: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _shipped_encoding(ranks)
        for batch in batches:
            for at, part in _slices(batch.column(text), 4_000_000):
                found = [encode_tree(x, enc, leaf) if x else [] for x in part]
                if counts:
                    made = pa.array([len(x) for x in found], pa.int64())
                else:
                    offsets = [0]
                    for x in found:
                        offsets.append(offsets[-1] + len(x))
                    made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([i for x in found for i in x], pa.int32()))
                kept = [batch.column(k).slice(at, len(part)) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, made], [*keep, "made"])

    return run


def _mapped(df: DataFrame, keep: list[str], text: str, out: str, kind: str, ranks_path: str, leaf: int) -> DataFrame:
    types = dict(df.dtypes)
    columns = df.select(*dict.fromkeys([*keep, text]))
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), f"made {kind}"])
    return columns.mapInArrow(_encoder(_ranks(df, ranks_path), keep, text, kind == "bigint", leaf), schema).withColumnRenamed("made", out)


def encode_corpus(df: DataFrame, keep: list[str], text: str = "text", ranks_path: str = RANKS, leaf: int = LEAF_CHARS) -> DataFrame:
    """`keep` and ids (array<int>): the ids of every text, without special tokens; their markers are ordinary text.

    An empty and a null text give an empty list. Every row is kept, repeated rows too. Narrow: one pass, no shuffle;
    texts of any length go through `encode_tree` with leaves of `leaf` characters. The rank file is read by the driver and broadcast. Other columns are ignored. A table stored in few splits is best spread
    by the caller (`functions.runtime.spread`).
    """
    return _mapped(df, keep, text, "ids", "array<int>", ranks_path, leaf)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", ranks_path: str = RANKS, leaf: int = LEAF_CHARS) -> DataFrame:
    """`keep` and n_tokens (bigint): the number of ids `encode_corpus` gives, 0 for empty and null texts."""
    return _mapped(df, keep, text, "n_tokens", "bigint", ranks_path, leaf)


def decode_corpus(df: DataFrame, keep: list[str], ids: str = "ids", ranks_path: str = RANKS) -> DataFrame:
    """`keep` and text: the texts of ids; a null list and an empty list give an empty text."""

    shipped = _ranks(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _shipped_encoding(shipped)
        for batch in batches:
            texts = [decode_tree(x, enc) if x else "" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], [*keep, "made"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "made string"])
    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema).withColumnRenamed("made", "text")
