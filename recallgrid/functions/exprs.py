"""Column expressions shared by the operators."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Of the 64-bit FNV-1a hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _accents() -> tuple[str, str]:
    """Accented letters below U+1E00 and in Latin Extended Additional with the ASCII letter each decomposes to, by rule."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(code).lower())
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(c) for c in base[1:]):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, BASES = _accents()

def tokens(text: Column) -> Column:
    """The nominal token count of a text: a quarter of its characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(text) / F.lit(4)).cast("bigint"), F.lit(0).cast("bigint"))


def normalize_alias(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, one blank apart, accents dropped."""
    bare = F.regexp_replace(F.translate(F.lower(text), ACCENTED, BASES), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def search_tokens(text: Column) -> Column:
    """The words of a text that count for search: of two letters or more."""
    return F.filter(F.split(normalize_alias(text), " "), lambda x: F.length(x) > 1)


def narrative_form(text: Column) -> Column:
    """A text as far as it matters to the story: line ends unified, blanks at line ends and around the text dropped."""
    unified = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "(?m)[ \t]+$", "")
    return F.regexp_replace(unified, r"^\s+|\s+$", "")


def fnv_of(texts: list[bytes | None]) -> list[str | None]:
    """64-bit FNV-1a hashes as 16 hexadecimal digits: all texts of a batch one byte at a time, long ones by themselves."""
    sizes = np.array([len(x) if x is not None and len(x) <= 4096 else 0 for x in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    width = int(sizes.max(initial=0))
    table = np.zeros((width, len(texts)), np.uint64)
    for column, i in enumerate(order):
        if sizes[i]:
            table[: sizes[i], column] = np.frombuffer(texts[i], np.uint8)
    h = np.full(len(texts), FNV_START, np.uint64)
    active = np.searchsorted(-sizes[order], -np.arange(width), "left")  # texts longer than a place, at the front
    with np.errstate(over="ignore"):
        for at in range(width):
            n = active[at]
            h[:n] = (h[:n] ^ table[at, :n]) * np.uint64(FNV_PRIME)
    out: list[str | None] = [None] * len(texts)
    for column, i in enumerate(order):
        text = texts[i]
        if text is not None:
            value = int(h[column])
            if len(text) > 4096:
                value = FNV_START
                for byte in text:
                    value = (value ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
            out[i] = f"{value:016x}"
    return out


@F.pandas_udf(StringType())
def _fnv(texts: pd.Series) -> pd.Series:
    values = [None if x is None else x.encode() for x in texts.tolist()]
    return pd.Series([h for at in range(0, len(values), 2048) for h in fnv_of(values[at : at + 2048])], dtype=object)


def fnv1a64(text: Column) -> Column:
    """The 64-bit FNV-1a hash of the UTF-8 bytes as 16 hexadecimal digits; null for null. By Arrow batches: folding bytes with SQL functions is interpreted and some fifty times slower."""
    return _fnv(text)


def entity_id(seed: Column) -> Column:
    return F.concat(F.lit("ent_"), fnv1a64(F.concat(F.lit("entity:v1:"), seed)))


def fingerprint(namespace: str, json_text: Column) -> Column:
    """The fingerprint of a value given as JSON text with sorted keys."""
    return F.concat(F.lit("fp1_"), fnv1a64(F.concat(F.lit(f"{namespace}:v1:"), json_text)))


def half_up(x: Column) -> Column:
    """Rounding of halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
