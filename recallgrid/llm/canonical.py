"""Mapping free-entered values to the entries of reference lists."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import spread

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһіκοαενρτυχιΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЅЈ", "aeopcyxijsdhikoaevptuxiABEZHIKMNOPTYXABEKMHOPCTYXISJ")

#: A key typed before the value: `kind=exact`, `status: kept`, `domain/family`.
KEY = re.compile(r"^\s*[^\W\d_]{3,20}\s*[:=/]\s*(?=\S)")
#: A remark in brackets at the end of a value.
REMARK = re.compile(r"\s*\([^()]*\)\s*$")
CACHE_ROWS = 500_000


def fold(text: str) -> str:
    """Lower-case ASCII words of a value, one blank apart: look-alike letters, accents, hidden characters, signs and camel case undone."""
    s = unicodedata.normalize("NFKC", text)
    s = "".join(c for c in s if unicodedata.category(c) != "Cf").translate(LOOKALIKES)
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s).casefold()
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", s).strip()


def edits(a: str, b: str, most: int) -> int:
    """Optimal-alignment edit distance (swapped neighbours count once), or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row_before = row, before
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if row_before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, row_before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before = last
    return min(row[-1], most + 1)


def letter_set(word: str) -> int:
    """The set of a word's letters and digits, as bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 127)
    return bits


def allowed(length: int) -> int:
    """Edits that still leave a word of this length recognisable."""
    return 0 if length < 3 else 1 if length < 6 else 2 if length < 12 else 3


@dataclass
class Matcher:
    """One reference list: an automaton over its entries and known spellings, then token-set similarity."""

    spellings: list[tuple[str, str]]  # folded spelling, entry
    foreign: set[str] = field(default_factory=set)  # folded entries and spellings of the other lists only
    cache: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for spelling, entry in self.spellings:
            self.automaton.add_word(f" {spelling} ", (len(spelling), entry))
        self.shapes = [(s, e, [(w, letter_set(w), allowed(len(w))) for w in sorted(s.split(" "), key=len, reverse=True)], s.replace(" ", ""), letter_set(s.replace(" ", ""))) for s, e in self.spellings]
        self.longest = max((len(s.replace(" ", "")) for s, _ in self.spellings), default=0)
        if self.spellings:
            self.automaton.make_automaton()

    def __call__(self, value: str) -> str:
        got = self.cache.get(value)
        if got is None:
            if len(self.cache) >= CACHE_ROWS:
                self.cache.clear()
            got = self.cache[value] = self.find(value)
        return got

    def find(self, value: str) -> str:
        if not self.spellings:
            return ""
        keyless = KEY.sub("", value)
        forms = [w for w in dict.fromkeys((fold(REMARK.sub("", keyless)), fold(keyless), fold(value))) if w]
        for words in forms:
            if words in self.foreign:
                return ""
            if entry := self.embedded(words):
                return entry
        return next((entry for words in forms[:2] if (entry := self.similar(words))), "")

    def embedded(self, words: str) -> str:
        """The entry of the longest mention among the longest, non-overlapping ones; of two equally long, the first."""
        hits = sorted(((stop - length, length, entry) for stop, (length, entry) in self.automaton.iter(f" {words} ")), key=lambda h: (-h[1], h[0]))
        found: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []
        for start, length, entry in hits:
            if all(start + length <= a or start >= b for a, b in taken):
                taken.append((start, start + length))
                found.append((-length, start, entry))
        return min(found)[2] if found else ""

    def similar(self, words: str) -> str:
        """The entry whose spelling agrees best, token by token, in any order; empty below the threshold or on a tie of entries."""
        tokens = words.split(" ")
        bits = [letter_set(t) for t in tokens]
        runs = self.runs(tokens)
        best: dict[str, float] = {}
        for spelling, entry, wanted, target, target_bits in self.shapes:
            score = max(self.token_set(tokens, bits, wanted), self.joined(runs, target, target_bits))
            if score > best.get(entry, 0):
                best[entry] = score
        ranked = sorted(best.items(), key=lambda kv: -kv[1])
        if not ranked or (len(ranked) > 1 and ranked[1][1] >= ranked[0][1]):
            return ""
        return ranked[0][0]

    def runs(self, tokens: list[str]) -> list[tuple[str, int]]:
        """Neighbouring tokens without blanks, as far as they may still match the longest spelling."""
        out = []
        for i in range(len(tokens)):
            run = ""
            for token in tokens[i:]:
                run += token
                if len(run) > self.longest + 3:
                    break
                out.append((run, letter_set(run)))
        return out

    @staticmethod
    def token_set(tokens: list[str], bits: list[int], wanted: list[tuple[str, int, int]]) -> float:
        """Share of the spelling's letters found among the tokens, each within its allowed edits; 0 if a word is missing."""
        free, total, size = list(zip(tokens, bits)), 0, 0
        for w, w_bits, most in wanted:
            near, at = most + 1, -1
            for i, (t, t_bits) in enumerate(free):
                # a letter that only one of the words has costs an edit: too many, and they need not be compared
                if (t_bits & ~w_bits).bit_count() <= most and (w_bits & ~t_bits).bit_count() <= most and (d := edits(t, w, most)) < near:
                    near, at = d, i
            if at < 0 or (near and free[at][0][0].isdigit()):
                return 0.0
            total += len(w) - near
            size += len(w)
            del free[at]
        return total / size

    @staticmethod
    def joined(runs: list[tuple[str, int]], target: str, target_bits: int) -> float:
        """Agreement without blanks, of any run of tokens with the spelling or, if a value breaks off, with its beginning."""
        most, best = allowed(len(target)), 0.0
        for run, bits in runs:
            strange = (bits & ~target_bits).bit_count()
            if strange > most or len(run) > len(target) + most:
                continue
            if (target_bits & ~bits).bit_count() <= most and (d := edits(run, target, most)) <= most:
                best = max(best, 1 - d / len(target))
            if 4 <= len(run) < len(target):
                slack = 0 if len(run) < 6 else 1
                if strange <= slack:
                    d = min(edits(run, target[:k], slack) for k in range(max(1, len(run) - slack), min(len(target), len(run) + slack) + 1))
                    if d <= slack:
                        best = max(best, 0.6 + 0.2 * len(run) / len(target) - 0.1 * d)
        return best


def matchers(rows: list[tuple[str, str, list[str] | None]]) -> dict[str, Matcher]:
    """Matchers by list name from the reference rows (list, entry, known spellings)."""
    lists: dict[str, dict[str, str]] = {}
    for name, entry, known in rows:
        if name is None or entry is None:
            continue
        for s in [entry, *(known or [])]:
            if s and (folded := fold(s)):
                lists.setdefault(name, {}).setdefault(folded, entry)
    return {name: Matcher(list(own.items()), {s for n, other in lists.items() if n != name for s in other} - set(own)) for name, own in lists.items()}


def typed_values(df: DataFrame, field_name: str, row_id: str, value: str) -> DataFrame:
    """(field_name, row_id, pos, value) of a text column (pos 0) or of the entries of an array column."""
    v = F.col(value)
    if dict(df.dtypes)[value].startswith("array"):
        return df.select(F.lit(field_name).alias("field_name"), F.col(row_id).alias("row_id"), F.posexplode(v).alias("pos", "value"))
    return df.select(F.lit(field_name).alias("field_name"), F.col(row_id).alias("row_id"), F.lit(0).alias("pos"), v.alias("value"))


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but white space and invisible characters."""
    return c.isNull() | ~c.rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]")


#: Rows that the reference lists may have: they are read by the driver and travel with the tasks.
MOST_ENTRIES = 100_000


def map_values(values: DataFrame, canonical_values: DataFrame, with_value: bool = False) -> DataFrame:
    """(field_name, row_id, pos, canonical), on request with the value: the entry each typed value means, the empty string if none.

    `values` has field_name, row_id, pos and value. Values that are null, blank or already an entry of their list are
    left out. An automaton over entries and known spellings finds embedded mentions, the longest non-overlapping one
    wins; a value without one goes to token-set similarity. A value spelt exactly like an entry of another list only,
    or as near to two entries, means none. Values of a field without a list mean none. Every row counts, repeated ones too.

    Narrow: no shuffle. The reference lists travel with the tasks; they are a vocabulary kept by hand (here 48 rows),
    read once by the driver, and an error beyond MOST_ENTRIES rows.
    """
    rows = [(r["field_name"], r["canonical"], r["known_spellings"]) for r in canonical_values.select("field_name", "canonical", "known_spellings").limit(MOST_ENTRIES + 1).collect()]
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries in the reference lists")
    exact: dict[str, list[str]] = {}
    for name, entry, _ in rows:
        if name is not None and entry is not None:
            exact.setdefault(name, []).append(entry)
    is_entry = F.lit(False)
    for name, entries in exact.items():
        is_entry = is_entry | ((F.col("field_name") == name) & F.col("value").isin(entries))
    open_values = values.select("field_name", "row_id", "pos", "value").where(~is_blank(F.col("value")) & ~is_entry)
    names_out = ["field_name", "row_id", "pos", *(["value"] if with_value else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matchers(rows)
        none = Matcher([])
        for b in batches:
            names, typed = b.column("field_name").to_pylist(), b.column("value").to_pylist()
            found = [known.get(n, none)(v) for n, v in zip(names, typed)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names_out), pa.array(found, pa.string())], [*names_out, "canonical"])

    types = dict(values.dtypes) | {"pos": "int"}
    return open_values.mapInArrow(run, ", ".join([*(f"{c} {types[c]}" for c in names_out), "canonical string"]))


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """(field_name, value, n): the typed values that mean no entry, with how often they occur. `mapped`: of `map_values` with the values."""
    return mapped.where("canonical = ''").groupBy("field_name", "value").agg(F.count("*").alias("n"))


def all_typed_values(tables: dict[str, DataFrame]) -> DataFrame:
    """The four free-entered fields of the project's tables, spread over the cores."""
    fields = [("commitments", "commitment_transition", "commitment_row_id", "transition"), ("relationship_changes", "relationship_dimension", "rel_change_id", "dimension"), ("temporal_marks", "temporal_kind", "mark_id", "kind"), ("episode_events", "event_domain", "event_row_id", "domains")]
    parts = [typed_values(tables[t], name, row_id, value) for t, name, row_id, value in fields]
    return spread(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
