"""Finding texts that were cut off, and how often each source cuts."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import cut, spread

#: What is put behind a text after a cut, or left there by a reader: taken off before its end is judged.
APPENDED = re.compile(r"(?:(?:```|\[(?:\.{3}|…)\]|\((?:\.{3}|…)\)|…|\.{3,}|\((?:continued|truncated|cont\.|more)\b[^()\n]{0,20}\)?))\Z", re.IGNORECASE)
#: Those that are put behind cut texts only.
CUT_SIGN = re.compile(r"(?:\[(?:\.{3}|…)\]|\((?:\.{3}|…)\)|\((?:continued|truncated|cont\.|more)\b[^()\n]{0,20}\)?)\s*\Z", re.IGNORECASE)
#: Words that close a text.
CLOSING = {"END", "FIN", "ENDE", "FINE", "FIM", "EINDE", "FINIS", "КОНЕЦ", "THE END"}
TERMINAL = re.compile(r"[.!?。！？][\"'”“’»)\]*_]*\Z")
ENDINGS = frozenset(".!?。！？\"'”“’»)]*_")
CLOSED_QUOTE = re.compile(r"[^\W_][”»\"]\Z")
TAG = re.compile(r"^\s*\[([A-Z][A-Z _]*)\]\s*$")
FIELD = re.compile(r"(?:^\s*-\s*|\|\s*)([A-Za-z_]+)\s*=")

#: Log-odds for "cut" that endings carry.
LLR = {
    "json_open": 12.0, "keys_missing": 9.0, "whole_structure": -12.0, "terminal": -7.0, "closing_sign": -6.0, "mid_clause": 6.0, "word": 0.0,
}
CUT_SIGN_LLR = 4.0
#: White space left behind an unfinished word.
TRAIL_LLR = 2.0
SHARE_OF_TYPICAL = 0.5
#: Share of a source's texts that may be longer than its limit (edited later, or with something put behind).
MOST_BEYOND = 0.05
WINDOWS = {"chars": (0, 12), "bytes": (3,)}


def without_appended(text: str) -> str:
    """The text without signs and white space put behind it."""
    while True:
        text = text.rstrip()
        sign = APPENDED.search(text[-48:])
        if not sign:
            return text
        text = text[: len(text) - len(sign.group().lstrip())]


def _unmarked(text: str) -> str:
    """The text without one sign of a cut behind it, white space before the sign kept: what a length limit left over."""
    return re.sub(r"(?: ?\[(?:\.{3}|…)\]|…|\.{3})\Z", "", text)


def _names_of(node: object) -> list[str]:
    """Names at the top of an object, and `name.` for each name at any depth whose last text of several words is a finished sentence."""
    last: dict[str, bool] = {}
    stack: list[tuple[str, object]] = [("", node)]
    while stack:
        name, value = stack.pop()
        if isinstance(value, dict):
            stack.extend(reversed(list(value.items())))
        elif isinstance(value, list):
            stack.extend((name, x) for x in reversed(value))
        elif isinstance(value, str) and " " in value.strip():
            last[name] = bool(TERMINAL.search(value.rstrip()))
    return sorted({*(node if isinstance(node, dict) else ()), *(f"{name}." for name, finished in last.items() if finished)})


_DECODER = json.JSONDecoder()
#: Strings, the last one perhaps left open, and brackets outside them.
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|[{}\[\]]', re.DOTALL)


def json_state(text: str) -> tuple[str, list[str]]:
    """open, whole, or none (no object in it), and the names in a whole object that can be read; see `_names_of`."""
    start = text.find("{")
    if start < 0:
        return "none", []
    try:
        return "whole", _names_of(_DECODER.raw_decode(text, start)[0])
    except (ValueError, RecursionError):
        pass
    depth = 0
    for part in _BRACKETS.finditer(text, start):
        c = part.group()
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return "whole", sorted(set(re.findall(r"^[ ]?[\"'](\w+)[\"']\s*:", text[start : part.end()], re.M)) | {"?"})
    return "open", []


def tagged_state(text: str) -> tuple[list[str], list[str]]:
    """Names that the sections and their first items hold, and those of the last section with its last item."""
    section, first, seen = "", {}, []
    last: list[str] = []
    for line in text.split("\n"):
        if m := TAG.match(line):
            section = m.group(1)
            seen.append(section)
            last = []
        elif line.strip() and section:
            last = FIELD.findall(line)
            first.setdefault(section, last)
    names = [*seen, *(f"{s}:{f}" for s, fields in first.items() for f in fields)]
    return sorted(set(names)), sorted({*seen, *(f"{s}:{f}" for s, fields in first.items() if s != section for f in fields), *(f"{section}:{f}" for f in last)})


def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\s|]+", text)


def _bare(token: str) -> str:
    return token.strip("\"'“”„«»’()[]*_,.;:!?…—-")


def _class(word: str) -> str:
    """A word as context: capitalised words and numbers as such, others themselves."""
    return "<0>" if any(c.isdigit() for c in word) else "<A>" if word[:1].isupper() else word


def word_keys(before: str, last: str, kind: str) -> list[str]:
    """Keys under which the corpus knows a word: itself, behind the word before, any capitalised word there, and as a beginning of longer words there."""
    behind = _class(before)
    return [f"{kind}u {last}", f"{kind}b {behind} {last}", f"{kind}c {behind}" if last[:1].isupper() else "", f"{kind}x {behind} {last}"]


def count_words(text: str, kind: str, into: Counter) -> None:
    """Adds, for each word of a text behind the class of the word before, how often it ends a sentence (`True`) and how often the text goes on.

    The last word counts only if a full stop or the like follows it; `text` has nothing put behind it any more.
    """
    lines = text.split("\n")
    for n, line in enumerate(lines):
        tokens, before = _tokens(line), ""
        last = len(tokens) - 1
        for i, token in enumerate(tokens):
            word = _bare(token)
            ends = token[-1:] in ENDINGS and bool(TERMINAL.search(token))
            if i == last and not ends:
                if n == len(lines) - 1:
                    continue
                ends = kind == "t"
            into[kind, _class(before), word, ends] += 1
            before = word


#: Beginnings up to this length are keys of their own; longer ones are found by their first so many letters and compared whole.
STEM = 24


def keys_of_words(words: DataFrame) -> DataFrame:
    """key, ends, goes_on: the keys of `word_keys` that counted words (kind, behind, word, ends, goes_on) add to, those of beginnings of up to STEM letters included."""
    kind, behind, word = F.col("kind"), F.col("behind"), F.col("word")
    first = F.left(word, F.lit(1))
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    own = F.array(F.concat(kind, F.lit("u "), word), F.concat(kind, F.lit("b "), behind, F.lit(" "), word))
    size = F.least(F.length(word) - 1, F.lit(STEM))
    beginnings = F.when(size > 0, F.transform(F.sequence(F.lit(1), size), lambda k: F.concat(kind, F.lit("x "), behind, F.lit(" "), F.left(word, k)))).otherwise(F.array().cast("array<string>"))
    whole = words.select(F.explode(F.when(capital, F.array_append(own, F.concat(kind, F.lit("c "), behind))).otherwise(own)).alias("key"), "ends", "goes_on")
    return whole.unionByName(words.select(F.explode(beginnings).alias("key"), F.lit(0).cast("bigint").alias("ends"), (F.col("ends") + F.col("goes_on")).alias("goes_on")))


def long_beginnings(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, ends, goes_on for wanted beginnings of more than STEM letters: words that share the first STEM are compared whole."""
    stem = lambda c: F.left(F.element_at(F.split(c, " "), -1), F.lit(STEM))
    asked = wanted.where(F.substring("key", 2, 1) == "x").withColumn("open", F.element_at(F.split("key", " "), -1)).where(F.length("open") > STEM)
    asked = asked.select("key", "open", F.concat(F.substring_index("key", " ", 2), F.lit(" "), stem("key")).alias("stem"))
    long_words = words.where(F.length("word") > STEM).select("word", (F.col("ends") + F.col("goes_on")).alias("n"), F.concat("kind", F.lit("x "), "behind", F.lit(" "), F.left("word", F.lit(STEM))).alias("stem"))
    met = asked.join(long_words, "stem").where((F.length("word") > F.length("open")) & F.startswith("word", F.col("open")))
    return met.groupBy("key").agg(F.lit(0).cast("bigint").alias("ends"), F.sum("n").alias("goes_on"))


def ending(text: str, mode: str | None) -> dict:
    """What the end of a text says by itself: class, keys of its last words to be looked up, names to be held against the typical ones."""
    core = without_appended(text)
    out = {"kind": "word", "keys": [], "names": [], "typical": "", "sign": bool(CUT_SIGN.search(text.rstrip()[-64:])), "trail": text[-1:].isspace()}
    if mode == "structured" or core.lstrip().startswith("{"):
        state, names = json_state(core)
        if state != "none":
            out |= {"kind": "json_open" if state == "open" else "whole_structure", "typical": "j" if names and "?" not in names else "", "names": names}
            return out
    if mode == "fallback" or TAG.match(core.split("\n", 1)[0]):
        _, names = tagged_state(core)
        out |= {"typical": "t", "names": names}
        tokens = _tokens(core.rsplit("\n", 1)[-1])
        if tokens:
            out["keys"] = word_keys(_bare(tokens[-2]) if len(tokens) > 1 else "", _bare(tokens[-1]), "t")
        return out
    if not core.strip():
        return out | {"kind": "whole_structure"}
    end, words = core.rstrip(), _tokens(core)
    # a row of full stops put behind a text may have followed one of its own
    if TERMINAL.search(end):
        return out | {"kind": "terminal"}
    if end[-1] != "\ufffd" and unicodedata.category(end[-1]) in ("So", "Sk", "Mn", "Cf") or " ".join(words[-2:]) in CLOSING or words[-1] in CLOSING:
        return out | {"kind": "closing_sign"}
    if end[-1] in ",;:—–-“„«([/\ufffd" or not _bare(words[-1]):  # U+FFFD: half a character
        return out | {"kind": "mid_clause"}
    # a word by itself has nothing before it that could tell
    return out | {"keys": word_keys(_bare(words[-2]), _bare(words[-1]), "p") if len(words) > 1 else [], "kind": "word" if not CLOSED_QUOTE.search(end) else "quoted_word"}


FEATURES = "segment_row_id bigint, source_model string, field_name string, chars int, bytes int, kind string, keys array<string>, names array<string>, typical string, sign boolean, trail boolean"
WORDS = "kind string, behind string, word string, ends bigint, goes_on bigint"
#: Rows of the one pass over the texts: features of a text, or counts of a word in a batch of texts, the other fields null.
PASSED = f"feature struct<{FEATURES}>, counted struct<{WORDS}>"


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    feature, counted = (pa.struct([pa.field(n, _ARROW[t]) for n, t in (f.split() for f in spec.split(", "))]) for spec in (FEATURES, WORDS))
    for b in batches:
        rows, counts = [], Counter()
        for id_, source, field, text, mode in zip(*(b.column(k).to_pylist() for k in ("segment_row_id", "source_model", "field_name", "text", "mode"))):
            left = _unmarked(text)
            rows.append({"segment_row_id": id_, "source_model": source, "field_name": field} | ending(text, mode) | {"chars": len(left), "bytes": len(left.encode())})
            core = without_appended(text).lstrip()
            if mode == "fallback" or TAG.match(core.split("\n", 1)[0]):
                count_words(core, "t", counts)
            elif not core.startswith(("{", "```")) and mode != "structured":
                count_words(core, "p", counts)
        words = [dict(zip(("kind", "behind", "word"), k), ends=counts[(*k, True)], goes_on=counts[(*k, False)]) for k in sorted({k[:3] for k in counts})]
        yield pa.RecordBatch.from_arrays([pa.array(rows + [None] * len(words), feature), pa.array([None] * len(rows) + words, counted)], ["feature", "counted"])


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def fit_censored(lengths: np.ndarray, n: np.ndarray, limit: float) -> tuple[float, float]:
    """Maximum likelihood (mean, deviation) of log-normal lengths of which those at or above `limit` are only known to reach it.

    EM: the missing part of a censored log-length is replaced by its expectations under the current normal.
    """
    x, open_ = np.log(np.maximum(lengths, 1)), lengths >= limit
    c = math.log(limit) if math.isfinite(limit) and limit > 0 else math.inf
    w_open, w_seen = float(n[open_].sum()), n[~open_]
    mu = float((x * n).sum() / n.sum())
    sigma = max(0.05, math.sqrt(float((n * (x - mu) ** 2).sum() / n.sum())))
    for _ in range(60):
        first = second = 0.0
        if w_open:
            a = (c - mu) / sigma
            tail = max(0.5 * math.erfc(a / math.sqrt(2)), 1e-12)
            hazard = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
            first = mu + sigma * hazard
            second = mu * mu + sigma * sigma + sigma * hazard * (c + mu)
        total = float(w_seen.sum()) + w_open
        mu = (float((x[~open_] * w_seen).sum()) + w_open * first) / total
        variance = (float((x[~open_] ** 2 * w_seen).sum()) + w_open * second) / total - mu * mu
        sigma = math.sqrt(max(variance, 0.0025))
    return mu, sigma


def _tail(mu: float, sigma: float, x: float) -> float:
    return 0.5 * math.erfc((math.log(max(x, 1e-9)) - mu) / sigma / math.sqrt(2))


LIMITS = "source_model string, field_name string, unit string, low int, high int, at_limit bigint, prior double"


def find_limits(histogram: pd.DataFrame) -> pd.DataFrame:
    """Candidate limits of one source and field: lengths, in characters or bytes, at which far more texts end unfinished than around them.

    `histogram`: unit, length, n, unfinished. A limit may be kept exactly, or fall short by a split character (bytes) or a dropped
    word (characters); texts at a limit that is kept exactly don't make a wider one. The posterior of censoring compares the fitted tail beyond
    the limit with the fitted chance of ending there by itself. Sums over windows are differences of running sums, so the work grows with the number of lengths.
    """
    out = []
    for unit, h in histogram.groupby("unit"):
        h = h.sort_values("length")
        lengths, n, unfinished = h["length"].to_numpy(float), h["n"].to_numpy(float), h["unfinished"].to_numpy(float)
        for width in WINDOWS[str(unit)]:
            upto = np.concatenate([[0.0], np.cumsum(unfinished)])
            within = lambda low, high: upto[np.searchsorted(lengths, high, "right")] - upto[np.searchsorted(lengths, low, "right")]  # noqa: B023, E731
            total = within(lengths - width - 1, lengths)
            around = within(lengths - width - 81, lengths + 60) - total
            room = 140 / (width + 1)
            usual = np.maximum(around / room, 0.2)
            beyond_n = n.sum() - np.cumsum(n)  # a limit lets hardly anything pass
            strong = (total > usual * 4 + 4 * np.sqrt(usual) + 3) & (unfinished > 0) & (beyond_n <= MOST_BEYOND * n.sum())
            found = []
            while strong.any():
                at = int(np.argmax(np.where(strong, (total - usual) / np.sqrt(usual), -1)))
                v, low = lengths[at], lengths[at] - width
                mu, sigma = fit_censored(lengths, n, low)
                beyond, here = _tail(mu, sigma, v), max(_tail(mu, sigma, low - 0.5) - _tail(mu, sigma, v + 0.5), 1e-9)
                # by itself ends here: the fitted chance, and the unfinished texts usual around it
                share_usual = min(0.9, usual[at] / max(total[at], 1))
                odds = beyond / here * (1 - share_usual) if width else beyond / here
                out.append((unit, int(low), int(v), int(total[at]), float(odds / (1 + odds))))
                found.append(v)
                strong &= np.abs(lengths - v) > 40
            unfinished = np.where(np.isin(lengths, found), 0.0, unfinished) if width == 0 else unfinished
    key = (histogram["source_model"].iloc[0], histogram["field_name"].iloc[0])
    return pd.DataFrame([(*key, *row) for row in out], columns=[c.split()[0] for c in LIMITS.split(", ")])


def stored_texts(segments: DataFrame) -> DataFrame:
    """(segment_row_id, source_model, field_name, text, mode): the two stored texts of every row, without null and blank ones."""
    trace = F.col("structured_trace")
    entries = F.array(
        F.struct(F.lit("synopsis").alias("field_name"), F.col("synopsis").alias("text"), F.lit(None).cast("string").alias("mode")),
        F.struct(F.lit("structured_trace.content").alias("field_name"), trace["content"].alias("text"), trace["mode"].alias("mode")),
    )
    return segments.select("segment_row_id", "source_model", F.inline(entries)).where(F.col("text").rlike(r"\S"))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


#: Texts that the guessed weight of an ending is worth beside those the limits show.
GUESS_ROWS = 50.0


def ending_weights(table: list[tuple[str, float, float, float]]) -> dict[str, float]:
    """Log-odds of every ending, from rows (ending, expected cut texts at limits, expected whole texts elsewhere, guessed log-odds).

    The share of an ending among cut texts is taken where the censoring posterior says that texts were cut, its share among whole ones elsewhere. The guess counts as GUESS_ROWS cut
    texts, so that an ending no limit has shown keeps its place among them; with fewer texts than that at limits the guesses stand.
    """
    shown = sum(c for _, c, _, _ in table)
    if shown < GUESS_ROWS:
        return {e: g for e, _, _, g in table}
    whole = sum(w for _, _, w, _ in table) + len(table)
    guess = {e: (w + 1) / whole * math.exp(g) for e, _, w, g in table}
    unit = GUESS_ROWS / sum(guess.values())
    return {e: math.log((c + unit * guess[e]) / (shown + GUESS_ROWS)) - math.log((w + 1) / whole) for e, c, w, _ in table}


def judge_texts(segments: DataFrame, with_limits: bool = True, with_learning: bool = True) -> DataFrame:
    """segment_row_id, source_model, field_name, chars, ending, at_limit, prior, log_odds, is_cut: for every stored text whether it was cut.

    Two kinds of evidence are combined, as log-odds. The prior of a text is the chance that it was cut anywhere (the rate at which texts of its source and field break off away from limits) or
    at one of its source's limits: there the censoring posterior of a right-censored log-normal fitted by maximum likelihood (`find_limits`). The ending: an object or list left open, names or full stops
    missing that most outputs have, a finished sentence, a closing sign, a clause left open. For texts that end in a word: how often the whole corpus ends a sentence after it, behind the word
    before; for a name, after any capitalised word there. A word never seen there, but with which longer words begin there, is half of one. What an ending weighs is learned at the limits
    (`ending_weights`), where the posterior tells cut texts without looking at their ends; structures left open, and signs put behind a text, keep weights of their own.

    Null and blank texts are left out. A null source is a source of its own. Repeated rows are judged each by itself. One pass over the texts; `with_limits` and `with_learning` are for ablations.
    """
    passed = cut(spread(stored_texts(segments)).mapInArrow(_passed, PASSED))
    found = passed.where("feature is not null").select("feature.*")
    words = passed.where("counted is not null").select("counted.*").groupBy("kind", "behind", "word").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    wanted = found.where(F.size("keys") > 0).select(F.explode("keys").alias("key")).where("key <> ''").distinct()
    counts = keys_of_words(words).join(wanted, "key", "left_semi").unionByName(long_beginnings(words, wanted)).groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))

    # names that most outputs of a kind have: a handful, whatever the input's size
    kinds = found.where("typical <> ''").groupBy("typical").agg(F.count("*").alias("n"))
    named = found.where("typical <> ''").select("typical", F.explode("names").alias("name")).groupBy("typical", "name").agg(F.count("*").alias("n_name"))
    usual = named.join(kinds, "typical").where(F.col("n_name") > SHARE_OF_TYPICAL * F.col("n")).groupBy("typical").agg(F.collect_set("name").alias("usual"))
    checked = found.join(usual, "typical", "left").withColumn("lacks", (F.size("names") > 0) & F.col("usual").isNotNull() & (F.size(F.array_except("usual", "names")) > 0))

    id_ = ["segment_row_id", "field_name"]
    asked = found.where(F.size("keys") > 0).select(*id_, F.posexplode("keys").alias("pos", "key"))
    seen = asked.join(counts, "key", "left").groupBy(*id_).agg(*(F.sum(F.when(F.col("pos") == i, F.col(c))).alias(f"{c}{i}") for i in range(4) for c in ("ends", "goes_on")))
    at = lambda c, i: F.coalesce(F.col(f"{c}{i}"), F.lit(0))
    with_words = checked.join(seen, id_, "left")
    known, pair, beginning = (at("ends", i) + at("goes_on", i) for i in (0, 1, 3))
    capital = F.coalesce(F.get("keys", 2) != "", F.lit(False))
    # share of sentence ends after the word: that after the pair, drawn towards that of the word (of capitalised words there) where pairs are few
    alone = (at("ends", 0) + 0.3) / (known + 1.0)
    capitals = (at("ends", 2) + 0.3) / (at("ends", 2) + at("goes_on", 2) + 1.0)
    share = (at("ends", 1) + 2.0 * F.when(capital, capitals).otherwise(alone)) / (pair + 2.0)
    by_share = F.least(F.greatest(-2.0 * F.log(share / 0.3), F.lit(-4.0)), F.lit(5.0))  # a third of sentence ends leaves it open
    half_word = (pair == 0) & (beginning > 0)
    unheard = (pair == 0) & (known == 0) & ~(capital & (at("ends", 2) + at("goes_on", 2) > 0))
    word_llr = F.when(half_word, 7.0).when(unheard, 0.5).otherwise(by_share)
    word_kind = F.when(half_word, "half").when(unheard, "unheard").otherwise(F.round(by_share).cast("int").cast("string"))
    is_word, proved = F.col("kind").isin("word", "quoted_word"), F.col("lacks") | F.col("kind").isin("json_open", "whole_structure")
    core = F.when(~proved, F.concat_ws(" ", "typical", "kind", F.when(is_word, word_kind)))
    llr = F.when(F.col("lacks"), LLR["keys_missing"])
    for kind in ("json_open", "whole_structure", "terminal", "closing_sign", "mid_clause"):
        llr = llr.when(F.col("kind") == kind, LLR[kind])
    llr = llr.when(F.col("kind") == "quoted_word", word_llr - 3.0).otherwise(word_llr)
    behind = F.when(F.col("sign"), CUT_SIGN_LLR).otherwise(0.0) + F.when(F.col("trail") & (F.col("kind") == "word"), TRAIL_LLR).otherwise(0.0)
    broken = (F.col("kind") == "json_open") | F.col("lacks") | ((F.col("kind") == "word") & half_word)
    judged = cut(with_words.withColumn("core", core).withColumn("llr", llr).withColumn("behind", behind).withColumn("broken", broken).select(*id_, "source_model", "chars", "bytes", "kind", "core", "llr", "behind", "broken"))

    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))
    unfinished = (F.col("llr") + F.col("behind") > 0).cast("int").alias("unfinished")
    histogram = judged.select("source_model", "field_name", unfinished, F.inline(units)).groupBy("source_model", "field_name", "unit", "length").agg(F.count("*").alias("n"), F.sum("unfinished").alias("unfinished"))
    limits = histogram.groupBy("source_model", "field_name").applyInPandas(find_limits, LIMITS)  # rows: lengths that occur, not texts
    per_source = limits.where(F.lit(with_limits)).groupBy("source_model", "field_name").agg(F.collect_list(F.struct("unit", "low", "high", "prior")).alias("limits"))
    length = lambda x: F.when(x["unit"] == "chars", F.col("chars")).otherwise(F.col("bytes"))
    inside = F.filter("limits", lambda x: (length(x) >= x["low"]) & (length(x) <= x["high"]))
    placed = cut(judged.alias("j").join(per_source.alias("l"), _same("j", "l"), "left").select("j.*", F.array_max(F.transform(inside, lambda x: x["prior"])).alias("posterior")))
    away = F.col("posterior").isNull()
    rates = placed.groupBy("source_model", "field_name").agg(((F.sum((F.col("broken") & away).cast("int")) + 0.5) / (F.sum(away.cast("int")) + 2)).alias("rate"))
    prior = F.lit(1.0) - (F.lit(1.0) - F.col("rate")) * (F.lit(1.0) - F.coalesce("posterior", F.lit(0.0)))
    rated = placed.alias("j").join(rates.alias("r"), _same("j", "r")).select("j.*", prior.alias("prior"))
    weight = F.col("llr")
    if with_learning:
        is_cut = F.lit(1.0) / (F.lit(1.0) + F.exp(-(_logit(F.col("prior")) + F.col("llr") + F.col("behind"))))
        expected = rated.where("core is not null").groupBy("core").agg(F.sum(F.when(away, 0.0).otherwise(is_cut)).alias("c"), F.sum(F.when(away, 1.0 - is_cut).otherwise(0.0)).alias("w"), F.avg("llr").alias("g"))
        learned = ending_weights([tuple(r) for r in expected.collect()])  # kinds of endings: some dozens at most
        for core_, value in learned.items():
            weight = F.when(F.col("core") == core_, F.lit(value)).otherwise(weight)
    out = rated.withColumn("log_odds", _logit(F.col("prior")) + weight + F.col("behind"))
    return out.select("segment_row_id", "source_model", "field_name", "chars", F.col("kind").alias("ending"), (~away).alias("at_limit"), "prior", "log_odds", (F.col("log_odds") > 0).alias("is_cut"))


def _same(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("source_model", "field_name")))


def truncation_rates(judged: DataFrame) -> DataFrame:
    """source_model, field_name, n_texts, n_cut, share_cut: how often each source truncates."""
    return judged.groupBy("source_model", "field_name").agg(F.count("*").alias("n_texts"), F.sum(F.col("is_cut").cast("int")).alias("n_cut"), F.avg(F.col("is_cut").cast("double")).alias("share_cut"))
