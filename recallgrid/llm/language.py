"""Language of texts and of their parts by hyperdimensional n-gram profiles."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import spread

#: The languages of the corpus with the other ways to write their labels.
LABELS = {
    "en": ("eng", "english", "englisch", "anglais", "inglés", "inglese", "inglês", "engels", "английский"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "alemão", "duits", "немецкий"),
    "fr": ("fra", "fre", "french", "français", "francais", "französisch", "francés", "francese", "francês", "frans", "французский"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "spagnolo", "espanhol", "spaans", "испанский"),
    "it": ("ita", "italian", "italiano", "italienisch", "italien", "italiaans", "итальянский"),
    "pt": ("por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "portoghese", "portugees", "португальский"),
    "nl": ("nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais", "neerlandés", "olandese", "holandês", "нидерландский"),
    "ru": ("rus", "russian", "русский", "russisch", "russe", "ruso", "russo"),
}

DIMENSIONS = 4096
SEED = 1729
#: Letters with a vector of their own; all other letters share one.
LETTERS = " abcdefghijklmnopqrstuvwxyzßæœøðþ'абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєўґ"
K = len(LETTERS) + 1

CODE = re.compile(r"```.*?(?:```|\Z)|<[^<>\n]{1,200}>|https?://\S+|\bwww\.\S+|\S+@\S+\.\S+|`[^`\n]*`|&[a-z]+;", re.DOTALL)
SPEAKER = re.compile(r"(?m)^[ \t]*[^\W\d_][^\n:]{0,40}:(?=\s|$)")
QUOTE = re.compile(r"[“„«”\"]\s*([^“”„«»\"\n]{12,}?)\s*[”“»\"]")
SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*[”“»\"’')\]]*")
MARKS = re.compile(r"[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
WORD = re.compile(r"[^\W\d_]+")

#: A part has a say in the language of a text from this many words and letters on.
MIN_WORDS, MIN_LETTERS = 4, 15
#: By so much the cosine with a second language must exceed that with the main one.
MARGIN = 0.07

_INDEX = np.full(0x600, K - 1, dtype=np.int64)
for _i, _c in enumerate(LETTERS):
    _INDEX[ord(_c)] = _i


def letters(text: str) -> str:
    """Lower-case letters without accents, all else as single blanks, a blank at either end."""
    s = text.lower() if text.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", text).lower())
    return " " + " ".join(WORD.findall(s)) + " "


def trigrams(text: str) -> np.ndarray:
    """Numbers of the consecutive three-letter windows of `letters` text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    x = np.where(points < len(_INDEX), _INDEX[np.minimum(points, len(_INDEX) - 1)], K - 1)
    return (x[:-2] * K + x[1:-1]) * K + x[2:] if len(x) > 2 else np.empty(0, np.int64)


def letter_vectors() -> np.ndarray:
    """A random vector of +1 and -1 for every letter."""
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (K, DIMENSIONS))


def bind(numbers: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """n-gram vectors: the letters' vectors, permuted by their place (rotation), multiplied."""
    a, b, c = numbers // (K * K), numbers // K % K, numbers % K
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


@dataclass
class Profiles:
    """Language prototypes: bundles of n-gram vectors, their common part taken off, at unit length."""

    languages: list[str]
    prototypes: np.ndarray  # languages x DIMENSIONS

    @classmethod
    def fit(cls, counts: dict[str, Counter]) -> Profiles:
        """Prototypes from counts of n-grams by language."""
        vectors, names = letter_vectors(), sorted(k for k, v in counts.items() if v)
        bundles = np.zeros((len(names), DIMENSIONS))
        for row, name in enumerate(names):
            items = counts[name].most_common()
            numbers, n = np.array([k for k, _ in items]), np.sqrt(np.array([v for _, v in items], float))
            for at in range(0, len(numbers), 4096):
                bundles[row] += n[at : at + 4096] @ bind(numbers[at : at + 4096], vectors).astype(np.float32)
        unit = bundles / np.linalg.norm(bundles, axis=1, keepdims=True)
        if len(names) > 1:
            unit = unit - unit.mean(axis=0)
        return cls(names, unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12))


class Scorer:
    """Cosines of texts with the prototypes. The bundle of a text is a sum over its n-grams, so its products with the

    prototypes are sums of the n-grams' products, kept in a table filled as n-grams occur.
    """

    def __init__(self, profiles: Profiles) -> None:
        self.languages, self.prototypes = profiles.languages, profiles.prototypes.T.astype(np.float32)
        self.vectors = letter_vectors()
        self.known = np.zeros(K**3, bool)
        self.products = np.zeros((K**3, len(self.languages)), np.float32)

    def cosines(self, parts: list[str]) -> np.ndarray:
        """parts x languages; 0 for a part without letters. n-gram vectors being nearly orthogonal, a bundle's squared length is taken as the sum of its squared counts times DIMENSIONS."""
        out = np.zeros((len(parts), len(self.languages)))
        numbers, part = trigrams("".join(parts)), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        if not len(numbers):
            return out
        inside = part[:-2] == part[2:]  # windows over the end of a part are none of its own
        numbers, part = numbers[inside], part[:-2][inside]
        keys, n = np.unique(part * np.int64(K**3) + numbers, return_counts=True)
        gram, part = keys % K**3, keys // K**3
        new = np.unique(gram)
        new = new[~self.known[new]]
        for at in range(0, len(new), 2048):
            some = new[at : at + 2048]
            self.products[some] = bind(some, self.vectors).astype(np.float32) @ self.prototypes
        self.known[new] = True
        length = np.sqrt(np.bincount(part, n.astype(float) ** 2, len(parts)) * DIMENSIONS)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(part, self.products[gram, k] * n, len(parts))
        return out / np.maximum(length, 1e-9)[:, None]


@dataclass(frozen=True)
class Part:
    start: int
    end: int
    text: str  # letters
    words: int
    size: int  # letters without blanks


def parts(text: str) -> list[Part]:
    """The sentences of a text, quoted ones of some length apart from what surrounds them; code, links and speakers' names left out."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    shown = SPEAKER.sub(lambda m: " " * len(m.group()), CODE.sub(blank, text))
    out: list[Part] = []

    def add(start: int, end: int) -> None:
        got = letters(shown[start:end])
        words = got.split()
        if words:
            out.append(Part(start, end, got, len(words), sum(map(len, words))))

    rest, at = [], 0
    for q in QUOTE.finditer(shown):
        if len(WORD.findall(q.group(1))) >= MIN_WORDS:
            for s in SENTENCE.finditer(shown, q.start(1), q.end(1)):
                add(s.start(), s.end())
            rest.append((at, q.start()))
            at = q.end()
    rest.append((at, len(shown)))
    for a, b in rest:
        for s in SENTENCE.finditer(shown, a, b):
            add(s.start(), s.end())
    return sorted(out, key=lambda p: p.start)


@dataclass
class Reading:
    """What one text was found to be written in."""

    main: str | None
    confidence: float
    segments: list[tuple[int, int, str, float]]  # start, end, language, confidence

    @property
    def languages(self) -> list[str]:
        return sorted({lang for _, _, lang, _ in self.segments})


def _confidence(cosines: np.ndarray) -> np.ndarray:
    """Softmax of cosines at a fixed temperature."""
    e = np.exp((cosines - cosines.max(axis=-1, keepdims=True)) / 0.03)
    return e / e.sum(axis=-1, keepdims=True)


def read_texts(texts: list[str | None], scorer: Scorer) -> list[Reading]:
    """A reading of each text. Main language: that of most letters of its sentences. A second language needs a sentence of its own,

    long enough and nearer to it than to the main language by a margin; other sentences count for the main language.
    """
    found = [[p for p in parts(t) if p.words >= 2] if t else [] for t in texts]
    cos = scorer.cosines([p.text for ps in found for p in ps])
    readings, at = [], 0
    for ps in found:
        c = cos[at : at + len(ps)]
        at += len(ps)
        sure = [i for i, p in enumerate(ps) if p.words >= MIN_WORDS and p.size >= MIN_LETTERS]
        if not sure:
            sure = [i for i, p in enumerate(ps) if p.words >= 3 and p.size >= 8]
            if not sure:
                readings.append(Reading(None, 0.0, []))
                continue
        size = np.array([ps[i].size for i in sure], float)
        best = c[sure].argmax(axis=1)
        # sentences vote with their letters; among all of one language the sums agree with the bundle of the text
        votes = np.bincount(best, size, len(scorer.languages))
        main = int(votes.argmax())
        lang = np.where((best != main) & (c[sure, best] - c[sure, main] > MARGIN), best, main)
        votes = np.bincount(lang, size, len(scorer.languages))
        main = int(votes.argmax())
        segments: list[list] = []
        for i, k in zip(sure, lang):
            if segments and segments[-1][2] == k:
                segments[-1][1] = ps[i].end
                segments[-1][3].append(i)
            else:
                segments.append([ps[i].start, ps[i].end, int(k), [i]])
        whole = (c[sure] * size[:, None]).sum(axis=0) / size.sum()
        named = []
        for start, end, k, own in segments:
            weight = np.array([ps[i].size for i in own], float)
            mean = (c[own] * weight[:, None]).sum(axis=0) / weight.sum()
            named.append((start, end, scorer.languages[k], float(_confidence(mean)[k])))
        readings.append(Reading(scorer.languages[main], float(_confidence(whole)[main]), named))
    return readings


def label_language(label: Column) -> Column:
    """The two-letter code a label names, in whatever way it is written; null if it names none."""
    bare = F.lower(F.trim(F.regexp_replace(label, r"[\s\p{Z}]+", " ")))
    head = F.regexp_extract(bare, r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for code, others in LABELS.items():
        out = F.when(head.isin(code, *others), F.lit(code)).otherwise(out)
    return out


def sample_rows(documents: DataFrame, per_language: int = 400, text: str = "text", lang: str = "lang") -> DataFrame:
    """About `per_language` labelled rows of each language (code, text), drawn by hash: the classifier's bounded sample."""
    coded = documents.select(label_language(F.col(lang)).alias("code"), F.col(text).alias("t"), F.xxhash64("doc_id").alias("h"))
    have = coded.where("code is not null and t is not null")
    # counted without reading the texts; one row a language
    sizes = {r["code"]: r["n"] for r in documents.select(label_language(F.col(lang)).alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for code, n in sizes.items():
        rate = F.when(F.col("code") == code, F.lit(min(1.0, per_language / n))).otherwise(rate)
    return have.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < rate).select("code", "t")


def fit_profiles(documents: DataFrame, per_language: int = 400, most_chars: int = 3000) -> Profiles:
    """Prototypes from a bounded sample of labelled rows: about `per_language` a language, of each the sentences found in its

    first `most_chars` characters. The sample's labels may be wrong and its texts mixed: a first fit reads the sample's sentences and
    only sentences that agree with their row's label go into the second. At most per_language * most_chars characters a language reach the driver.
    """
    rows = sample_rows(documents, per_language).select("code", F.left("t", F.lit(most_chars)).alias("t")).collect()
    sentences = [(r["code"], p.text) for r in sorted(rows) for p in parts(r["t"]) if p.words >= MIN_WORDS]
    kept = sentences
    profiles = None
    for _ in range(2):
        counts: dict[str, Counter] = {}
        for code, text in kept:
            counts.setdefault(code, Counter()).update(trigrams(text).tolist())
        if not counts:
            return Profiles([], np.zeros((0, DIMENSIONS)))
        profiles = Profiles.fit(counts)
        scorer = Scorer(profiles)
        best = scorer.cosines([t for _, t in sentences]).argmax(axis=1)
        kept = [s for s, k in zip(sentences, best) if scorer.languages[k] == s[0]]
    return profiles


READ = "lang_found string, confidence double, segments array<struct<start_pos:int,end_pos:int,lang:string,confidence:double>>"


def read_languages(documents: DataFrame, keep: list[str], profiles: Profiles, text: str = "text") -> DataFrame:
    """`keep`, lang_found, confidence and segments of every text; null, 0 and no segments for one without a sentence.

    Segments are runs of sentences of one language, positions in characters. A narrow pass over whole texts, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles) if profiles.languages else None
        for batch in batches:
            texts = batch.column(text).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size < 400_000 or end == at):
                    size += len(texts[end] or "")
                    end += 1
                got = read_texts(texts[at:end], scorer) if scorer else [Reading(None, 0.0, [])] * (end - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(at, end - at) for k in keep),
                        pa.array([g.main for g in got], pa.string()),
                        pa.array([g.confidence for g in got], pa.float64()),
                        pa.array(
                            [[dict(zip(("start_pos", "end_pos", "lang", "confidence"), s)) for s in g.segments] for g in got],
                            pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])),
                        ),
                    ],
                    [*keep, "lang_found", "confidence", "segments"],
                )
                at = end

    types = dict(documents.dtypes)
    columns = documents.select(*dict.fromkeys([*keep, text]))
    return spread(columns).mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), READ]))


def language_findings(read: DataFrame) -> DataFrame:
    """(doc_id, finding, lang): `label` for a document whose label is missing, names no language or another than the main one;

    `mixed`, once for each language of a document with sentences in several. `read` holds doc_id, lang and what `read_languages` adds.
    """
    named = label_language(F.col("lang"))
    languages = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    row = lambda finding, lang: F.struct(F.lit(finding).alias("finding"), lang.alias("lang"))
    none = F.array().cast("array<struct<finding:string,lang:string>>")
    label = F.when(named.isNull() | (named != F.col("lang_found")), F.array(row("label", F.col("lang_found")))).otherwise(none)
    mixed = F.when(F.size(languages) > 1, F.transform(languages, lambda x: row("mixed", x))).otherwise(none)
    # both kinds of rows from one reading of the texts
    return read.where("lang_found is not null").select("doc_id", F.inline(F.concat(label, mixed)))
