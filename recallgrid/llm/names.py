"""Linking the spellings under which one character, organisation or place of a chat appears."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import cut, spread
from .canonical import LOOKALIKES, edits

#: Short forms of given names.
NICKNAMES = {
    "alexander": ("alex", "sandy", "lex", "al", "xander"), "anneliese": ("anna", "ann", "liesl", "annie"), "arabella": ("ara", "bella", "belle"), "benjamin": ("ben", "benny", "benji"),
    "catherine": ("cathy", "kate", "kitty", "cat"), "charles": ("charlie", "chuck", "chas"), "charlotte": ("charlie", "lottie"), "cornelius": ("corny", "neil", "con"), "daniel": ("dan", "danny"),
    "david": ("dave", "davy"), "desmond": ("des", "dez"), "dorothea": ("dot", "dottie", "thea", "dory"), "edward": ("ed", "eddie", "ted", "ned", "teddy"), "eleanor": ("nell", "ellie", "nora"),
    "elizabeth": ("liz", "beth", "betty", "lizzie", "eliza", "bess", "libby"), "ferdinand": ("ferdy", "ferd", "nando"), "frederick": ("fred", "freddie", "freddy", "fritz"), "george": ("georgie",),
    "gregory": ("greg", "gregor"), "gwendolyn": ("gwen", "wendy", "gwennie"), "harriet": ("hattie", "harry", "etta"), "henry": ("harry", "hank", "hal"), "hezekiah": ("hez", "hezzie"),
    "ignatius": ("iggy", "nate"), "isabella": ("bella", "izzy", "isa", "belle"), "james": ("jim", "jimmy", "jamie"), "john": ("jack", "johnny"), "josephine": ("jo", "josie", "josey", "posy"),
    "joseph": ("joe", "joey"), "katherine": ("kate", "kat", "kitty", "kathy", "katie"), "leonard": ("len", "lenny", "leo"), "margaret": ("maggie", "peg", "meg", "peggy", "marge"),
    "mary": ("molly", "polly"), "matthias": ("matt", "matty", "matthew"), "michael": ("mike", "mick"), "nathaniel": ("nat", "nate", "nathan"), "nicholas": ("nick",), "ottoline": ("otta", "ottie"),
    "patricia": ("pat", "patty", "trish"), "philippa": ("pip", "pippa"), "quentin": ("quen", "quent"), "rebecca": ("becca", "becky"), "richard": ("dick", "rick", "richie"),
    "robert": ("bob", "rob", "bobby", "robbie", "bert"), "rosalind": ("roz", "ros", "rose"), "samuel": ("sam", "sammy"), "sarah": ("sally", "sadie"), "susannah": ("sue", "susie", "susan", "suki"),
    "theodore": ("ted", "theo", "teddy"), "thomas": ("tom", "tommy"), "tobias": ("toby", "tobe"), "ursula": ("ursa", "ursie"), "veronica": ("ronnie", "vera"), "victoria": ("vicky", "tori", "vic"),
    "wilhelmina": ("mina", "willa", "minnie", "billie"), "william": ("bill", "will", "billy", "willy", "liam"), "yolanda": ("yoli", "yola"), "zachary": ("zack", "zac", "zach"),
}

#: Forms of address, left off before a name.
TITLES = {
    "mr", "mrs", "ms", "miss", "dr", "doctor", "prof", "professor", "captain", "capt", "judge", "sister", "brother", "steward", "sir", "lady", "lord", "madam", "master", "mistress", "father",
    "mother", "king", "queen", "prince", "princess", "saint", "sergeant", "sgt", "lieutenant", "lt", "colonel", "col", "general", "gen", "major",
}
#: Words that are no part of a name's core.
FILLERS = {"the", "of", "and", "de", "la"}
#: Words of mentions that name nobody.
UNNAMED = {
    "nobody", "someone", "somebody", "anyone", "anybody", "everyone", "everybody", "stranger", "strangers", "narrator", "crowd", "people", "person", "man", "woman", "boy", "girl", "voice", "others",
    "other", "they", "them", "he", "she", "it", "him", "her", "we", "us", "you", "unknown", "none", "null", "nil", "na", "unnamed", "anonymous", "particular", "in", "a", "an", "the", "some", "any",
    "no", "one", "of", "old", "young", "another", "character", "figure",
}

#: Similarity of windows from which spellings must be brought together, and the chance with which they must be.
SIMILARITY, RECALL, ROWS = 0.5, 0.985, 3
LINK = 0.84
#: Members of a bucket, or rows of an entity, that one side of a join holds at most for one key; larger ones are split by salt.
SPLIT = 512
#: Links of a chat that one task clusters; a chat with more is clustered in rounds over all tasks, with the same result.
TASK_LINKS = 100_000
#: Short forms that keep a vowel and yet are abbreviations.
VOWEL_ABBREVIATIONS = ("hse", "bros", "soc", "inst", "auth")
SEED = 20_011


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands that bring a pair of this similarity together with at least this chance: 1 - (1 - s^rows)^bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for()
_SALTS = np.random.default_rng(SEED).integers(1, 2**63 - 1, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def words(text: str) -> list[str]:
    """A name's words in lower case: camel case, accents, look-alikes, remarks in brackets, possessives and signs undone; an abbreviation keeps its full stop."""
    s = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").translate(LOOKALIKES)
    s = re.sub(r"\([^()]*\)", " ", s)
    s = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-z])", " ", s)
    s = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    s = re.sub(r"[’'`]s\b", "", s).replace("&", " and ")
    return re.findall(r"[^\W_]+\.?", re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", s))


def core(text: str) -> list[str]:
    """The words that tell a name apart; empty for a mention that names nobody."""
    found = words(text)
    bare = [w.rstrip(".") for w in found]
    if not bare or all(w in UNNAMED for w in bare):
        return []
    kept = [w for w, b in zip(found, bare) if not (b in FILLERS and not w.endswith("."))]
    untitled = [w for w in kept if w.rstrip(".") not in TITLES]
    return untitled or kept


def is_full(name: list[str]) -> bool:
    """Whether a name stands by itself: two words of three letters or more, none of them abbreviated or a nickname."""
    return sum(len(w) >= 3 and not w.endswith(".") and w not in _SHORT for w in name) >= 2


_SHORT = {n for v in NICKNAMES.values() for n in v}
_LONG: dict[str, set[str]] = {}
for _full, _shorts in NICKNAMES.items():
    for _n in _shorts:
        _LONG.setdefault(_n, set()).add(_full)


@lru_cache(maxsize=200_000)
def token_similarity(a: str, b: str) -> float:
    """1 for the same word, less for a typing error, an initial, an abbreviation or a nickname, 0 for different words."""
    x, y = a.rstrip("."), b.rstrip(".")
    if x == y:
        return 1.0
    if len(x) > len(y):
        x, y, a, b = y, x, b, a
    if len(x) == 1:
        return 0.9 if y.startswith(x) else 0.0
    if x in NICKNAMES and y in NICKNAMES:
        return 0.0  # two given names, however near
    longs = _LONG.get(x, set())
    if longs and (y in longs or longs & _LONG.get(y, set()) or any(edits(f, y, 2 if len(f) > 6 else 1) <= (2 if len(f) > 6 else 1) for f in longs)):
        return 0.95
    most = (1 if len(x) == 3 and x[0] == y[0] and not {x, y} & _SHORT else 0) if len(y) < 4 else 1 if len(y) < 7 else 2
    d = edits(x, y, most)
    if d <= most:
        return 1 - d / len(y)
    if len(x) <= 4 and y[0] == x[0] and (y.startswith(x) or (a.endswith(".") or x in VOWEL_ABBREVIATIONS or not set("aeiou") & set(x)) and _within(x, y)):
        return 0.9
    if y.startswith(x) and len(x) >= 3:
        return 0.88
    shared = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
    if shared >= 3 and len(x) >= 5 and len(x) - shared <= 3 and len(y) - shared <= 3 and x[-1] != y[-1] and shared / len(y) >= 0.5:
        return 0.8  # another ending of the same stem
    return 0.0


def _within(short: str, long: str) -> bool:
    at = iter(long)
    return all(c in at for c in short)


def monge_elkan(a: list[str], b: list[str]) -> float:
    """Mean over the words of the shorter name, weighted by letters, of their best similarity to words of the other, each used once.

    0 if both names keep a word the other lacks, apart from middle initials.
    """
    if len(a) > len(b):
        a, b = b, a
    of_a: dict[int, float] = {}
    partner: dict[int, str] = {}
    used: set[int] = set()
    same: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        same.setdefault(y.rstrip("."), []).append(j)
    for i in range(len(a) - 1, -1, -1):  # equal words find each other first, so that long texts need not compare every word with every other
        if same.get(a[i].rstrip(".")):
            j = same[a[i].rstrip(".")].pop()
            of_a[i], partner[i] = 1.0, b[j]
            used.add(j)
    open_ = [j for j in range(len(b)) if j not in used]
    found = []
    for i, x in enumerate(a):
        if i not in of_a:
            near = [(s, i, j) for j in open_ if (s := token_similarity(x, b[j])) > 0]
            if max(near, default=(0.0,))[0] < 0.6 and not (not near and len(x.rstrip(".")) == 1 and len(a) > 2):
                return 0.0  # a word of its own: the rest need not be looked at
            found += near
    for s, i, j in sorted(found, reverse=True):
        if i not in of_a and j not in used:
            of_a[i], partner[i] = s, b[j]
            used.add(j)
    left = any(len(y.rstrip(".")) >= 3 for j, y in enumerate(b) if j not in used)
    if left and any(len(partner[i].rstrip(".")) == 1 < len(a[i].rstrip(".")) for i in of_a):
        return 0.0  # a middle initial beside a given name of its own stands for no other given name
    weight = total = 0.0
    strong = False
    for i, x in enumerate(a):
        size = len(x.rstrip("."))
        s = of_a.get(i, 0.0)
        if s == 0 and size == 1 and len(a) > 2:
            continue  # a middle initial
        if s < 0.6:
            return 0.0
        # an initial alone is no agreement; a nickname is
        strong = strong or (s >= 0.7 and (s == 0.95 or min(size, len(partner[i].rstrip("."))) >= 3 or s == 1.0 and size == 2)) if i in partner else strong
        weight += size
        total += size * s
    return total / weight if weight and strong else 0.0


def is_acronym(short: str, name: list[str], with_fillers: list[str]) -> bool:
    """Whether letters are the initials of a name, its small words counted or not."""
    letters = short.replace(".", "")
    return len(letters) >= 2 and letters in ("".join(w[0] for w in name), "".join(w[0] for w in with_fillers))


def similarity(a: str, b: str) -> float:
    """Similarity of two normal forms: Monge-Elkan over their words, in any order; within a name two or three initials may stand for as many words."""
    x, y = a.split(" "), b.split(" ")
    best = monge_elkan(x, y)
    if best < LINK:
        for short, long in ((x, y), (y, x)):
            for i, w in enumerate(short):
                letters = w.rstrip(".")
                if 2 <= len(letters) <= 4 and len(short) > 1:
                    for j in range(len(long) - len(letters) + 1):
                        if "".join(v[0] for v in long[j : j + len(letters)]) == letters:
                            best = max(best, 0.95 * monge_elkan(short[:i] + short[i + 1 :], long[:j] + long[j + len(letters) :]))
    return best


def resolve(mention: str | None, aliases: list[str | None] | None, candidate: str | None) -> tuple[str, bool]:
    """The normal form of a mention and whether it is a full name; empty for none.

    A full name stands for itself. A short one (initials, a nickname, a part, a title with a surname) takes the first of the
    candidate and the aliases that is full and agrees with it; hints that don't agree are not believed.
    """
    own = core(mention) if mention else []
    if not own:
        return "", False
    if is_full(own):
        return " ".join(own), True
    for hint in [candidate, *(aliases or [])]:
        other = core(hint) if hint else []
        if other and is_full(other):
            fits = similarity(" ".join(own), " ".join(other)) >= 0.75
            if not fits and len(own) == 1:
                with_fillers = [w for w in words(hint) if w not in ("the", "a", "an")]
                initials = "".join(w[0] for w in other)
                letters = own[0].replace(".", "")
                fits = is_acronym(own[0], other, with_fillers) or (len(letters) >= 2 and sorted(letters) == sorted(initials)) or _nearly(letters, [initials, "".join(w[0] for w in with_fillers)])
            if fits:
                return " ".join(other), True
    return " ".join(own), False


def _nearly(letters: str, initials: list[str]) -> bool:
    return len(letters) >= 3 and any(edits(letters, i, 1) <= 1 for i in initials)


def qgrams(name: str) -> set[str]:
    """Two-letter windows of every word, padded at both ends, so the order of words doesn't matter; a nickname has those of the names it is short for."""
    bare = (w.rstrip(".") for w in name.split(" "))
    return {p[i : i + 2] for w in bare for v in _LONG.get(w, (w,)) for p in (f"${v}$",) for i in range(len(p) - 1)}


class Signer:
    """MinHash signatures of names: the hashes of a window are computed once a process, minima over a name's windows for a batch at a time."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.hashes = np.empty((0, BANDS * ROWS), np.uint64)

    def _places(self, grams: list[str]) -> np.ndarray:
        import xxhash

        new = [g for g in dict.fromkeys(grams) if g not in self.place]
        if new:
            h = np.array([xxhash.xxh64_intdigest(g, seed=SEED) for g in new], np.uint64)[:, None]
            with np.errstate(over="ignore"):
                x = h * _SALTS[0] + _SALTS[1]  # modulo 2^64, mixed below
                x ^= x >> np.uint64(29)
                x *= np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            self.hashes = np.concatenate([self.hashes, x])
        return np.array([self.place[g] for g in grams], np.int64)

    def keys(self, names: list[str]) -> np.ndarray:
        """names x BANDS: one key for each band of a name's signature."""
        sets = [sorted(qgrams(n)) for n in names]
        starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
        places = self._places([g for x in sets for g in x])
        rows = np.minimum.reduceat(self.hashes[places], starts, axis=0).reshape(len(names), BANDS, ROWS)
        key = np.zeros((len(names), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                key = (key ^ rows[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(31)
        return key.view(np.int64)


def band_keys(name: str) -> list[int]:
    """One key for each band of the name's MinHash signature."""
    return Signer().keys([name])[0].tolist()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [resolve(m, a, c) for m, a, c in zip(*(b.column(k).to_pylist() for k in ("mention", "aliases", "canonical_name_candidate")))]
        yield pa.RecordBatch.from_arrays([b.column("mention_id"), b.column("chat_id"), b.column("mention"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.bool_())], ["mention_id", "chat_id", "mention", "name", "is_full"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer = Signer()
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            keys = signer.keys(part.column("name").to_pylist())
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("chat"), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))], ["id", "chat", "keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = np.array([similarity(x, y) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())])
        good = pa.array(s >= LINK)
        yield pa.RecordBatch.from_arrays([*(c.filter(good) for c in b.columns), pa.array(s, pa.float64()).filter(good)], [*b.schema.names, "s"])


def resolved_mentions(mentions: DataFrame) -> DataFrame:
    """mention_id, chat_id, mention, name (normal form), is_full; rows without chat, and mentions that name nobody, are left out."""
    rows = spread(mentions.select("mention_id", "chat_id", "mention", "aliases", "canonical_name_candidate").where("chat_id is not null and mention is not null"))
    kind = dict(mentions.dtypes)["mention_id"]
    return rows.mapInArrow(_named, f"mention_id {kind}, chat_id string, mention string, name string, is_full boolean").where("name <> ''")


def candidate_pairs(names: DataFrame) -> DataFrame:
    """id_a < id_b: stand-ins (xxhash64 of chat and name) of the names of one chat that share a band of their signatures.

    `names`: one row for each distinct name of a chat. A bucket of two gives its pair while it is counted; larger ones are joined with themselves, those of more than SPLIT members in as many
    parts as that takes, so that no task pairs a whole hot bucket. Two numbers a row are shuffled. Stand-ins that happen to be equal cost a comparison, no more.
    """
    marked = spread(names.select(F.xxhash64("chat_id", "name").alias("id"), F.xxhash64("chat_id").alias("chat"), "name"))
    opened = marked.mapInArrow(_banded, "id bigint, chat bigint, keys array<bigint>").select("id", "chat", F.posexplode("keys").alias("band", "key"))
    keyed = cut(opened.select("id", F.xxhash64("chat", "band", "key").alias("bucket")))
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("id_a"), F.max("id").alias("id_b")).where("n > 1 and id_a < id_b")
    buckets = cut(buckets)
    parts = F.ceil(F.col("n") / SPLIT).cast("bigint")
    members = keyed.join(buckets.where("n > 2").select("bucket", parts.alias("parts")), "bucket")
    left = members.select("bucket", F.col("id").alias("id_a"), F.pmod("id", "parts").alias("part"))
    right = members.select("bucket", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    met = left.join(right, ["bucket", "part"]).where("id_a < id_b").select("id_a", "id_b")
    return buckets.where("n = 2").select("id_a", "id_b").unionByName(met).distinct()


def link_edges(names: DataFrame) -> DataFrame:
    """chat_id, a, b, s and of both names n and is_full: the pairs of names of one chat that band together and are similar enough, in both directions.

    `names`: one row for each distinct name of a chat (chat_id, name, n, is_full).
    """
    kind = dict(names.dtypes)["chat_id"]
    told = lambda x: names.select(F.xxhash64("chat_id", "name").alias(f"id_{x}"), F.col("chat_id").alias(f"chat_{x}"), F.col("name").alias(x), F.col("n").alias(f"n_{x}"), F.col("is_full").alias(f"full_{x}"))
    pairs = candidate_pairs(names).join(told("a"), "id_a").join(told("b"), "id_b").where("chat_a = chat_b").select(F.col("chat_a").alias("chat_id"), "a", "b", "n_a", "full_a", "n_b", "full_b")
    # pairs come in the order of their keys: spread anew, so that the comparing is shared among all cores
    good = cut(pairs.repartition(F.col("chat_id"), F.col("a"), F.col("b")).mapInArrow(_verified, f"chat_id {kind}, a string, b string, n_a bigint, full_a boolean, n_b bigint, full_b boolean, s double"))
    other = good.select("chat_id", F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("full_b").alias("full_a"), F.col("n_a").alias("n_b"), F.col("full_a").alias("full_b"), "s")
    return good.unionByName(other)


def star_of(edges: list[tuple]) -> dict[str, str]:
    """The centre of every name of one chat's links (a, b, s, n_a, full_a, n_b); see `star_clusters`."""
    near: dict[str, dict[str, float]] = {}
    rank: dict[str, list] = {}
    for a, b, s, n_a, full_a, n_b in edges:
        near.setdefault(a, {})[b] = s
        rank.setdefault(a, [int(full_a), 2 * n_a, len(a), a])[1] += n_b
    centres: set[str] = set()
    out: dict[str, str] = {}
    for name in sorted(rank, key=rank.__getitem__, reverse=True):
        if not centres & near[name].keys():
            centres.add(name)
            out[name] = name
    for name in rank:
        if name not in centres:
            offers = sorted(((bool(rank[c][0]), near[name][c], c) for c in near[name].keys() & centres), reverse=True)
            tied = len(offers) > 1 and offers[0][:2] == offers[1][:2]
            out[name] = name if tied and not rank[name][0] else offers[0][2]
    return out


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters of chats whose links come one chat after the other."""
    chat, rows = None, []

    def done() -> pa.RecordBatch:
        found = star_of(rows)
        return pa.RecordBatch.from_arrays([pa.array([chat] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], ["chat_id", "name", "entity"])

    for b in batches:
        for c, *row in zip(*(b.column(k).to_pylist() for k in ("chat_id", "a", "b", "s", "n_a", "full_a", "n_b"))):
            if c != chat and rows:
                yield done()
                rows = []
            chat = c
            rows.append(row)
    if rows:
        yield done()


def star_clusters(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """chat_id, name, entity: star clustering of the similarity graph; names without a link are left out.

    Names are ranked: full names first, then by the rows their neighbourhood stands for. A name without a better-ranked free neighbour
    becomes a centre and takes its free neighbours; again until none is free. A name next to several centres goes to the most similar one; a short name as near to two stays by itself.
    Links are within chats: those of a chat with at most `task_links` of them are clustered in one task. Larger chats go in rounds in which all names
    decide at once, each two joins, whatever the size of chats or clusters. Both ways give the same clusters.
    """
    kind = dict(edges.dtypes)["chat_id"]
    sizes = edges.groupBy("chat_id").agg(F.count("*").alias("n_links"))
    large = cut(sizes.where(F.col("n_links") > task_links).select("chat_id"))

    def in_tasks(links: DataFrame) -> DataFrame:
        return links.repartition("chat_id").sortWithinPartitions("chat_id").mapInArrow(_starred, f"chat_id {kind}, name string, entity string")

    if large.isEmpty():
        return in_tasks(edges)
    return in_tasks(edges.join(large, "chat_id", "left_anti")).unionByName(_star_rounds(cut(edges.join(large, "chat_id", "left_semi"))))


def _star_rounds(edges: DataFrame) -> DataFrame:
    """`star_clusters` of chats of any size."""
    rank = F.struct(F.first("full_a").cast("int").alias("f"), (F.first("n_a") * 2 + F.sum("n_b")).alias("w"), F.length("a").alias("l"), F.col("a").alias("t"))
    ranked = cut(edges.groupBy("chat_id", "a").agg(rank.alias("rank"), F.first("full_a").alias("is_full")).withColumnRenamed("a", "name"))
    links = edges.select("chat_id", "a", "b", "s")
    free, centres = ranked.select("chat_id", "name", "rank"), None
    while True:
        other = free.select("chat_id", F.col("name").alias("b"), F.col("rank").alias("rank_b"))
        best = links.join(other, ["chat_id", "b"]).groupBy("chat_id", F.col("a").alias("name")).agg(F.max("rank_b").alias("best"))
        made = cut(free.join(best, ["chat_id", "name"], "left").where("best is null or rank > best").select("chat_id", "name"))
        centres = made if centres is None else centres.unionByName(made)
        taken = made.join(links.select("chat_id", F.col("a").alias("name"), "b"), ["chat_id", "name"]).select("chat_id", F.col("b").alias("name")).distinct()
        free = cut(free.join(made, ["chat_id", "name"], "left_anti").join(taken, ["chat_id", "name"], "left_anti"))
        if free.isEmpty():
            break
    centres = cut(centres)
    rest = ranked.join(centres, ["chat_id", "name"], "left_anti").select("chat_id", "name", "is_full")
    full = ranked.join(centres, ["chat_id", "name"], "left_semi").select("chat_id", F.col("name").alias("centre"), F.col("is_full").alias("to_full"))
    offers = rest.join(links.select("chat_id", F.col("a").alias("name"), F.col("b").alias("centre"), "s"), ["chat_id", "name"]).join(full, ["chat_id", "centre"])
    level = F.struct("to_full", "s")
    best = offers.groupBy("chat_id", "name", "is_full").agg(F.max(F.struct("to_full", "s", "centre")).alias("top"), F.max(level).alias("level"))
    ties = offers.join(best.select("chat_id", "name", "level"), ["chat_id", "name"]).where(level == F.col("level")).groupBy("chat_id", "name").agg(F.count("*").alias("ties"))
    placed = best.join(ties, ["chat_id", "name"]).select("chat_id", "name", F.when((F.col("ties") > 1) & ~F.col("is_full"), F.col("name")).otherwise(F.col("top.centre")).alias("entity"))
    return centres.select("chat_id", "name", F.col("name").alias("entity")).unionByName(placed)


def cluster_mentions(mentions: DataFrame) -> DataFrame:
    """mention_id, chat_id, mention, name, entity: every named mention with the centre of its cluster of spellings.

    Mentions are brought to a normal form, short ones by way of a candidate or alias that agrees with them (`resolve`). The distinct names of
    a chat are banded by MinHash over padded two-letter windows of their words, with as many bands as the collision curve asks for at the least similarity wanted,
    pairs are verified by Monge-Elkan similarity and names are clustered by star clustering.

    Null, blank and unnamed mentions, and rows without chat, have no row. Repeated rows have one each. Aliases and candidates may be null or wrong.
    """
    rows = cut(resolved_mentions(mentions))
    names = cut(rows.groupBy("chat_id", "name").agg(F.count("*").alias("n"), F.max("is_full").alias("is_full")))
    clusters = star_clusters(link_edges(names))
    return rows.join(clusters, ["chat_id", "name"], "left").select("mention_id", "chat_id", "mention", "name", F.coalesce("entity", "name").alias("entity"))


def mention_pairs(clustered: DataFrame) -> DataFrame:
    """(mention_id_a, mention_id_b), a < b: the rows of one chat and entity whose mentions are spelt differently.

    The list is as long as there are such pairs. An entity of more than SPLIT rows is joined in as many parts as that takes, so that no task pairs a whole hot entity.
    """
    rows = cut(clustered.select("mention_id", "chat_id", "entity", "mention"))
    sizes = rows.groupBy("chat_id", "entity").agg(F.count("*").alias("n"), F.min("mention").alias("first"), F.max("mention").alias("last")).where("first < last")
    sized = rows.join(sizes.select("chat_id", "entity", F.ceil(F.col("n") / SPLIT).cast("bigint").alias("parts")), ["chat_id", "entity"])
    a = sized.select("chat_id", "entity", F.col("mention_id").alias("mention_id_a"), F.col("mention").alias("mention_a"), F.pmod(F.xxhash64("mention_id"), "parts").alias("part"))
    b = sized.select("chat_id", "entity", F.col("mention_id").alias("mention_id_b"), F.col("mention").alias("mention_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["chat_id", "entity", "part"]).where("mention_id_a < mention_id_b and mention_a <> mention_b").select("mention_id_a", "mention_id_b")
