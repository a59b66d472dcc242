"""Lexical and vector search: postings, BM25, query terms, cosine, hybrid ranking and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import search_tokens
from ..functions.runtime import cut, spread
from ..functions.vocabulary import STOP_WORDS

K1, B = 1.2, 0.75
#: Vectors of the queries that one task compares at once.
QUERY_BLOCK = 512
#: Numbers that a query set held by every task has at most (64 MB); larger sets meet the vectors block by block.
MOST_QUERY_CELLS = 8_000_000
#: Postings of a term that one join key holds at most.
HOT_TERM = 1_000_000
#: Words of queries that every task holds at once; larger query sets go past the documents in several passes.
MOST_ASKED = 2_000_000
#: Words of documents that a task indexes at once, and the slices whose best scores bound those of a block.
BLOCK_WORDS, SLICES = 4_000_000, 64
#: Scores nearer than this may be equal in the digits of the ranking.
CLOSE = 1e-8


def postings(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term, tf. documents: doc_id and a text; null texts have no terms."""
    words = documents.select("doc_id", F.explode(search_tokens(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_stats(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, length (words that count)."""
    return documents.select("doc_id", F.size(search_tokens(F.coalesce(F.col(text), F.lit("")))).alias("length"))


def query_terms(queries: DataFrame, text: str = "text", most: int = 32) -> DataFrame:
    """query_id, term, place: the words of a query by frequency, then alphabet, without stop words, the first `most`."""
    words = queries.select("query_id", F.explode(search_tokens(F.coalesce(F.col(text), F.lit("")))).alias("term")).where(~F.col("term").isin(*STOP_WORDS))
    counted = words.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("query_id").orderBy(F.col("n").desc(), "term")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "term", "place")


def bm25(index: DataFrame, stats: DataFrame, terms: DataFrame, within: str | None = None) -> DataFrame:
    """query_id, doc_id, score, matched: BM25 of every document that shares a term with a query. k1 = 1.2, b = 0.75.

    With `within`, a column of the index and of the terms, only documents of the query's own group are met; the statistics stay those of all documents.
    Terms meet postings by the term (and group). A term of more than HOT_TERM postings is spread: its postings by document over as many parts as that takes, its queries repeated to them.
    """
    totals = stats.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.avg("length")).alias("avg_length"))
    keys = ["term", *([within] if within else [])]
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    wanted = terms.select("query_id", *keys).distinct().join(df, "term").crossJoin(F.broadcast(totals))  # totals: one row
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    parts = F.ceil(F.col("df") / HOT_TERM).cast("bigint")
    weighted = wanted.select("query_id", *keys, idf.alias("idf"), "avg_length", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    # only terms that are asked for: the rest of the index isn't moved
    asked = wanted.select("term", parts.alias("parts")).distinct()
    spread_ = index.join(asked, "term").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).drop("parts")
    hits = spread_.join(weighted, [*keys, "part"]).join(stats, "doc_id")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))


class _Asked:
    """Queries as words by number: those of query i are words[starts[i]:starts[i + 1]], their texts and idf by number."""

    def __init__(self, rows: pa.Table) -> None:
        ids, terms = rows["query_id"].combine_chunks().dictionary_encode(), rows["term"].combine_chunks().dictionary_encode()
        query, word = ids.indices.to_numpy(), terms.indices.to_numpy()
        self.ids, self.terms, self.idf = ids.dictionary, terms.dictionary, np.empty(len(terms.dictionary))
        self.idf[word] = rows["idf"].to_numpy()
        self.words = word[np.argsort(query, kind="stable")]
        self.starts = np.searchsorted(np.sort(query), np.arange(len(self.ids) + 1))


class _Index:
    """What each word that is asked for adds to the score of each document of a block, by word; the words of each document. Places of documents are in the order of their ids."""

    def __init__(self, ids: pa.Array, words: pa.ListArray, asked: _Asked, avg_length: float) -> None:
        order = pc.sort_indices(ids)
        self.ids, words = ids.take(order), words.take(order)
        self.n = len(ids)
        length = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        term = pc.index_in(words.flatten(), value_set=asked.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(self.n, dtype=np.int64), length)[term >= 0]
        key, tf = np.unique(term[term >= 0] * np.int64(self.n) + at, return_counts=True)
        term, self.at = key // self.n, key % self.n
        self.adds = asked.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.at] / avg_length))
        self.starts = np.searchsorted(term, np.arange(len(asked.terms) + 1))
        self.doc_terms, self.doc_starts = term[np.argsort(self.at, kind="stable")], np.append(0, np.cumsum(np.bincount(self.at, minlength=self.n)))
        self.wanted = np.zeros(len(asked.terms), bool)

    def best(self, words: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, scores and matches of the documents that can be among a query's k best, given that k documents seen before reach `floor`.

        A score is summed in the order of the words, so like documents get the same number to the last bit.
        """
        spans = [slice(a, b) for a, b in zip(self.starts[words], self.starts[words + 1]) if a < b]
        if not spans:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        score = np.bincount(np.concatenate([self.at[s] for s in spans]), np.concatenate([self.adds[s] for s in spans]), self.n)
        if k <= SLICES <= self.n:  # the best of each slice are as many documents as slices: the k-th of these is a bound that needs no sorting
            tops = score[: self.n // SLICES * SLICES].reshape(SLICES, -1).max(axis=1)
            floor = max(floor, np.partition(tops, -k)[-k] - CLOSE)
        docs = np.flatnonzero((score >= floor) & (score > 0))
        docs = docs[_best_of(score[docs], docs, k)]
        self.wanted[words] = True
        matched = [np.count_nonzero(self.wanted[self.doc_terms[a:b]]) for a, b in zip(self.doc_starts[docs], self.doc_starts[docs + 1])]
        self.wanted[words] = False
        return docs, score[docs], np.array(matched, np.int64)


def _best_of(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Which can be among the k best by rounded score, then place: all that come near the k-th, but of equal scores no more than the first k."""
    if len(score) <= k:
        return np.arange(len(score))
    near = np.flatnonzero(score >= np.partition(score, -k)[-k] - CLOSE)
    near = near[np.lexsort((place[near], -score[near]))]
    new = np.append(True, score[near][1:] != score[near][:-1])
    return near[np.arange(len(near)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]


def bm25_top_k(documents: DataFrame, terms: DataFrame, k: int, most_asked: int = MOST_ASKED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """query_id, doc_id, score, matched, place: the k best documents of each query by BM25, over all documents; scores as in `bm25`.

    documents: doc_id (unique), words (array of those that count), read several times; terms: query_id, term. The pairs of queries and documents that share a term are never rows: the words of the queries, which are
    counted, are handed to all tasks and the documents stream past them without a shuffle. A task indexes a block of documents at a time and yields what can be among the k best. Larger query sets go in parts of about
    `most_asked` words, each a pass of its own. Exact either way.
    """
    kinds = dict(documents.dtypes)["doc_id"], dict(terms.dtypes)["query_id"]
    schema = f"query_id {kinds[1]}, doc_id {kinds[0]}, score double, matched bigint"
    totals = documents.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.avg(F.size("words"))).alias("avg_length")).first()
    df = documents.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0) + (F.lit(totals["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = cut(terms.select("query_id", "term").distinct().join(df, "term").select("query_id", "term", idf.alias("idf")))
    passes = max(1, -(-weighted.count() // most_asked))
    slim, avg_length = spread(documents.select("doc_id", "words")), totals["avg_length"]

    def one_pass(part: DataFrame) -> DataFrame:
        held = weighted.sparkSession.sparkContext.broadcast(_Asked(part.toArrow()))

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked: _Asked = held.value
            if not len(asked.ids):
                return
            floor = np.zeros(len(asked.ids))
            for ids, words in _blocks(batches, block_words):
                index = _Index(ids, words, asked, avg_length)
                found = []
                for q in range(len(asked.ids)):
                    docs, score, matched = index.best(asked.words[asked.starts[q] : asked.starts[q + 1]], k, floor[q])
                    if len(docs) >= k:
                        floor[q] = max(floor[q], np.partition(score, -k)[-k] - CLOSE)
                    found.append((np.full(len(docs), q), docs, score, matched))
                of, docs, score, matched = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(of)), index.ids.take(pa.array(docs)), pa.array(score), pa.array(matched)], ["query_id", "doc_id", "score", "matched"])

        return slim.mapInArrow(stream, schema)

    parts = [weighted] if passes == 1 else [weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) for i in range(passes)]
    scored = one_pass(parts[0])
    for part in parts[1:]:
        scored = scored.unionByName(one_pass(part))
    return top_k(scored, k)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Ids and words of documents, about `size` words at a time; a document stays whole."""
    held, n = [], 0

    def block() -> tuple[pa.Array, pa.ListArray]:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return whole.column("doc_id"), whole.column("words")

    for batch in batches:
        ends, at = np.append(0, np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))), 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size - n, "right")) - 1)
            held.append(batch.slice(at, to - at))
            n, at = n + int(ends[to] - ends[at]), to
            if n >= size or at < len(batch):
                yield block()
                held, n = [], 0
    if held:
        yield block()


def top_k(scored: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best rows of each query by score (compared after rounding), then doc_id, with their place."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", digits).desc(), "doc_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if they differ in length, are empty or null, or one is all zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    both = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (both > 0), dot / both), F.lit(0.0))


def _packed(rows: DataFrame, id_: str, size: int) -> DataFrame:
    """Rows of about `size` vectors each: ids and embeddings side by side."""
    n = max(1, -(-rows.count() // size))
    block = F.pmod(F.xxhash64(id_), F.lit(n))
    pairs = F.collect_list(F.struct(F.col(id_).alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")))
    return rows.where(F.size("embedding") > 0).groupBy(block.alias("block")).agg(pairs.alias("pairs")).select(F.col("pairs.id").alias("ids"), F.col("pairs.v").alias("vs"))


def _unit(vectors: list[list[float]], width: int) -> np.ndarray:
    m = np.array([v if len(v) == width and None not in v else [0.0] * width for v in vectors], float)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class _Best:
    """The k best vectors of every query seen so far in a task, ties at the end included."""

    def __init__(self, ids: list, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = [np.empty(0)] * len(ids)
        self.found: list[np.ndarray] = [np.empty(0, object)] * len(ids)
        self.floor = np.zeros(len(ids))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self.vectors @ vectors.T
        for i in np.flatnonzero((scores > self.floor[:, None]).any(axis=1)):
            s = np.concatenate([self.score[i], scores[i][scores[i] > self.floor[i]]])
            d = np.concatenate([self.found[i], ids[scores[i] > self.floor[i]]])
            keep = d != self.ids[i]
            s, d = s[keep], d[keep]
            if len(s) > self.k:
                least = np.partition(s, -self.k)[-self.k] - 1e-8
                s, d = s[s >= least], d[s >= least]
                self.floor[i] = max(0.0, least - 1e-8)
            self.score[i], self.found[i] = s, d


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, most_cells: int = MOST_QUERY_CELLS) -> DataFrame:
    """query_id, doc_id, score, place: the k vectors nearest each query by cosine, itself left out, those at or below 0 too.

    vectors: doc_id, embedding; queries: query_id, embedding (an id of the same kind). A query set of at most `most_cells` numbers, which are counted, is handed to all tasks; the vectors stream past it in one pass
    without a shuffle and each task keeps its k best for each query. A larger set is packed into blocks, and so are the vectors; every block of one meets every block of the other in a matrix product. Both ways are exact.
    Null and empty vectors are near nothing, nor are vectors of another length.
    """
    kind = dict(vectors.dtypes)["doc_id"]
    schema = f"query_id {kind}, doc_id {kind}, score double"
    asked = queries.where(F.size("embedding") > 0).select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    cells = asked.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("n")).first()["n"]
    if cells <= most_cells:
        by_width: dict[int, list] = {}
        for r in asked.collect():  # as many numbers as were counted
            by_width.setdefault(len(r["embedding"]), []).append((r["query_id"], r["embedding"]))
        held = vectors.sparkSession.sparkContext.broadcast({w: ([r[0] for r in rows], _unit([r[1] for r in rows], w)) for w, rows in by_width.items()})

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {w: _Best(ids, m, k) for w, (ids, m) in held.value.items()}
            for batch in batches:
                rows = [(i, v) for i, v in zip(batch.column("doc_id").to_pylist(), batch.column("embedding").to_pylist()) if v]
                for w, b in best.items():
                    own = [r for r in rows if len(r[1]) == w]
                    for at in range(0, len(own), 4 * QUERY_BLOCK):
                        part = own[at : at + 4 * QUERY_BLOCK]
                        b.add(np.array([r[0] for r in part], object), _unit([r[1] for r in part], w))
            for b in best.values():
                for query, s, d in zip(b.ids, b.score, b.found):
                    if len(s):
                        yield pa.RecordBatch.from_pydict({"query_id": [query] * len(s), "doc_id": d.tolist(), "score": s.tolist()})

        slim = spread(vectors.select("doc_id", "embedding"))
        return top_k(slim.mapInArrow(stream, schema), k)
    asked_blocks = _packed(queries, "query_id", QUERY_BLOCK).select(F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    data = _packed(vectors, "doc_id", 4 * QUERY_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                widths = {len(v) for v in row["q_vs"]}
                for w in widths:
                    asked_ = [(i, v) for i, v in zip(row["q_ids"], row["q_vs"]) if len(v) == w]
                    b = _Best([a[0] for a in asked_], _unit([a[1] for a in asked_], w), k)
                    own = [(i, v) for i, v in zip(row["ids"], row["vs"]) if len(v) == w]
                    if own:
                        b.add(np.array([o[0] for o in own], object), _unit([o[1] for o in own], w))
                    for query, s, d in zip(b.ids, b.score, b.found):
                        if len(s):
                            yield pa.RecordBatch.from_pydict({"query_id": [query] * len(s), "doc_id": d.tolist(), "score": s.tolist()})

    return top_k(data.crossJoin(asked_blocks).mapInArrow(run, schema), k)


def cosine_within(vectors: DataFrame, queries: DataFrame, group: str) -> DataFrame:
    """query_id, doc_id, score: the cosine of each query with every vector of its group, those above 0. Blocks of a group's vectors meet blocks of its queries.

    vectors: doc_id, `group`, embedding; queries: query_id, `group`, embedding.
    """
    kind = dict(vectors.dtypes)["doc_id"]

    def packed(rows: DataFrame, id_: str, size: int) -> DataFrame:
        counts = rows.groupBy(group).agg(F.ceil(F.count("*") / size).cast("bigint").alias("parts"))
        pairs = F.collect_list(F.struct(F.col(id_).alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v")))
        return rows.where(F.size("embedding") > 0).join(counts, group).groupBy(group, F.pmod(F.xxhash64(id_), "parts").alias("part")).agg(pairs.alias("pairs")).select(group, F.col("pairs.id").alias(f"{id_}s"), F.col("pairs.v").alias(f"{id_}_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = len(row["query_id_v"][0])
                scores = _unit(row["query_id_v"], width) @ _unit(row["doc_id_v"], width).T
                at, to = np.nonzero(scores > 0)
                yield pa.RecordBatch.from_pydict({"query_id": [row["query_ids"][i] for i in at], "doc_id": [row["doc_ids"][j] for j in to], "score": scores[at, to].tolist()})

    met = packed(vectors, "doc_id", 2 * QUERY_BLOCK).join(packed(queries, "query_id", QUERY_BLOCK), group)
    return met.mapInArrow(run, f"query_id {kind}, doc_id {kind}, score double")


def hybrid_top_k(documents: DataFrame, queries: DataFrame, lexical: DataFrame, semantic: DataFrame | None, boosts: DataFrame | None, k: int, semantic_weight: float = 0.75, recency_weight: float = 0.15, half_life: int = 200, group: str = "chat_id") -> DataFrame:
    """query_id, doc_id, lexical, semantic, boost, recency, score, place: the k best candidates of each query.

    documents: doc_id, `group`, last_index; queries: query_id, `group`. A query's candidates are the other documents of its group. lexical, semantic: query_id, doc_id, score; boosts: query_id, doc_id, boost. A
    candidate without any of these has no score, so the ranking starts from what they found and never lists all candidates. Recency counts the messages behind the newest candidate of the query.
    """
    keys = ["query_id", "doc_id"]
    zero = F.lit(0.0)
    found = lexical.select(*keys, F.col("score").alias("lexical"), zero.alias("semantic"), zero.alias("boost"))
    if semantic is not None:
        found = found.unionByName(semantic.select(*keys, zero.alias("lexical"), F.greatest(zero, "score").alias("semantic"), zero.alias("boost")))
    if boosts is not None:
        found = found.unionByName(boosts.select(*keys, zero.alias("lexical"), zero.alias("semantic"), F.col("boost").cast("double").alias("boost")))
    own = queries.select("query_id", group)
    placed = found.where("query_id <> doc_id").join(own, "query_id").join(documents.select("doc_id", group, "last_index"), ["doc_id", group])
    rows = placed.groupBy(*keys, group).agg(F.max("last_index").alias("last_index"), *(F.sum(c).alias(c) for c in ("lexical", "semantic", "boost")))
    # the newest other document: the newest of the group, or the one before where that is the query itself
    first = documents.groupBy(group).agg(F.max(F.struct("last_index", "doc_id")).alias("top"))
    second = documents.join(first, group).where(F.col("doc_id") != F.col("top.doc_id")).groupBy(group).agg(F.max("last_index").alias("next"))
    newest = own.join(first, group).join(second, group, "left").select("query_id", F.when(F.col("top.doc_id") == F.col("query_id"), F.col("next")).otherwise(F.col("top.last_index")).alias("newest"))
    base = F.col("lexical") + F.col("semantic") * semantic_weight + F.col("boost")
    aged = rows.join(newest, "query_id").withColumn("base", base).where("base > 0")
    recency = F.lit(1.0) / (1 + (F.col("newest") - F.col("last_index")) / max(1, half_life))
    scored = aged.withColumn("recency", F.coalesce(recency, zero)).withColumn("score", F.col("base") + F.col("recency") * recency_weight)
    return top_k(scored.select(*keys, "lexical", "semantic", "boost", "recency", "score"), k)


def keys_of_documents(documents: DataFrame, families: dict[str, DataFrame]) -> DataFrame:
    """doc_id, kind, key: the distinct keys a document is found by besides its words. documents: doc_id, segment_id; families, by kind: segment_id, key."""
    rows = None
    for kind, df in families.items():
        part = df.where("key is not null").select("segment_id", F.lit(kind).alias("kind"), "key")
        rows = part if rows is None else rows.unionByName(part)
    return rows.distinct().join(documents.select("doc_id", "segment_id"), "segment_id").select("doc_id", "kind", "key")


def key_boosts(document_keys: DataFrame, query_keys: DataFrame, exact_boost: float = 2.0, within: str | None = None) -> DataFrame:
    """query_id, doc_id, boost: matches of keys. *_keys: doc_id or query_id, kind, key; distinct. With `within`, a column of both, only keys of the same group meet.

    Threads and commitments count `exact_boost` a match, entities and registers 0.75 of it, the active speaker 0.5, participants 0.25.
    """
    weight = {"thread": 1.0, "commitment": 1.0, "entity": 0.75, "register": 0.75, "speaker": 0.5, "participant": 0.25}
    w = F.lit(0.0)
    for kind, x in weight.items():
        w = F.when(F.col("kind") == kind, F.lit(exact_boost * x)).otherwise(w)
    of = F.when(F.col("kind").isin("speaker", "participant"), "entity").otherwise(F.col("kind"))
    group = [within] if within else []
    asked = query_keys.select("query_id", "kind", of.alias("doc_kind"), "key", *group)
    found = document_keys.select("doc_id", F.col("kind").alias("doc_kind"), "key", *group).join(asked, ["doc_kind", "key", *group])
    return found.groupBy("query_id", "doc_id").agg(F.sum(w).alias("boost"))


def retrieval_quality(results: DataFrame, relevant: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: k, n_queries, recall_at_k, precision_at_k, mrr. results: query_id, doc_id, place; relevant: query_id, doc_id; queries: query_id.

    A query with nothing relevant has recall 1; precision divides by what was returned.
    """
    got = results.where(F.col("place") <= k).join(relevant.select("query_id", "doc_id", F.lit(1).alias("hit")).distinct(), ["query_id", "doc_id"], "left")
    per = got.groupBy("query_id").agg(F.count("*").alias("returned"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("place"))).alias("first"))
    size = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("expected"))
    all_ = queries.select("query_id").distinct().join(per, "query_id", "left").join(size, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    recall = F.when(F.coalesce("expected", F.lit(0)) > 0, hits / F.col("expected")).otherwise(1.0)
    precision = F.when(F.coalesce("returned", F.lit(0)) > 0, hits / F.col("returned")).otherwise(0.0)
    mrr = F.coalesce(1 / F.col("first"), F.lit(0.0))
    return all_.agg(F.lit(k).alias("k"), F.count("*").alias("n_queries"), F.avg(recall).alias("recall_at_k"), F.avg(precision).alias("precision_at_k"), F.avg(mrr).alias("mrr"))
