"""Search over a corpus against brute force, and what it moves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recallgrid.operators import retrieval as R


def bm25_by_brute_force(docs, terms, k):
    words = {i: t.split() for i, t in docs}
    n, avg = len(docs), max(1.0, sum(map(len, words.values())) / len(docs))
    df = {t: sum(t in w for w in words.values()) for _, t in terms}
    out = set()
    for q in {q for q, _ in terms}:
        rows = []
        for i, w in words.items():
            hits = [(t, w.count(t)) for x, t in set(terms) if x == q and t in w]
            score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t, tf in hits)
            rows += [(-round(score, 9), i, len(hits))] if hits else []
        out |= {(q, i, -s, m, place) for place, (s, i, m) in enumerate(sorted(rows)[:k], 1)}
    return out


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_streamed_bm25_equals_brute_force(spark, kind):
    """All documents, in small blocks and in passes over few queries; equal documents, empty ones, frequent terms and terms that no document has."""
    r = random.Random(3)
    key = int if kind == "bigint" else (lambda i: f"d{i}")
    texts = ["", "solo", *(" ".join(r.choice(["harbour", *(f"w{int(r.expovariate(0.2))}" for _ in range(9))]) for _ in range(r.randint(1, 30))) for _ in range(198))]
    docs = [(key(i), texts[i % 200 if i < 300 else 7]) for i in range(340)]
    terms = [(key(q), f"w{int(r.expovariate(0.2))}") for q in range(20) for _ in range(6)] + [(key(q), "harbour") for q in range(10)] + [(key(21), "unheard"), (key(22), "solo")]
    rows = spark.createDataFrame(docs, f"doc_id {kind}, text string").select("doc_id", F.filter(F.split("text", " "), lambda x: x != "").alias("words")).repartition(3)
    asked, want = spark.createDataFrame(terms, f"query_id {kind}, term string"), bm25_by_brute_force(docs, terms, 5)
    for block, most in ((4_000_000, 1_000_000), (300, 1_000_000), (1, 25)):
        found = R.bm25_top_k(rows, asked, 5, most, block)
        assert {(x["query_id"], x["doc_id"], round(x["score"], 9), x["matched"], x["place"]) for x in found.collect()} == want
    assert R.bm25_top_k(rows, asked.where("query_id is null"), 5).count() == R.bm25_top_k(rows.limit(0), asked, 5).count() == 0


def test_equal_documents_cost_no_more_than_k_rows():
    score = np.array([1.0, 3.0, 2.0] + [2.0] * 500 + [2.0 + 2e-10])
    keep = R._best_of(score, np.arange(len(score)), 3)
    assert sorted(keep) == [1, 2, 3, 4, 503]


def records_moved(spark):
    """Records that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_bm25_topk_makes_no_rows_of_pairs(spark, tmp_path):
    """The pairs of queries and documents grow with the square of the table: shuffled, 1 GB of tables filled the disk."""
    n = 3000
    rows = [(i, f"s{i}", "c", i, i, "valid", f"the harbour lantern keeper w{i % 7}") for i in range(n)]
    spark.createDataFrame(rows, "segment_row_id bigint, segment_id string, chat_id string, first_index int, last_index int, status string, synopsis string").withColumn("updated_at", F.lit(None).cast("timestamp")).write.parquet(f"{tmp_path}/segments.parquet")
    before = records_moved(spark)
    assert entry.queries()["bm25_topk"](spark, str(tmp_path)).count() == 5 * n // 50
    assert records_moved(spark) - before < 10 * n < n * n // 50
