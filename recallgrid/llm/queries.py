"""Queries of the operators on text, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import spread
from ..sources import table
from .canonical import all_typed_values, map_values, unmatched_report
from .language import fit_profiles, language_findings, read_languages
from .mixing import mix_sources
from .names import cluster_mentions, mention_pairs
from .splitting import oversized, split_oversized, split_runs
from .truncation import judge_texts, truncation_rates
from .tokens import count_tokens, encode_corpus


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return all_typed_values({t: table(spark, d, t) for t in ("commitments", "relationship_changes", "temporal_marks", "episode_events")})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return map_values(_typed(spark, d), table(spark, d, "canonical_values"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return unmatched_report(map_values(_typed(spark, d), table(spark, d, "canonical_values"), with_value=True))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(table(spark, d, "messages"), "message_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "messages"), ["message_id"])


def p2_run_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_runs(table(spark, d, "messages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mention_pairs(cluster_mentions(table(spark, d, "entity_mentions")))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster_mentions(table(spark, d, "entity_mentions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return judge_texts(table(spark, d, "segments")).where("is_cut").select("segment_row_id", "field_name")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(judge_texts(table(spark, d, "segments")))


def p5_judged(spark: SparkSession, d: str) -> DataFrame:
    return judge_texts(table(spark, d, "segments"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")), ["doc_id"])


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(spread(table(spark, d, "documents").select("doc_id", "source", "text")), ["doc_id", "source"])


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).uses


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def _read(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return read_languages(documents, ["doc_id", "lang"], fit_profiles(documents))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language_findings(_read(spark, d))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    read = _read(spark, d)
    return read.select("doc_id", "lang_found", F.col("confidence").alias("document_confidence"), F.posexplode_outer("segments").alias("segment_no", "s")).select("doc_id", "lang_found", "document_confidence", "segment_no", "s.*")


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_run_pieces": p2_run_pieces, "p4_found": p4_found, "p4_clusters": p4_clusters, "p5_found": p5_found, "p5_rates": p5_rates, "p5_judged": p5_judged, "p6_ids": p6_ids, "p6_counts": p6_counts, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_segments": p8_segments}

SQL: dict[str, str] = {
    "p2_found": "select message_id from messages where ceil(length(text) / 4) > 900",
}
