"""The queries of this package and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, embeddings, language, lines, packing, simhash, spans, toxicity, urls, warc
from .common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every vector."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item, and that item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page after a round trip through WARC archives."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in training sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat a passage from before."""
    return spans.substring_dedup(table(spark, sf_dir, "documents"), ends_too=True)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the list entries that were valid when it was fetched."""
    pages = table(spark, sf_dir, "pages")
    return urls.url_filter(urls.derived_captures(pages), urls.derived_entries(pages))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three folds of four."""
    return language.held_out_languages(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its site's boilerplate lines."""
    return lines.line_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score and offending words of every document, learned from two folds of three."""
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_packing": op4_packing,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLE: dict[str, str] = {
    "op7_url_filters": urls.ORACLE,
    "op9_line_dedup": lines.ORACLE,
}
