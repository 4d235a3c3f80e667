"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import decontaminate, embedding_dedup, hilbert_shards, html_extract, language_id, licenses, ngram_join, packing, quality, warc
from vectorloom.llm.common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all of ``embeddings`` at cosine 0.95; odd vectors link with nothing."""
    return embedding_dedup.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages`` written as archives and read back, a row for each; null html is an empty payload."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of 2048 tokens; duplicate clusters are equal texts, null and blank ones conflict with nothing."""
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``; ``und`` where it is null or has no letter."""
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each license statement in ``documents``; null and empty texts hold none."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op6_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item of ``benchmark`` that it holds; null and empty texts hold none."""
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 24 shards of equal counts; a null text has size 8 and CRC 0."""
    return hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op8_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all of ``pages``; null and empty pages have the empty text."""
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posterior quality of all of ``documents``, learned from ``labels``; null and empty texts are judged by their site."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all of ``documents`` by three-word sets at 0.9; texts without words link with nothing."""
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_warc_round_trip, op3_best_fit_pack, op4_language_id, op5_license_scan, op6_benchmark_matches, op7_hilbert_shards, op8_extract_pages, op9_quality, op10_ngram_join)}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": embedding_dedup.oracle(), "op2_warc_round_trip": warc.oracle(), "op7_hilbert_shards": hilbert_shards.oracle(), "op10_ngram_join": ngram_join.oracle()}
