"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import collocations, encode, fingerprints, lexical, line_dedup, media, mixing, near_dedup, passages, quality, repeats, token_counts, toxicity
from folioscope.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.page_line_dedup(read(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.sentencepiece_encode(read(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_dedup(read(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(read(spark, sf_dir, "documents"), k=4)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.kept_digests(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_media_columns": op3_media_columns,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_repeats": op5_repeats,
    "op6_near_dedup": op6_near_dedup,
    "op7_order_minhash": op7_order_minhash,
    "op8_source_mix": op8_source_mix,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_passages": op12_passages,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.PAGES_SQL,
    "op5_repeats": repeats.DOCUMENTS_SQL,
    "op6_near_dedup": near_dedup.DOCUMENTS_SQL,
    "op8_source_mix": mixing.DOCUMENTS_SQL,
    "op11_lexical_search": lexical.DOCUMENTS_SQL,
    "op12_passages": passages.DOCUMENTS_SQL,
    "op13_collocations": collocations.DOCUMENTS_SQL,
}
