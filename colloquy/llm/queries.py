"""Queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.superkmers import drop_repeats

    return drop_repeats(read_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.secrets import digest_spans, secret_spans

    return digest_spans(secret_spans(read_table(spark, sf_dir, "documents")))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.merkle import neighbour_prints

    return neighbour_prints(read_table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.mpeg import media_digests, to_media

    return media_digests(to_media(read_table(spark, sf_dir, "documents")))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.parsing import drop_repeated_bytes

    return drop_repeated_bytes(read_table(spark, sf_dir, "documents"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.mixing import taken_words

    return taken_words(read_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.importance import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.weighted import near_classes

    return near_classes(read_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.urls import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages")).drop("score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.packing import best_fit_pack

    return best_fit_pack(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.negatives import hard_negatives

    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.collocations import collocations

    return collocations(read_table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from colloquy.llm.hamming import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from colloquy.llm import collocations, negatives, parsing, secrets, superkmers, urls

    return {
        "op1_substring_dedup": superkmers.oracle_sql(),
        "op2_secret_scans": secrets.oracle_sql(),
        "op5_suffix_array_dedup": parsing.oracle_sql(),
        "op9_url_filters": urls.oracle_sql(),
        "op11_hard_negatives": negatives.oracle_sql(),
        "op12_phrase_collocations": collocations.oracle_sql(),
    }
