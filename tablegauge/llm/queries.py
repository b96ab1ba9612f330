"""Registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablegauge.llm import (
    article,
    fill_middle,
    language,
    line_runs,
    merkle,
    minhash,
    mixing,
    pieces,
    quality,
    secrets,
    spotsigs,
    toxicity,
    warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(_table(spark, folder, "documents"))


def op2_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.compared(_table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(_table(spark, folder, "pages"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(_table(spark, folder, "documents"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encoded(_table(spark, folder, "documents"))


def op9_article(spark: SparkSession, folder: str) -> DataFrame:
    return article.extracted(_table(spark, folder, "pages"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.report(_table(spark, folder, "documents"))


def op12_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return line_runs.report(_table(spark, folder, "documents"))


def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.report(_table(spark, folder, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_spotsigs": op2_spotsigs,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_minhash": op6_minhash,
    "op7_language": op7_language,
    "op8_pieces": op8_pieces,
    "op9_article": op9_article,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_line_runs": op12_line_runs,
    "op13_fill_middle": op13_fill_middle,
}
ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_line_runs": line_runs.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
