"""The corpus pipeline: stages over ``documents``, each one operator of the text subpackage.

Counted as part of that subpackage. Every stage works on all its predecessor kept, and all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.llm import language, minhash, mixing, pieces, secrets
from tablegauge.session import durable, shared_folder

# A text is rejected if no language is sure to this degree.
LEAST_LANGUAGE_SCORE = 0.5
# Near duplicates share this percentage of their shingles of so many words.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without a letter or without a sure language; all go where nothing could be learned."""
    verdict = language.verdict(F.col("text"), language.learned(docs))
    judged = docs.withColumn("_verdict", verdict)
    sure = (F.col("_verdict.lang_pred") != "und") & (F.col("_verdict.score") >= LEAST_LANGUAGE_SCORE)
    return judged.where(sure).select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_node``: doc_id, and for rows without an id or that repeat one a number above all ids."""
    repeated = durable(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_id is null or _n > 1").select("_id"))
    named = docs.withColumn("_node", F.col("doc_id").cast("long"))
    if repeated.isEmpty():
        return named
    same = docs["doc_id"].eqNullSafe(F.col("_id"))
    odd = durable(docs.join(repeated, same, "left_semi"))
    most = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0)).alias("most")).first()["most"]
    # numbered once and stored: the same number wherever the row is read again
    odd = durable(odd.withColumn("_node", F.monotonically_increasing_id() + F.lit(most + 1)))
    return named.join(repeated, same, "left_anti").unionByName(odd)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the smallest id, a row with a sole id before others.

    Rows without an id and rows that repeat one are compared like any other.
    """
    rows = _numbered(docs)
    found = minhash.near_duplicates(rows.select(F.col("_node").alias("doc_id"), "text"), SHINGLE, PERCENT)
    kept = found.where("kept").select(F.col("doc_id").alias("_kept"))
    return rows.join(kept, F.col("_node") == F.col("_kept"), "left_semi").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; n_chars follows."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents, all of them, in the order of the mixing schedule; ``encode`` reads their places from the written files."""
    placed = mixing.mixed(docs, whole=True).select("position", "row")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``, from 0 without gaps: the order of its numbered part files and of the rows in each.

    Readers pack files by size, so the order is taken from file names and row numbers. A table that is not
    read from part files is in the order of its partitions.
    """
    files = docs.inputFiles() and F.col("_metadata.file_name")
    try:
        rows = docs.select("*", F.regexp_extract(files, r"^part-(\d+)", 1).try_cast("long").alias("_part"), files.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except (AnalysisException, AttributeError, TypeError):
        place = F.monotonically_increasing_id()
        rows = durable(docs.select("*", F.shiftright(place, 33).alias("_part"), F.lit("").alias("_file"), place.bitwiseAND((1 << 33) - 1).alias("_row")))
    sizes = rows.groupBy("_part", "_file").agg(F.count("*").alias("_n"))
    # a row per file
    before = Window.partitionBy(F.lit(0)).orderBy("_part", "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_p"), F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_part").eqNullSafe(F.col("_p")) & (F.col("_file") == F.col("_f"))
    return rows.join(F.broadcast(offsets), same).select(*docs.columns, (F.col("_offset") + F.col("_row")).alias("position"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes, round_trip, ids and position (the place in the mixing schedule) of every document."""
    rows = in_order(docs).select(F.struct("doc_id", "position").alias("doc_id"), "text")
    found = pieces.encoded(rows)
    return found.select("doc_id.doc_id", *[c for c in found.columns if c != "doc_id"], "doc_id.position")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("encode", encode),
]
# Models and piece ids cannot be expressed in SQL: tests/llm checks the rows against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
