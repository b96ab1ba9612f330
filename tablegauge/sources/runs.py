"""Run records: one JSON document per run with its settings and metric history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HISTORY = "array<map<string,string>>"


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, text) of one JSON file per run; the folder names the run."""
    files = spark.read.text(path, wholetext=True)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return files.select(folder.alias("run_id"), F.col("value").alias("text"))


def _history(text: Column) -> Column:
    """The list under "metrics", or the document itself when it is a list."""
    wrapped = F.from_json(text, f"struct<metrics:{_HISTORY}>")["metrics"]
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, _HISTORY)).otherwise(wrapped)


def run_metrics(records: DataFrame) -> DataFrame:
    """(run_id, seq, metric, value) of numeric history entries; unreadable runs drop."""
    rows = records.select("run_id", F.posexplode(_history(F.col("text"))).alias("seq", "row"))
    pairs = rows.select("run_id", "seq", F.explode("row").alias("metric", "text"))
    return pairs.select("run_id", "seq", "metric", F.col("text").try_cast("double").alias("value")).where(
        "value IS NOT NULL"
    )


def run_config(records: DataFrame) -> DataFrame:
    """(run_id, key, value) of the settings under "config", values as text."""
    config = F.from_json("text", "struct<config:map<string,string>>")["config"]
    return records.select("run_id", F.explode(config).alias("key", "value"))


def read_run_notes(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, notes) of one text file per run; the folder names the run."""
    return read_run_records(spark, path).withColumnRenamed("text", "notes")


def run_details(records: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(run_id, name, created, notes) of every record; a bare history has no name, a run may have no notes."""
    fields = F.from_json("text", "struct<name:string,created:string>")
    rows = records.select("run_id", fields["name"].alias("name"), fields["created"].alias("created"))
    if notes is None:
        return rows.withColumn("notes", F.lit(None).cast("string"))
    return rows.join(notes.select("run_id", "notes"), "run_id", "left")
