"""Append-only result and ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_results(df: DataFrame, path: str, partition: str = "experiment_id") -> None:
    """Append result rows to a partitioned Parquet table."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def append_decision(df: DataFrame, path: str) -> None:
    """Append decisions (command, summary, reasoning), stamped with the time."""
    df.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def dataset_fingerprint(path_column: str = "path", modified_column: str = "modified"):
    """Sixteen hex digits of the dataset's path and modification time."""
    return F.substring(F.sha2(F.concat_ws("|", path_column, F.col(modified_column).cast("string")), 256), 1, 16)


def unregistered(datasets: DataFrame, registry: DataFrame) -> DataFrame:
    """Datasets whose fingerprint the registry does not hold, one row each."""
    return datasets.dropDuplicates(["fingerprint"]).join(registry.select("fingerprint"), "fingerprint", "left_anti")


def register_datasets(datasets: DataFrame, registry: DataFrame, path: str) -> None:
    """Append new datasets; registering an unchanged one again adds nothing."""
    unregistered(datasets, registry).write.mode("append").parquet(path)
