"""Tables by file extension, tolerant JSON lines, and ordered samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table read by its extension; pass a schema to spare CSV and JSON a second scan."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if suffix == "jsonl":
        return reader.json(path)
    if suffix == "json":
        return reader.option("multiLine", True).json(path)
    raise ValueError(f"unsupported file type {suffix!r}: use csv, parquet, jsonl or json")


def first_rows(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n first rows in key order: a sample that does not depend on partitions."""
    return df.orderBy(*keys).limit(n)


def tolerant_json(lines: DataFrame, schema: str, column: str = "line") -> DataFrame:
    """Parsed JSON lines as ``record``; lines that do not parse are dropped."""
    parsed = F.from_json(column, f"struct<{schema},_bad:string>", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.withColumn("record", parsed)
    return rows.where(F.col("record").isNotNull() & F.col("record._bad").isNull()).withColumn(
        "record", F.col("record").dropFields("_bad")
    )
