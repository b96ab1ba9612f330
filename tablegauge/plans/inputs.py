"""Inputs the registered queries derive from the given tables.

A derivation is SQL text both Spark and the checking engine can run, with table
names in braces. It only shapes an operator's input; the operators themselves are
written once in the DataFrame API and once, independently, as checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def dealt(df: DataFrame) -> DataFrame:
    """Deal the rows of a table that makes one split out by its first column, a key.

    A small file has one row group, which one task reads; what follows then still runs on all cores. Only tables
    below the size of one split are dealt out, so the shuffle is no larger than that.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(spark.sparkContext.defaultParallelism, df.columns[0]) if size < split else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{folder}/{name}.parquet"))


def derive(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run a derivation over the tables it names."""
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def check_sql(sql: str) -> str:
    """The same derivation for the checking engine, where tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def with_inputs(body: str, **inputs: str) -> str:
    """Checking SQL: the derivations as common table expressions, then ``body``."""
    ctes = ", ".join(f"{name} AS ({check_sql(sql)})" for name, sql in inputs.items())
    return f"WITH {ctes} {body}"
