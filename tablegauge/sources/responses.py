"""Response files of experiments and the evidence dumps they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The evidence hash in file names, and folders that are not data.
RESPONSE_HASH = r"_e([0-9a-fA-F]{6,64})\.jsonl$"
DUMP_HASH = r"(?:^|/)evidence_([0-9a-fA-F]{6,64})\.json$"
EXCLUDED = r"(?:^|/)[^/]*superseded[^/]*(?=/|$)|(?:^|/)transport_errors/"


def pair_with_evidence(files: DataFrame, dumps: DataFrame) -> DataFrame:
    """Response files (path) next to the dump (path) that carries their hash.

    Superseded and transport-error folders are left out, and so are files
    without a dump.
    """
    kept = files.where(~F.col("path").rlike(EXCLUDED) & F.col("path").rlike(RESPONSE_HASH))
    named = kept.withColumn("evidence_hash", F.regexp_extract("path", RESPONSE_HASH, 1))
    known = dumps.where(F.col("path").rlike(DUMP_HASH)).select(
        F.col("path").alias("dump"), F.regexp_extract("path", DUMP_HASH, 1).alias("evidence_hash")
    )
    return named.join(known, "evidence_hash")


def read_responses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Response records with their file and evidence hash; bad lines drop."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    file = F.col("_metadata.file_path")
    return rows.select("*", file.alias("file"), F.regexp_extract(file, RESPONSE_HASH, 1).alias("evidence_hash"))
