"""Content fingerprints, dataset manifests and dependency manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Packages that make a manifest a learning one.
LEARNING_PACKAGES = (
    "catboost", "jax", "keras", "lightgbm", "numpy", "onnx", "onnxruntime", "pandas", "safetensors",
    "scikit-learn", "scipy", "sklearn", "tensorflow", "tokenizers", "torch", "torchaudio",
    "torchvision", "transformers", "xgboost",
)
PIN = r"==|>=|<=|~=|!=|<|>|@|;"


def text_fingerprint(text: Column) -> Column:
    """sha256 of a text whose line endings are folded into newlines."""
    return F.sha2(F.regexp_replace(text, r"\r\n?", "\n"), 256)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, columns and an order-free digest of a table.

    The digest is the sum of the row hashes, so repeated rows count as often as they occur.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"),
    )


def check_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """MISSING, CHANGED, UNLISTED or ok per entry (path, sha256) of a manifest."""
    both = manifest.select("path", F.col("sha256").alias("listed")).join(
        found.select("path", F.col("sha256").alias("actual")), "path", "full"
    )
    state = (
        F.when(F.col("actual").isNull(), "MISSING")
        .when(F.col("listed").isNull(), "UNLISTED")
        .when(F.col("actual") != F.col("listed"), "CHANGED")
        .otherwise("ok")
    )
    return both.select("path", state.alias("state"))


def requirement_lines(lines: DataFrame) -> DataFrame:
    """(manifest, spec, package, pinned, learning) of requirement lines (manifest, line)."""
    spec = F.trim(F.regexp_replace("line", "#.*$", ""))
    specs = lines.select("manifest", spec.alias("spec")).where("spec <> '' AND NOT startswith(spec, '-')")
    package = F.lower(F.regexp_extract("spec", r"^([^\[\s=<>!~@;]*)", 1))
    return specs.select(
        "manifest",
        "spec",
        package.alias("package"),
        F.col("spec").rlike(PIN).alias("pinned"),
        package.isin(*LEARNING_PACKAGES).alias("learning"),
    )


def manifest_summary(requirements: DataFrame) -> DataFrame:
    """Counts per manifest and the two warnings of the deployment check."""
    named = F.col("package") != ""
    counts = requirements.groupBy("manifest").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(named & F.col("pinned")).alias("pinned"),
        F.count_if(named & ~F.col("pinned")).alias("unpinned"),
        # at most one entry per known package
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("learning"), F.col("package")))), ",").alias("learning"),
    )
    return counts.withColumns(
        {"warn_unpinned": F.col("unpinned") > 0, "warn_no_learning": F.col("learning") == ""}
    )
