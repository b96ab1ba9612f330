"""Inventory of a model store: size class, format and risk, without loading models."""

from __future__ import annotations

import sys

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADER_BYTES = 64
# Format by extension, where the first bytes do not tell.
EXTENSIONS = {
    "pkl": "pickle", "pickle": "pickle", "joblib": "joblib", "pt": "pytorch", "pth": "pytorch", "ckpt": "pytorch",
    "bin": "pytorch", "h5": "tensorflow_h5", "keras": "tensorflow_h5", "onnx": "onnx", "safetensors": "safetensors",
    "gguf": "gguf", "tflite": "tflite", "mlpackage": "coreml",
}
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _headers(batches):
    for batch in batches:
        heads = []
        for path in batch["path"]:
            system, inner = pafs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
            with system.open_input_stream(inner) as stream:
                heads.append(stream.read(HEADER_BYTES))
        batch["header"] = heads
        yield batch[["path", "length", "header"]]


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, header) of stored files.

    The listing reads no content. Only the first bytes are fetched, by the task
    that holds the path, so a model of any size fits.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return listing.mapInPandas(_headers, "path string, length long, header binary")


def size_class(size: Column) -> Column:
    mb = 1024 * 1024
    return F.when(size < 10 * mb, "small").when(size < 100 * mb, "medium").when(size < 1024 * mb, "large").otherwise("huge")


def readable_size(size: Column) -> Column:
    step = F.least(F.floor(F.log(1024.0, F.greatest(size, F.lit(1)))), F.lit(len(UNITS) - 1)).cast("int")
    # the logarithm may land just beside a power of 1024
    step = F.when(F.pow(F.lit(1024.0), step + 1) <= size, step + 1).when(F.pow(F.lit(1024.0), step) > size, step - 1).otherwise(step)
    unit = F.get(F.array(*[F.lit(u) for u in UNITS]), F.greatest(step, F.lit(0)))
    # halves go to the even digit; the quotient is exact, so it is a tie only where it shows as one
    scaled = F.format_string("%.1f %s", F.bround(size / F.pow(F.lit(1024.0), step), 1), unit)
    return F.when(size < 1024, F.format_string("%d B", size)).otherwise(scaled)


def model_format(header: Column, path: Column) -> Column:
    """Format by the first bytes, then by the extension."""
    hexed = F.hex(header)
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_name = F.lit("unknown")
    for extension, name in EXTENSIONS.items():
        by_name = F.when(suffix == extension, name).otherwise(by_name)
    return (
        F.when(F.startswith(hexed, F.lit("504B0304")), "pytorch")
        .when(F.startswith(hexed, F.lit("894844460D0A1A0A")), "tensorflow_h5")
        .when(F.startswith(hexed, F.lit("08")), "onnx")
        .when(F.startswith(hexed, F.lit("80")), F.when(suffix == "joblib", "joblib").otherwise("pickle"))
        .otherwise(by_name)
    )


def model_inventory(files: DataFrame) -> DataFrame:
    """Size, format and warnings per file (path, length, header)."""
    size = F.col("length")
    named = files.withColumn("format", model_format(F.col("header"), F.col("path")))
    rules = {
        "unsafe_pickle": F.col("format") == "pickle",
        "unknown_format": F.col("format") == "unknown",
        "huge_model": size_class(size) == "huge",
    }
    fired = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in rules.items()]), lambda r: r.isNotNull())
    return named.select(
        "path", "length", readable_size(size).alias("size"), size_class(size).alias("size_class"), "format", fired.alias("warnings")
    )
