"""Training-log sources: text lines, tracker history, long scalars, run folders.

Text has no line number in a distributed read, so every parser takes
``(run_id, line_no, line)``; ``read_lines`` numbers the lines of files split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablegauge.functions.metric_names import normalised

# The log-line grammar.
EPOCH = r"(?i)\b(?:epoch|ep)\b\s*[:=#]?\s*(\d+)"
STEP = r"(?i)\b(?:step|global_step|iter)\b\s*[:=]?\s*(\d+)"
KEY = r"[A-Za-z_][A-Za-z0-9_]{1,40}(?:[/.\-][A-Za-z0-9_]{1,40})*"
NUMBER = r"-?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
NOT_FINITE = r"[-+]?(?:[nN][aA][nN]|[iI][nN][fF][iI][nN][iI][tT][yY]|[iI][nN][fF])(?![A-Za-z0-9_])"
PAIR = rf"({KEY})\s*[:=]\s*({NUMBER}|{NOT_FINITE})"
NOT_METRICS = ("epoch", "ep", "step", "iter", "global_step", "batch", "batches", "num_epochs", "total")
RUN_END = "\t"  # ends the name of the run before each line of a file of many runs
# File names that mark a run folder's source.
EVENT_FILE = r"^events\.out\.tfevents\."
HISTORY_FILES = ("wandb-summary.json", "wandb-history.jsonl")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, line_no, line) of text files, each of which many tasks may read.

    A task numbers the lines of its split of a file; the splits before it, a small table with a row per split, give
    the number its first line has. Splits are read in their own order and never change between the two readings.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("run_id"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = lines.groupBy("run_id", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("run_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("run_id", "_start", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return lines.join(offsets, ["run_id", "_start"]).select("run_id", (F.col("_id") + F.col("_offset")).alias("line_no"), "line")


def lines_of_runs(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, line) of numbered lines of files that hold many runs, each line led by its run and a tab.

    The lines of a run stand together in one file, so its first line there is its line 0. Runs without number
    need no file each: what is listed and opened grows with the text, not with the runs.
    """
    parts = F.split("line", RUN_END, 2)
    named = lines.select(parts[0].alias("run_id"), "line_no", parts[1].alias("line"))
    first = named.groupBy("run_id").agg(F.min("line_no").alias("_first"))
    return named.join(first, "run_id").select("run_id", (F.col("line_no") - F.col("_first")).alias("line_no"), "line")


def _as_number(text: Column) -> Column:
    plain = F.regexp_replace(text, ",", "")
    signless_nan = F.regexp_replace(plain, "(?i)^[-+](nan)$", "$1")
    return signless_nan.try_cast("double")


def last_entries(entries: Column) -> Column:
    """Map of (key, value) entries where the last entry of a key wins."""
    later = lambda e, i: F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]
    )
    return F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Snapshots (run_id, seq, epoch, step, metrics, source_line) of log lines.

    A line counts when it carries a measurement or an epoch marker.
    """
    text = F.regexp_replace("line", r"^\s+|\s+$", "")

    def marker(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("source_line", pattern, 1), F.lit("")).try_cast("long")

    pattern = F.lit(PAIR)
    keys = F.regexp_extract_all("source_line", pattern, F.lit(1))
    values = F.regexp_extract_all("source_line", pattern, F.lit(2))
    entries = F.transform(
        F.arrays_zip(keys.alias("k"), values.alias("v")),
        lambda e: F.struct(e["k"].alias("key"), _as_number(e["v"]).alias("value")),
    )
    kept = F.filter(entries, lambda e: ~normalised(e["key"]).isin(*NOT_METRICS) & e["value"].isNotNull())
    parsed = lines.select("run_id", F.col("line_no").alias("seq"), text.alias("source_line")).select(
        "run_id", "seq", "source_line", marker(EPOCH).alias("epoch"), marker(STEP).alias("step"), kept.alias("e")
    )
    signal = (F.size("e") > 0) | F.col("epoch").isNotNull()
    return parsed.where(signal).select(
        "run_id", "seq", "epoch", "step", last_entries(F.col("e")).alias("metrics"), "source_line"
    )


_JSON_NUMBER = r"-?(?:\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|Infinity)|NaN"
_JSON_PAIR = rf'"([^"\\]+)"\s*:\s*({_JSON_NUMBER})\s*(?=[,}}])'


def parse_history(lines: DataFrame) -> DataFrame:
    """Snapshots of tracker-history JSON lines.

    ``_step`` and ``epoch`` become columns, other underscore keys go. Only JSON
    numbers are metrics, so the raw text decides: strings and booleans never
    match. NaN and infinities stay. Malformed lines and rows without a signal drop.
    """
    fields = F.from_json("line", "map<string,string>")
    pattern = F.lit(_JSON_PAIR)
    pairs = F.arrays_zip(
        F.regexp_extract_all("line", pattern, F.lit(1)).alias("k"),
        F.regexp_extract_all("line", pattern, F.lit(2)).alias("v"),
    )
    entries = F.transform(
        pairs, lambda e: F.struct(e["k"].alias("key"), e["v"].try_cast("double").alias("value"))
    )
    kept = F.filter(
        entries,
        lambda e: ~F.startswith(e["key"], F.lit("_"))
        & (e["key"] != "epoch")
        & F.map_contains_key("fields", e["key"]),
    )

    def whole(name: str) -> Column:
        number = F.col("fields")[name].try_cast("double")
        finite = ~(F.isnan(number) | number.isin(float("inf"), float("-inf")))
        return F.when(finite, number.cast("long"))

    rows = lines.withColumn("fields", fields).where(F.col("fields").isNotNull()).select(
        "run_id",
        F.col("line_no").alias("seq"),
        whole("epoch").alias("epoch"),
        whole("_step").alias("step"),
        last_entries(kept).alias("metrics"),
    )
    return rows.where((F.size("metrics") > 0) | F.col("epoch").isNotNull() | F.col("step").isNotNull())


def pivot_scalars(scalars: DataFrame) -> DataFrame:
    """One snapshot per (run_id, step) of long scalars (run_id, ord, step, tag, value).

    The last write of a tag wins; an unlogged tag is absent. A step whose values
    are all missing is still a snapshot.
    """
    last = scalars.groupBy("run_id", "step", "tag").agg(
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ord"))).alias("value")
    )
    metric = (F.col("tag") != "epoch") & F.col("value").isNotNull()
    epoch = F.when((F.col("tag") == "epoch") & ~F.isnan("value"), F.col("value").cast("long"))
    # The list holds the distinct tags of one step.
    return last.groupBy("run_id", "step").agg(
        F.max(epoch).alias("epoch"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(metric, F.struct(F.col("tag").alias("key"), "value"))))
        ).alias("metrics"),
    )


def classify_run_folders(files: DataFrame) -> DataFrame:
    """tensorboard, wandb or plain_text per run folder, from its file names.

    ``files`` has ``(run_dir, name)`` with names relative to the run folder.
    """
    history = F.regexp_replace("name", "^files/", "").isin(*HISTORY_FILES)
    seen = files.groupBy("run_dir").agg(
        F.bool_or(F.col("name").rlike(EVENT_FILE)).alias("events"), F.bool_or(history).alias("history")
    )
    source = F.when(F.col("events"), "tensorboard").when(F.col("history"), "wandb").otherwise("plain_text")
    return seen.select("run_dir", source.alias("source"))


def list_run_files(spark: SparkSession, path: str) -> DataFrame:
    """(run_dir, name) of the files below run folders; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.regexp_extract("path", r"^(.*?)/((?:files/)?[^/]+)$", 2)
    return found.select(
        F.regexp_extract("path", r"^(.*?)/((?:files/)?[^/]+)$", 1).alias("run_dir"), inner.alias("name")
    )
