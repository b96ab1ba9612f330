"""Queries over project ledgers and agent transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSCRIPT_CHARS = 20_000
TRUNCATED = "[... transcript truncated ...]"


def command_counts(lines: DataFrame) -> DataFrame:
    """Invocations per command of JSON log lines; unreadable lines drop.

    Lines without a command that carry a recommendation are old advise lines.
    """
    fields = F.from_json("line", "map<string,string>")
    as_text = F.col("line").rlike(r'"command"\s*:\s*"')
    missing = F.col("fields")["command"].isNull()
    advised = missing & F.map_contains_key("fields", F.lit("recommendation"))
    command = F.when(advised, "advise").when(as_text, F.col("fields")["command"])
    named = lines.withColumn("fields", fields).where("fields IS NOT NULL").select(command.alias("command"))
    return named.where("command IS NOT NULL").groupBy("command").agg(F.count(F.lit(1)).alias("n"))


def latest_decisions(decisions: DataFrame, n: int = 10) -> DataFrame:
    """One line for each of the latest n decisions (decision_id, ts, command, summary)."""
    last = decisions.orderBy(F.desc("ts"), F.desc("decision_id")).limit(n)
    day = F.date_format("ts", "yyyy-MM-dd")
    line = F.concat(F.lit("- ["), F.coalesce(day, F.lit("")), F.lit("] "), "command", F.lit(": "), F.trim(F.coalesce("summary", F.lit(""))))
    return last.select("decision_id", line.alias("line"))


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The n newest runs; run names start with their time."""
    return runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(n)


def find_run(runs: DataFrame, wanted: str) -> DataFrame:
    """The run of that name, else the smallest name it is a prefix of."""
    matching = runs.where(F.startswith("run_id", F.lit(wanted)))
    return matching.agg(F.min("run_id").alias("run_id")).where("run_id IS NOT NULL")


def _short(text: Column, limit: int) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def transcript_lines(steps: DataFrame) -> DataFrame:
    """Readable lines of steps (run_id, step_no, kind, content, tool_name, payload, ok)."""
    payload = F.substring(F.coalesce("payload", F.lit("{}")), 1, 120)
    line = (
        F.when(F.col("kind") == "message", F.concat(F.lit("agent: "), _short(F.col("content"), 200)))
        .when(F.col("kind") == "tool_call", F.concat(F.lit("→ "), F.coalesce("tool_name", F.lit("None")), F.lit("("), payload, F.lit(")")))
        .when(
            F.col("kind") == "tool_result",
            F.concat(F.lit("  ← "), F.when(F.coalesce("ok", F.lit(True)), "ok").otherwise("ERR"), F.lit(": "), payload),
        )
        .when(F.col("kind") == "stop", F.concat(F.lit("stop: "), _short(F.col("content"), 200)))
    )
    return steps.select("run_id", "step_no", line.alias("line")).where("line IS NOT NULL")


def transcript_text(steps: DataFrame, max_chars: int = TRANSCRIPT_CHARS) -> DataFrame:
    """One text per run, cut where its running length passes ``max_chars``.

    A line takes at least two characters of the budget, so only the first
    ``max_chars / 2 + 1`` lines of a run can matter. The window limit drops the
    rest before the shuffle, however long the run is.
    """
    by_step = Window.partitionBy("run_id").orderBy("step_no")
    head = transcript_lines(steps).withColumn("place", F.row_number().over(by_step)).where(
        F.col("place") <= max_chars // 2 + 1
    )
    used = F.sum(F.char_length("line") + 1).over(by_step.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = head.withColumn("used", used)
    kept = F.when(F.col("used") <= max_chars, F.struct("place", "line"))
    texts = marked.groupBy("run_id").agg(
        F.array_sort(F.collect_list(kept)).alias("kept"), F.bool_or(F.col("used") > max_chars).alias("cut")
    )
    lines = F.concat(F.col("kept")["line"], F.when(F.col("cut"), F.array(F.lit(TRUNCATED))).otherwise(F.array().cast("array<string>")))
    return texts.select("run_id", F.array_join(lines, "\n").alias("text"), "cut")
