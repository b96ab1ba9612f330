"""Drift of every tumbling window against a fixed reference, batch and streaming.

A row falls into one cell of a feature: a bin of a number, a level of a text or of an integer with few values, the
cell of levels the reference lacks, or outside a number's edges. Levels are found by an equi-join on their text, so
there may be any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import drift as D
from tablegauge.session import durable

UNKNOWN, OUTSIDE = "?", "!"


@dataclass
class WindowReference:
    """edges(feature, edges) of the numbers; cells(feature, cell, ref); totals(feature, cells, ref_rows, absent).

    ``absent`` is the index a window would have if all its rows were elsewhere.
    """

    features: list[str]
    edges: DataFrame
    cells: DataFrame
    totals: DataFrame


def reference_bins(reference: DataFrame, features: Sequence[str], bins: int = 10) -> WindowReference:
    """The reference rows of every cell of the features."""
    tables = D.drift_tables(reference, reference, features, bins)
    listed = durable(D.level_counts(tables).where("ref > 0"))
    levels = listed.select("feature", F.concat(F.lit("="), "level").alias("cell"), "ref")
    if tables.numbers is None:
        edges, cells = reference.sparkSession.createDataFrame([], "feature string, edges array<double>"), durable(levels)
    else:
        edges = durable(D.bin_edges(tables).join(levels.select("feature").distinct(), "feature", "left_anti"))
        numbers = D.histogram(tables, edges).select("feature", F.col("bin").cast("string").alias("cell"), "ref")
        cells = durable(numbers.unionByName(levels))
    # levels have one more cell, for what the reference lacks
    more = F.max(F.when(F.startswith("cell", F.lit("=")), 1).otherwise(0))
    sums = cells.groupBy("feature").agg((F.count(F.lit(1)) + more).alias("cells"), F.sum("ref").alias("ref_rows"))
    # one row per feature
    gone = D.psi_term(F.col("ref"), F.col("ref_rows"), F.lit(0), F.lit(1))
    absent = cells.join(F.broadcast(sums), "feature").groupBy("feature").agg(F.sum(gone).alias("absent"))
    return WindowReference(list(features), edges, cells, durable(sums.join(absent, "feature")))


def window_bins(current: DataFrame, reference: WindowReference, ts: str, width: str) -> DataFrame:
    """Rows per (window, feature, cell) of current rows; works on a stream."""
    names = [c for c in current.columns if c != ts and c in reference.features]
    long = C.long_form(current, names, "string", keep=[ts])
    x = F.col("value").try_cast("double")
    reached = F.size(F.filter("edges", lambda e: e <= x))
    inside = (reached >= 1) & (x <= F.element_at("edges", -1))
    number = F.when(inside, F.least(reached, F.size("edges") - 1).cast("string")).otherwise(OUTSIDE)
    # one row of edges per number
    placed = long.join(F.broadcast(reference.edges), "feature", "left").withColumn(
        "cell", F.when(F.col("edges").isNotNull(), number).otherwise(F.concat(F.lit("="), "value"))
    )
    known = reference.cells.select("feature", "cell", F.lit(True).alias("known"))
    joined = placed.join(known, ["feature", "cell"], "left")
    cell = F.when(F.col("known") | (F.col("cell") == OUTSIDE), F.col("cell")).otherwise(UNKNOWN)
    return joined.groupBy(F.window(ts, width).alias("window"), "feature", cell.alias("cell")).agg(F.count(F.lit(1)).alias("cur"))


def window_drift(binned: DataFrame, reference: WindowReference) -> DataFrame:
    """PSI, its excess and the severity per (window, feature)."""
    key = ["window_start", "feature"]
    cells = binned.select(F.col("window.start").alias("window_start"), "feature", "cell", "cur")
    inside = F.col("cell") != OUTSIDE
    sums = cells.groupBy(*key).agg(F.sum("cur").alias("cur_rows"), F.sum(F.when(inside, F.col("cur")).otherwise(0)).alias("cur_in"))
    # one row per feature
    sums = sums.join(F.broadcast(reference.totals), "feature")
    met = cells.where(inside).join(reference.cells, ["feature", "cell"], "left").join(sums, key)
    ref, rows = F.coalesce("ref", F.lit(0)), F.col("ref_rows")
    term = D.psi_term(ref, rows, F.col("cur"), F.col("cur_in")) - D.psi_term(ref, rows, F.lit(0), F.col("cur_in"))
    moved = met.groupBy(*key).agg(F.sum(term).alias("moved"))
    psi = F.greatest(F.col("absent") + F.coalesce("moved", F.lit(0.0)), F.lit(0.0))
    found = sums.join(moved, key, "left").withColumn("psi", psi)
    excess = F.greatest(F.lit(0.0), F.col("psi") - D.null_psi(F.col("cells"), rows, F.col("cur_rows")))
    return found.select(*key, "cur_rows", "psi", excess.alias("psi_excess"), D.severity(excess).alias("severity"))


def stream_window_drift(
    current: DataFrame, reference: WindowReference, ts: str, width: str, delay: str, sink, checkpoint: str, once: bool = False
):
    """Start a query that hands the drift of each closed window to ``sink(df, batch_id)``."""
    counts = window_bins(current.withWatermark(ts, delay), reference, ts, width)

    def finish(batch: DataFrame, batch_id: int) -> None:
        sink(window_drift(durable(batch), reference), batch_id)  # read twice

    writer = counts.writeStream.outputMode("append").foreachBatch(finish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
