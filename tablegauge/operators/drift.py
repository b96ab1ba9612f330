"""Distribution drift between a reference table and a current table.

Both sides are unpivoted and reduced to counts per (feature, value) in one
shuffle. Bin edges, histograms, PSI and the KS statistic are then read off that
reduced table, so the source rows are scanned once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions import columns as C
from tablegauge.functions import dates
from tablegauge.functions.probability import chi_square_tail, kolmogorov_tail
from tablegauge.operators.order_stats import quantiles, running_totals
from tablegauge.session import durable

# Fixed values of the drift rules.
STABLE_BELOW = 0.10
MODERATE_BELOW = 0.20
RELIABLE_ROWS = 30
SMOOTHING = 1e-6
EDGE_MARGIN = 1e-9
CATEGORICAL_LEVELS = 10


def common_columns(reference: DataFrame, current: DataFrame, features: Sequence[str] | None) -> list[str]:
    shared = [c for c in reference.columns if c in set(current.columns)]
    return shared if features is None else [f for f in features if f in shared]


def _kind_of(dtype: T.DataType) -> str:
    if C.is_integer(dtype):
        return "integer"
    if C.is_numeric(dtype):
        return "numeric"
    if C.is_temporal(dtype):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.BooleanType)):
        return "string"
    return "unsupported"


def _sides(reference: DataFrame, current: DataFrame, names: list[str], as_type: str) -> DataFrame:
    ref = C.long_form(reference, names, as_type).withColumn("side", F.lit("ref"))
    cur = C.long_form(current, names, as_type).withColumn("side", F.lit("cur"))
    return ref.unionByName(cur)


def _side_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == "ref").alias("ref"),
        F.count_if(F.col("side") == "cur").alias("cur"),
    )


@dataclass
class DriftTables:
    """The reduced inputs every drift statistic reads."""

    reference: DataFrame
    current: DataFrame
    features: list[str]
    bins: int = 10

    @cached_property
    def base_kinds(self) -> dict[str, str]:
        types = {f.name: f.dataType for f in self.reference.schema.fields}
        return {f: _kind_of(types[f]) for f in self.features}

    def named(self, *kinds: str) -> list[str]:
        return [f for f in self.features if self.base_kinds[f] in kinds]

    @cached_property
    def numbers(self) -> DataFrame | None:
        """Counts and running totals per number, both sides."""
        names = self.named("numeric", "integer")
        if not names:
            return None
        counts = _side_counts(_sides(self.reference, self.current, names, "double"))
        return running_totals(counts, ["feature"], "value", ["ref", "cur"], reused=True)

    @cached_property
    def wholes(self) -> DataFrame | None:
        """Counts of both sides per exact integer."""
        names = self.named("integer")
        return durable(_side_counts(_sides(self.reference, self.current, names, "bigint"))) if names else None

    @cached_property
    def texts(self) -> DataFrame | None:
        names = self.named("string")
        if not names:
            return None
        return durable(_side_counts(_sides(self.reference, self.current, names, "string")))

    @cached_property
    def kinds(self) -> DataFrame:
        """Kind per feature, one row each, kept because several results read it."""
        return durable(feature_kinds(self))

    @cached_property
    def listing(self) -> DataFrame:
        spark = self.reference.sparkSession
        rows = [(i, f, self.base_kinds[f]) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "ordinal int, feature string, base string")


def drift_tables(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    bins: int = 10,
) -> DriftTables:
    names = common_columns(reference, current, features)
    if not names:
        raise ValueError("the two tables share no column")
    return DriftTables(reference, current, names, bins)


def aligned_counts(tables: DriftTables) -> DataFrame:
    """Non-null rows per side of every feature that drift can score."""
    parts = [
        t.groupBy("feature").agg(F.sum("ref").alias("ref_rows"), F.sum("cur").alias("cur_rows"))
        for t in (tables.numbers, tables.texts)
        if t is not None
    ]
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (
        tables.listing.where(F.col("base").isin("numeric", "integer", "string"))
        .join(found, "feature", "left")
        .select(
            "feature",
            F.coalesce("ref_rows", F.lit(0)).alias("ref_rows"),
            F.coalesce("cur_rows", F.lit(0)).alias("cur_rows"),
        )
    )


def feature_kinds(tables: DriftTables) -> DataFrame:
    """numeric, categorical, datetime or unsupported, per feature."""
    parts = []
    if tables.wholes is not None:  # other numbers are numeric whatever their levels
        parts.append(
            tables.wholes.groupBy("feature").agg(
                F.count_if(F.col("ref") > 0).alias("levels"), F.lit(False).alias("dates")
            )
        )
    if tables.texts is not None:
        n, value = F.col("ref"), F.col("value")

        def share(test: Column) -> Column:
            return F.coalesce(F.try_divide(F.sum(F.when(test, n).otherwise(0)), F.sum(n)), F.lit(0.0))

        parts.append(
            tables.texts.groupBy("feature").agg(
                F.count_if(n > 0).alias("levels"),
                (
                    (share(dates.looks_shaped(value)) >= dates.SHARE)
                    & (share(dates.looks_shaped(value) & dates.parse_date(value).isNotNull()) >= dates.SHARE)
                ).alias("dates"),
            )
        )
    if not parts:
        return tables.listing.select("ordinal", "feature", F.col("base").alias("kind"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    few = F.col("levels") <= CATEGORICAL_LEVELS
    return tables.listing.join(found, "feature", "left").select(
        "ordinal",
        "feature",
        F.when(F.col("base") == "numeric", "numeric")
        .when((F.col("base") == "integer") & few, "categorical")
        .when(F.col("base") == "integer", "numeric")
        .when((F.col("base") == "string") & F.col("dates"), "datetime")
        .when(F.col("base") == "string", "categorical")
        .otherwise(F.col("base"))
        .alias("kind"),
    )


def bin_edges(tables: DriftTables) -> DataFrame:
    """Reference-quantile edges per number: distinct, opened at both ends."""
    probs = [i / tables.bins for i in range(tables.bins + 1)]
    q = quantiles(tables.numbers.where("total_ref > 0"), probs, n="ref")
    distinct = F.array_sort(F.array_distinct("q"))
    only = F.element_at("d", 1)
    margin = F.greatest(F.abs(only) * 1e-6, F.lit(1e-9))
    spread = F.when(F.size("d") < 2, F.array(only - margin, only + margin)).otherwise(F.col("d"))
    last = F.size("e")
    opened = F.transform(
        "e",
        lambda e, i: F.when(i == 0, e - EDGE_MARGIN).when(i == last - 1, e + EDGE_MARGIN).otherwise(e),
    )
    return (
        q.select("feature", distinct.alias("d"))
        .select("feature", spread.alias("e"))
        .select("feature", opened.alias("edges"))
    )


def _binned(tables: DriftTables, edges: DataFrame) -> DataFrame:
    """Counts per (feature, bin); bin 0 holds the values outside the edges."""
    x = F.col("value")
    reached = F.size(F.filter("edges", lambda e: e <= x))
    last = F.element_at("edges", -1)
    bins = F.size("edges") - 1
    inside = (reached >= 1) & (x <= last)
    number = F.when(inside, F.least(reached, bins)).otherwise(0)
    # One edges row per feature, so the broadcast is bounded by the column count.
    return (
        tables.numbers.join(F.broadcast(edges), "feature")
        .groupBy("feature", number.alias("bin"), bins.alias("bins"))
        .agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )


def histogram(tables: DriftTables, edges: DataFrame | None = None) -> DataFrame:
    """Counts of both sides in every bin, empty bins included."""
    edges = bin_edges(tables) if edges is None else edges
    scaffold = edges.select("feature", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    return scaffold.join(_binned(tables, edges).drop("bins"), ["feature", "bin"], "left").select(
        "feature",
        "bin",
        F.coalesce("ref", F.lit(0)).alias("ref"),
        F.coalesce("cur", F.lit(0)).alias("cur"),
    )


def level_counts(tables: DriftTables) -> DataFrame:
    """Counts of both sides per level of every categorical feature."""
    parts = []
    if tables.wholes is not None:
        parts.append(tables.wholes.select("feature", F.col("value").cast("string").alias("level"), "ref", "cur"))
    if tables.texts is not None:
        parts.append(tables.texts.select("feature", F.col("value").alias("level"), "ref", "cur"))
    if not parts:
        spark = tables.reference.sparkSession
        return spark.createDataFrame([], "feature string, level string, ref long, cur long")
    union = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wanted = tables.kinds.where("kind = 'categorical'").select("feature")
    return union.join(F.broadcast(wanted), "feature")


def psi_term(ref: Column, ref_total: Column, cur: Column, cur_total: Column) -> Column:
    """One cell of the stability index, zero shares lifted to the smoothing value."""
    r = ref / F.greatest(ref_total, F.lit(1))
    c = cur / F.greatest(cur_total, F.lit(1))
    r = F.when(r == 0, SMOOTHING).otherwise(r)
    c = F.when(c == 0, SMOOTHING).otherwise(c)
    return (c - r) * F.ln(c / r)


def null_psi(cells: Column, ref_rows: Column, cur_rows: Column) -> Column:
    """The PSI two samples of one distribution show by sampling noise alone."""
    return F.when(
        (cells <= 1) | (ref_rows <= 0) | (cur_rows <= 0), F.lit(0.0)
    ).otherwise((cells - 1) * (1.0 / ref_rows + 1.0 / cur_rows))


def severity(excess: Column) -> Column:
    return (
        F.when(excess < STABLE_BELOW, "stable").when(excess < MODERATE_BELOW, "moderate").otherwise("major")
    )


def numeric_psi(tables: DriftTables) -> DataFrame:
    cells = _binned(tables, bin_edges(tables))
    inside = F.col("bin") > 0
    sums = cells.groupBy("feature", "bins").agg(
        F.sum("ref").alias("ref_rows"),
        F.sum("cur").alias("cur_rows"),
        F.sum(F.when(inside, F.col("ref")).otherwise(0)).alias("ref_in"),
        F.sum(F.when(inside, F.col("cur")).otherwise(0)).alias("cur_in"),
        F.collect_list(F.when(inside, F.struct("ref", "cur"))).alias("cells"),
    )
    # At most ``bins`` cells per feature.
    psi = F.aggregate(
        "cells",
        F.lit(0.0),
        lambda s, c: s + psi_term(c["ref"], F.col("ref_in"), c["cur"], F.col("cur_in")),
    )
    return sums.select(
        "feature",
        F.col("bins").alias("cells"),
        "ref_rows",
        "cur_rows",
        F.greatest(psi, F.lit(0.0)).alias("psi"),
        C.ratio(F.col("cur_rows") - F.col("cur_in"), F.col("cur_rows")).alias("out_of_range_share"),
    )


def ks_statistics(tables: DriftTables) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p per number."""
    gap = F.abs(
        (F.col("before_ref") + F.col("ref")) / F.col("total_ref")
        - (F.col("before_cur") + F.col("cur")) / F.col("total_cur")
    )
    stats = (
        tables.numbers.where("total_ref > 0 AND total_cur > 0")
        .groupBy("feature")
        .agg(
            F.max(gap).alias("ks_stat"),
            F.max("total_ref").cast("double").alias("n1"),
            F.max("total_cur").cast("double").alias("n2"),
        )
    )
    root = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    lam = F.col("ks_stat") * (root + 0.12 + 0.11 / root)
    return stats.select("feature", "ks_stat", kolmogorov_tail(lam).alias("ks_pvalue"))


def level_statistics(tables: DriftTables) -> DataFrame:
    """PSI and chi-square homogeneity per categorical feature."""
    levels = level_counts(tables).where("ref + cur > 0")
    totals = levels.groupBy("feature").agg(
        F.sum("ref").alias("ref_rows"), F.sum("cur").alias("cur_rows"), F.count(F.lit(1)).alias("cells")
    )
    r, c, ref, cur = (F.col(x) for x in ("ref", "cur", "ref_rows", "cur_rows"))
    all_rows = ref + cur
    expected_r = ref * (r + c) / all_rows
    expected_c = cur * (r + c) / all_rows
    chi = F.try_divide(F.pow(r - expected_r, 2.0), expected_r) + F.try_divide(
        F.pow(c - expected_c, 2.0), expected_c
    )
    scored = (
        levels.join(F.broadcast(totals), "feature")
        .groupBy("feature", "cells", "ref_rows", "cur_rows")
        .agg(
            F.greatest(F.sum(psi_term(r, ref, c, cur)), F.lit(0.0)).alias("psi"),
            F.sum(chi).alias("_chi"),
        )
    )
    untestable = (F.col("cells") < 2) | (ref <= 0) | (cur <= 0)
    stat = F.when(untestable, 0.0).otherwise(F.col("_chi"))
    return scored.select(
        "feature",
        "cells",
        "ref_rows",
        "cur_rows",
        "psi",
        stat.alias("chi2_stat"),
        (F.col("cells") - 1).alias("dof"),
    )


def with_chi_square_p(levels: DataFrame) -> DataFrame:
    tail = chi_square_tail(F.col("chi2_stat"), F.col("dof").cast("double"))
    return levels.withColumn("chi2_pvalue", F.when(F.col("dof") < 1, 1.0).otherwise(tail))


def feature_drift(tables: DriftTables) -> DataFrame:
    """One row per common feature with its drift statistics and severity."""
    kinds = tables.kinds
    parts = []
    if tables.numbers is not None:
        parts.append(
            numeric_psi(tables)
            .join(ks_statistics(tables), "feature", "left")
            .join(kinds.where("kind = 'numeric'").select("feature"), "feature")
            .select(
                "feature", "cells", "ref_rows", "cur_rows", "psi", "out_of_range_share",
                "ks_stat", "ks_pvalue",
                F.lit(None).cast("double").alias("chi2_stat"),
                F.lit(None).cast("double").alias("chi2_pvalue"),
            )
        )
    if tables.texts is not None or tables.named("integer"):
        parts.append(
            with_chi_square_p(level_statistics(tables)).select(
                "feature", F.col("cells").cast("int").alias("cells"), "ref_rows", "cur_rows", "psi",
                F.lit(None).cast("double").alias("out_of_range_share"),
                F.lit(None).cast("double").alias("ks_stat"),
                F.lit(None).cast("double").alias("ks_pvalue"),
                "chi2_stat", "chi2_pvalue",
            )
        )
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    scored = scored.where("ref_rows > 0 AND cur_rows > 0")
    expected = null_psi(F.col("cells"), F.col("ref_rows"), F.col("cur_rows"))
    excess = F.greatest(F.lit(0.0), F.col("psi") - expected)
    small = F.least("ref_rows", "cur_rows") < RELIABLE_ROWS
    return kinds.join(scored, "feature", "left").select(
        "feature",
        "kind",
        "psi",
        expected.alias("psi_null_expected"),
        excess.alias("psi_excess"),
        "ks_stat",
        "ks_pvalue",
        "chi2_stat",
        "chi2_pvalue",
        F.when(F.col("psi").isNull(), "skipped").otherwise(severity(excess)).alias("severity"),
        F.coalesce(small, F.lit(False)).alias("small_sample"),
        "ref_rows",
        "cur_rows",
        "out_of_range_share",
    )


def drift_summary(per_feature: DataFrame) -> DataFrame:
    """Mean and maximum PSI, severity counts and the retrain verdict."""
    row = per_feature.agg(
        F.avg("psi").alias("mean_psi"),
        F.max("psi").alias("max_psi"),
        F.avg(F.when(F.col("psi").isNotNull(), F.col("psi_excess"))).alias("mean_psi_excess"),
        F.max(F.when(F.col("psi").isNotNull(), F.col("psi_excess"))).alias("max_psi_excess"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("stable", "moderate", "major")],
    )
    major = (F.col("max_psi_excess") >= MODERATE_BELOW) | (F.col("n_major") >= 1)
    status = (
        F.when(F.col("mean_psi").isNull(), "unknown")
        .when(major, "major_drift")
        .when(F.col("mean_psi_excess") >= STABLE_BELOW, "moderate_drift")
        .otherwise("stable")
    )
    return row.withColumn("status", status).withColumn(
        "retrain_recommended", F.col("status") == "major_drift"
    )


def top_drifted(per_feature: DataFrame, n: int = 5) -> DataFrame:
    return (
        per_feature.where("psi IS NOT NULL")
        .select("feature", "psi", "severity", "kind")
        .orderBy(F.desc("psi"), "feature")
        .limit(n)
    )


def skipped_features(tables: DriftTables) -> DataFrame:
    """Features whose values are all missing on one side."""
    return aligned_counts(tables).where("ref_rows = 0 OR cur_rows = 0").select(
        "feature", "ref_rows", "cur_rows"
    )
