"""Target-leakage evidence from a predictions table.

Targets are ranked once, over their distinct values, and every row gets its target's rank. Features are then reduced to
one row per distinct value with its rows and the sums of its rows' target ranks, which is all that rank correlations
need. Those rows are range-partitioned once by (feature, value) and read in one sorted pass; a partition gives a few
sums per feature, in ranks counted from its own first row, and the partitions before it shift them. So no feature
is sorted in one task, and a value held by a third of the rows is one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.operators.order_stats import ordinal_codes, running_totals
from tablegauge.operators.skew import hot_key_join
from tablegauge.operators.sorted_pass import RunningSums
from tablegauge.session import durable

# Fixed values of the leakage rules.
SUSPICIOUS = 0.99
TRUSTWORTHY_ROWS = 50
REPORTED = 10

_VALUE = ["f", "num", "text"]  # a feature's number, and a value of it in the one or the other form
# Per partition and feature: rows n, those of the lower class low, distinct values k (of complete pairs: used), and sums
# over them of the rank r and the code i of the value with the target's rank y and value v.
_SUMS = ("n", "low", "high", "k", "used", "r", "rr", "ry", "y", "yy", "i", "ii", "iv", "v", "vv", "wins")


@dataclass
class LeakageTables:
    """Feature-target pairs of one predictions table."""

    df: DataFrame
    y_true: str
    exclude: Sequence[str] = ()

    @cached_property
    def types(self):
        return {f.name: f.dataType for f in self.df.schema.fields}

    @property
    def numeric_target(self) -> bool:
        return C.is_numeric(self.types[self.y_true])

    @cached_property
    def features(self) -> list[str]:
        left_out = {self.y_true, *self.exclude}
        usable = (n for n in self.df.columns if n not in left_out)
        return [n for n in usable if C.is_numeric(self.types[n]) or self.types[n].simpleString() in ("string", "boolean")]

    @property
    def numbers(self) -> list[str]:
        return [n for n in self.features if C.is_numeric(self.types[n])]

    @property
    def texts(self) -> list[str]:
        return [n for n in self.features if n not in self.numbers]

    @cached_property
    def wide(self) -> DataFrame:
        """y, and every feature as x0, x1, ..: numbers as doubles, the rest as texts."""
        target = C.value_or_null(self.y_true, self.types[self.y_true]).cast("double" if self.numeric_target else "string")
        columns = [
            C.value_or_null(n, self.types[n]).cast("double" if n in self.numbers else "string").alias(f"x{i}")
            for i, n in enumerate(self.features)
        ]
        return self.df.select(target.alias("y"), *columns)

    @cached_property
    def targets(self) -> DataFrame:
        """Per distinct target its rows n, those with each feature n0, n1, .., and running totals of them; one scan."""
        counts = {"n": F.count(F.lit(1)), **{f"n{i}": F.count(f"x{i}") for i in range(len(self.features))}}
        per_target = self.wide.where("y IS NOT NULL").groupBy("y").agg(*[c.alias(n) for n, c in counts.items()])
        weight = F.col("y") * F.col("n") if self.numeric_target else F.lit(0.0)
        sums = {"one": F.lit(1), "weight": weight.cast("double")}
        return running_totals(per_target.withColumns(sums), [], "y", [*sums, *counts])

    @cached_property
    def facts(self) -> dict:
        """The two smallest targets, their number, rows, complete pairs of each feature, and the mean target."""
        rows = self.targets.where("before_one < 2").orderBy("before_one").collect()
        if not rows:
            return {"smallest": [], "targets": 0, "pairs": [0] * len(self.features), "rows": 0, "mean": 0.0}
        total = {name.removeprefix("total_"): value for name, value in rows[0].asDict().items() if name.startswith("total_")}
        pairs = [total[f"n{i}"] for i in range(len(self.features))]
        return {
            "smallest": [r.y for r in rows], "targets": total["one"], "pairs": pairs, "rows": total["n"],
            "mean": total["weight"] / total["n"],
        }

    @property
    def two_valued(self) -> bool:
        return self.facts["targets"] == 2

    def codes(self, names: list[str]) -> DataFrame:
        """Sorted-order codes of all values of text columns, nulls excluded."""
        return ordinal_codes(C.long_form(self.df, names, "string"))

    @property
    def holey(self) -> list[int]:
        return [i for i in range(len(self.features)) if self.facts["pairs"][i] < self.facts["rows"]]

    @cached_property
    def ranked_targets(self) -> DataFrame:
        """(y, v, ranks, n, total_n): per distinct target its value about the mean or its code, and its average ranks.

        The first rank is that among all rows; one more follows per feature with missing values, among that feature's
        complete pairs.
        """
        ranks = F.array(*[F.col(f"before_{n}") + (F.col(n) + 1) / 2.0 for n in ("n", *[f"n{i}" for i in self.holey])])
        value = F.col("y") - F.lit(self.facts["mean"]) if self.numeric_target else F.col("before_one").cast("double")
        return self.targets.select("y", value.alias("v"), ranks.alias("ranks"), "n", "total_n")

    @cached_property
    def ranked_rows(self) -> DataFrame:
        """Rows with v and ranks of their target; both null where there is no target."""
        spread = [f"x{i}" for i in range(len(self.features))]
        return hot_key_join(self.wide, self.ranked_targets, ["y"], spread or ["y"], "n", "total_n", "left")

    @cached_property
    def values(self) -> DataFrame:
        """(f, num, text) with the rows n of each distinct value and what their targets sum to."""
        place = {f: i + 1 for i, f in enumerate(self.holey)}
        # ranks about their mean, which is that of the feature's complete pairs
        ranks = [F.col("ranks")[place.get(i, 0)] - (pairs + 1) / 2.0 for i, pairs in enumerate(self.facts["pairs"])]
        low = F.col("target") == F.lit(self.facts["smallest"][0]) if self.two_valued else F.lit(False)
        return self._summed(self.ranked_rows, self.features, ranks, low)

    @cached_property
    def text_values(self) -> DataFrame:
        """``values`` of the text features alone, without ranks."""
        if not self.numeric_target:
            return self.values
        mean = self.wide.agg(F.avg("y")).first()[0] or 0.0
        rows = self.wide.withColumn("v", F.col("y") - F.lit(mean))
        return self._summed(rows, self.texts, [F.lit(0.0)] * len(self.features), F.lit(False))

    def _summed(self, rows: DataFrame, names: Sequence[str], ranks: Sequence[Column], low: Column) -> DataFrame:
        """Texts that only stand beside missing targets have n = 0: they count as values of the text's codes."""
        entries = []
        for i, name in enumerate(self.features):
            x, number = F.col(f"x{i}"), name in self.numbers
            entry = F.struct(
                F.lit(i).alias("f"),
                (x if number else F.lit(None).cast("double")).alias("num"),
                (F.lit(None).cast("string") if number else x).alias("text"),
                ranks[i].cast("double").alias("y"),
            )
            if name in names:
                entries.append(F.when(x.isNotNull() & F.col("y").isNotNull() if number else x.isNotNull(), entry))
        long = rows.select(F.col("y").alias("target"), "v", F.inline(F.array(*entries))).where("f IS NOT NULL")
        present = F.col("target").isNotNull()
        return long.groupBy(*_VALUE).agg(
            F.count("target").alias("n"),
            F.count_if(present & low).alias("low"),
            F.sum("y").alias("y"),
            F.sum(F.col("y") * F.col("y")).alias("yy"),
            F.sum("v").alias("v"),
            F.sum(F.col("v") * F.col("v")).alias("vv"),
            F.min("v").alias("v_min"),
            F.max("v").alias("v_max"),
        )

    def name_of(self, f: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.features)), f + 1)

    @cached_property
    def moments(self) -> DataFrame:
        """Per feature: centred second moments of ranks and codes, and the wins of the higher class."""
        return self._moments(self.values)

    @property
    def text_moments(self) -> DataFrame:
        if "moments" in self.__dict__ or not self.numeric_target:
            return self.moments.where(F.col("feature").isin(self.texts))
        return self._moments(self.text_values)

    def _moments(self, values: DataFrame) -> DataFrame:
        partitions = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = values.repartitionByRange(partitions, *_VALUE).sortWithinPartitions(*_VALUE)
        schema = "f int, part int, v_min double, v_max double, " + ", ".join(f"{s} double" for s in _SUMS)
        parts = durable(placed.mapInArrow(_part_sums, schema))
        # one row per feature and partition
        each = Window.partitionBy("f")
        earlier = each.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

        def offset(name: str) -> Column:
            return F.coalesce(F.sum(name).over(earlier), F.lit(0.0))

        middle = (F.sum("n").over(each) + 1) / 2
        shifted = parts.select("*", (offset("n") - middle).alias("d"), offset("k").alias("o"), offset("low").alias("before_low"))
        d, o, n = F.col("d"), F.col("o"), F.col("n")
        sums = shifted.groupBy("f").agg(
            F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("used").alias("used"),
            F.sum(F.col("rr") + 2 * d * F.col("r") + d * d * n).alias("xx"),
            F.sum(F.col("ry") + d * F.col("y")).alias("xy"),
            F.sum("yy").alias("yy"),
            F.sum(F.col("i") + o * n).alias("i"),
            F.sum(F.col("ii") + 2 * o * F.col("i") + o * o * n).alias("ii"),
            F.sum(F.col("iv") + o * F.col("v")).alias("iv"),
            F.sum("v").alias("v"), F.sum("vv").alias("vv"),
            F.sum(F.col("wins") + F.col("before_low") * F.col("high")).alias("wins"),
            F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"),
        )
        varies = (F.col("n") >= 2) & (F.col("used") >= 2) & (F.col("v_min") < F.col("v_max"))
        return sums.select("*", self.name_of(F.col("f")).alias("feature"), varies.alias("varies"))

    @cached_property
    def x_totals(self) -> DataFrame:
        """Per distinct value of complete pairs: x (a text's code), its rows n and those of smaller values."""
        counts = self.values.select(
            self.name_of(F.col("f")).alias("feature"), F.struct("num", "text").alias("at"), "n", F.lit(1).alias("one")
        )
        totals = running_totals(counts, ["feature"], "at", ["n", "one"])
        x = F.coalesce("at.num", F.col("before_one").cast("double"))
        return totals.where("n > 0").select("feature", x.alias("x"), "n", "before_n", "total_n")


def _part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a sorted partition per feature, ranks and codes counted from its first row of the feature."""
    from pyspark import TaskContext

    running, found = RunningSums(["f"], ["n", "low", "one"]), {}
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = batch.append_column("one", pa.array(np.ones(batch.num_rows, np.int64)))
        starts, before = running.before(batch)
        table = {c: np.nan_to_num(batch.column(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("n", "low", "y", "yy", "v", "vv")}
        n, low, y, v = (table[c] for c in ("n", "low", "y", "v"))
        high, i = n - low, before["one"].astype(float)
        r = before["n"] + (n + 1) / 2
        sums = {
            "n": n, "low": low, "high": high, "k": np.ones_like(n), "used": (n > 0) * 1.0,
            "r": n * r, "rr": n * r * r, "ry": r * y, "y": y, "yy": table["yy"],
            "i": n * i, "ii": n * i * i, "iv": i * v, "v": v, "vv": table["vv"], "wins": high * (before["low"] + low / 2),
        }
        per_group = np.stack([np.add.reduceat(sums[s], starts) for s in _SUMS], axis=1)
        ends = [
            f.reduceat(np.where(np.isnan(c := batch.column(m).to_numpy(zero_copy_only=False).astype(float)), none, c), starts)
            for f, m, none in ((np.minimum, "v_min", np.inf), (np.maximum, "v_max", -np.inf))
        ]
        for at, f in enumerate(batch.column("f").take(pa.array(starts)).to_pylist()):
            old = found.get(f, (np.inf, -np.inf, np.zeros(len(_SUMS))))
            found[f] = (min(old[0], ends[0][at]), max(old[1], ends[1][at]), old[2] + per_group[at])
    part = TaskContext.get().partitionId()
    rows = [dict(zip(_SUMS, sums), f=f, part=part, v_min=low, v_max=high) for f, (low, high, sums) in found.items()]
    fields = [("f", pa.int32()), ("part", pa.int32()), ("v_min", pa.float64()), ("v_max", pa.float64()), *[(s, pa.float64()) for s in _SUMS]]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def weighted_pearson(pairs: DataFrame, group: Sequence[str], x: str, y: str, n: str = "n") -> DataFrame:
    """Pearson per group over counted pairs; NULL for one row or a constant side."""
    w = F.col(n)
    means = pairs.groupBy(*group).agg(
        F.sum(w).alias("_rows"),
        (F.sum(w * F.col(x)) / F.sum(w)).alias("_mx"),
        (F.sum(w * F.col(y)) / F.sum(w)).alias("_my"),
    )
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sums = (
        pairs.join(means, list(group))
        .groupBy(*group, "_rows")
        .agg(
            F.sum(w * dx * dy).alias("_xy"),
            F.sum(w * dx * dx).alias("_xx"),
            F.sum(w * dy * dy).alias("_yy"),
            F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"),
        )
    )
    varies = (F.col("_rows") >= 2) & (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))
    value = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return sums.select(*group, F.when(varies, value).alias("correlation"))


def pearson(tables: LeakageTables) -> DataFrame:
    """Pearson per feature; numbers in one map-side pass, texts by their codes."""
    parts = []
    if tables.numbers:
        rows = tables.wide if tables.numeric_target else tables.ranked_rows
        y = "y" if tables.numeric_target else "v"
        aggs, found = [], []
        for i, name in enumerate(tables.features):
            if name in tables.numbers:
                # moments are taken over complete pairs
                x, v = F.when(F.col(y).isNotNull(), F.col(f"x{i}")), F.when(F.col(f"x{i}").isNotNull(), F.col(y))
                varies = (F.min(x) < F.max(x)) & (F.min(v) < F.max(v))
                value = F.try_divide(F.covar_pop(x, v), F.stddev_pop(x) * F.stddev_pop(v))
                aggs.append(F.when(varies, value).alias(f"c{i}"))
                found.append(F.struct(F.lit(name).alias("feature"), F.col(f"c{i}").alias("correlation")))
        parts.append(rows.agg(*aggs).select(F.inline(F.array(*found))))
    if tables.texts:
        n = F.col("n")
        between = F.col("iv") - F.col("i") * F.col("v") / n
        spread = (F.col("ii") - F.col("i") * F.col("i") / n) * (F.col("vv") - F.col("v") * F.col("v") / n)
        value = F.when(F.col("varies"), F.try_divide(between, F.sqrt(spread)))
        parts.append(tables.text_moments.where(n > 0).select("feature", value.alias("correlation")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def spearman(tables: LeakageTables) -> DataFrame:
    """Pearson of the average ranks of complete pairs."""
    value = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return tables.moments.where("n > 0").select("feature", F.when(F.col("varies"), value).alias("correlation"))


def rank_biserial(tables: LeakageTables) -> DataFrame:
    """2 * AUC - 1 of each feature as a score; only for two-valued targets."""
    auc = F.try_divide(F.col("wins"), F.col("low") * F.col("high"))
    return tables.moments.where("n > 0").select("feature", (2 * auc - 1).alias("correlation"))


def strongest(tables: LeakageTables, limit: int | None = REPORTED) -> DataFrame:
    """The strongest method per feature, best features first; all of them without a ``limit``."""
    methods = [("spearman", spearman(tables), 1)]
    if tables.two_valued:
        methods.append(("rank_biserial", rank_biserial(tables), 2))
    if tables.numeric_target:  # after the ranks, whose sums it shares
        methods.insert(0, ("pearson", pearson(tables), 0))
    parts = [
        d.select("feature", "correlation", F.lit(m).alias("method"), F.lit(p).alias("priority"))
        for m, d, p in methods
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # ties inside rounding noise go to the earlier method, then to the feature name
    strength = F.round(F.abs("correlation"), 9)
    best = Window.partitionBy("feature").orderBy(strength.desc(), "priority")
    each = (
        rows.where("correlation IS NOT NULL AND NOT isnan(correlation)")
        .withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("feature", "correlation", "method")
    )
    if limit is None:
        return each
    return each.orderBy(F.round(F.abs("correlation"), 9).desc(), "feature").limit(limit)


def candidate_leaks(evidence: DataFrame) -> DataFrame:
    """The suspicious rows of ``strongest(tables, None)``."""
    return evidence.where(F.abs("correlation") >= SUSPICIOUS)


def match_rate(df: DataFrame, y_true: str, y_pred: str, task: str) -> DataFrame:
    """Rows, their trustworthiness and the exact agreement of truth and prediction."""
    types = {f.name: f.dataType for f in df.schema.fields}
    t, p = C.value_or_null(y_true, types[y_true]), C.value_or_null(y_pred, types[y_pred])
    if task == "regression":
        same: Column = t.try_cast("double") == p.try_cast("double")  # NULL pairs drop out of the mean
    else:
        same = F.coalesce(t == p, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(same.cast("int")).alias("match_rate"),
        (F.count(F.lit(1)) >= TRUSTWORTHY_ROWS).alias("trustworthy"),
    )
