"""Order statistics over value counts: running totals, quantiles, ranks, codes.

Everything that needs a global order starts from a table of distinct values with
their counts. Duplicates collapse in the map-side aggregate, so a value held by a
third of all rows is one row here, and the running total is built in two levels:
inside each range partition, plus the offset of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.operators.sorted_pass import numbered
from tablegauge.session import durable


def value_counts(long: DataFrame, group: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """Rows per distinct value and group."""
    return long.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def running_totals(
    counts: DataFrame, group: Sequence[str], order: str, sums: Sequence[str], reused: bool = False
) -> DataFrame:
    """Add ``before_<s>`` (total of smaller values) and ``total_<s>`` per group.

    ``counts`` holds one row per (group, order). Range partitions are read in one sorted
    pass that sums inside each, and the partitions before it are added. ``reused`` keeps the
    result, for callers that read it several times. The range-partitioned rows are
    checkpointed, because the partition number read by the offsets and by the rows
    must be the same one even when an executor is lost and its partitions are computed again.
    ``counts`` itself is read twice, to find the ranges; after a ``groupBy`` only its last step is repeated.
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {s: "double" if counts.schema[s].dataType in (T.DoubleType(), T.FloatType()) else "bigint" for s in sums}
    counts = counts.withColumns({s: F.col(s).cast(kind) for s, kind in kinds.items()})
    added = T.StructType([T.StructField("_part", T.IntegerType()), *[T.StructField(f"before_{s}", counts.schema[s].dataType) for s in sums]])
    ordered = counts.repartitionByRange(partitions, *group, order).sortWithinPartitions(*group, order)
    placed = durable(ordered.mapInArrow(numbered(group, sums), T.StructType([*counts.schema.fields, *added.fields])))
    per_part = placed.groupBy(*group, "_part").agg(*[F.sum(s).alias(f"_sum_{s}") for s in sums])
    by_group = Window.partitionBy(*group)
    earlier = by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A group meets a partition at most once per range, so this has about
    # partitions + groups rows.
    offsets = per_part.select(
        *group,
        "_part",
        *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_offset_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(by_group).alias(f"total_{s}") for s in sums],
    )
    result = placed.join(offsets, [*group, "_part"]).select(
        *counts.columns, *[(F.col(f"before_{s}") + F.col(f"_offset_{s}")).alias(f"before_{s}") for s in sums], *[f"total_{s}" for s in sums]
    )
    return durable(result) if reused else result


def quantiles(
    totals: DataFrame, probs: Sequence[float], group: Sequence[str] = ("feature",), n: str = "n"
) -> DataFrame:
    """One row per group with the array ``q`` of linear-interpolated quantiles.

    The p-quantile sits at position ``(N - 1) * p`` of the sorted rows, and a
    value covers the positions from ``before`` up to ``before + n - 1``. Each value
    knows N, so it tells by itself which of the wanted positions it covers.
    """
    before, rows = F.col(f"before_{n}"), F.col(n)
    points = []
    for i, p in enumerate(probs):
        at = (F.col(f"total_{n}") - 1) * F.lit(float(p))
        # 1e-9 keeps (N - 1) * p on its integer when the product lands just beside it
        low, high = F.floor(at + F.lit(1e-9)), F.ceil(at - F.lit(1e-9))
        covers = ((low >= before) & (low < before + rows)) | ((high >= before) & (high < before + rows))
        points.append(F.when(covers, F.struct(F.lit(i).alias("i"), F.greatest(at - low, F.lit(0.0)).alias("part"))))
    hits = totals.where(rows > 0).select(*group, "value", F.explode(F.array_compact(F.array(*points))).alias("point"))
    ends = hits.groupBy(*group, "point").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    q = F.col("low") + (F.col("high") - F.col("low")) * F.col("point.part")
    listed = ends.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("point.i", q.alias("q")))).alias("points"))
    return listed.select(*group, F.col("points.q").alias("q"))


def average_ranks(totals: DataFrame, n: str = "n") -> DataFrame:
    """Add ``rank``: the mean of the 1-based positions its tied rows span."""
    return totals.withColumn("rank", F.col(f"before_{n}") + (F.col(n) + 1) / F.lit(2.0))


def ordinal_codes(
    levels: DataFrame, group: Sequence[str] = ("feature",), value: str = "value"
) -> DataFrame:
    """Zero-based code of each distinct value in sorted order, with its rows ``n``."""
    counted = levels.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    ranked = running_totals(counted, group, value, ["_one", "n"])
    return ranked.select(*group, value, F.col("before__one").cast("double").alias("code"), "n", "total_n")
