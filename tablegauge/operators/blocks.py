"""Order-dependent columns over long sequences, block by block.

A sequence (one run) may hold a large share of all rows, so no window spans a
whole run. Rows are cut into blocks by their sequence number; a window runs inside
each block and a small table with one row per block carries values across.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1_000_000


def _blocked(df: DataFrame, seq: str, size: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(seq) / F.lit(size)))


def previous(
    df: DataFrame, keys: Sequence[str], seq: str, columns: Mapping[str, Column], size: int = BLOCK
) -> DataFrame:
    """Add, per entry of ``columns``, its last non-null value on earlier rows."""
    rows = _blocked(df, seq, size).withColumns({f"_v_{n}": c for n, c in columns.items()})
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_block").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(seq))).alias(f"_e_{n}") for n in columns]
    )
    carried = ends.select(
        *keys, "_block", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in columns]
    )
    joined = rows.join(carried, [*keys, "_block"])
    return joined.select(
        *df.columns,
        *[F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")).alias(n) for n in columns],
    )


def positions(df: DataFrame, keys: Sequence[str], seq: str, name: str = "position", size: int = BLOCK) -> DataFrame:
    """Add the zero-based position of each row in its sequence."""
    rows = _blocked(df, seq, size)
    inside = Window.partitionBy(*keys, "_block").orderBy(seq)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = rows.join(offsets, [*keys, "_block"])
    return joined.select(*df.columns, (F.row_number().over(inside) - 1 + F.col("_offset")).alias(name))
