"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join many ``rows`` to the few ``lookup`` rows of their key.

    The rows of a hot key are spread over ``salts`` tasks by the hash of the
    ``spread`` columns; each lookup row is repeated once per salt.
    """
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted_rows.join(repeated, [*keys, "_salt"], how).drop("_salt")


def weighed_join(
    rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread: Sequence[str | Column], how: str = "left", share: float = 0.01
) -> DataFrame:
    """Join many ``rows`` to the one ``lookup`` row of their key, hot keys by their measured weight.

    A key with more than ``share`` of the rows is spread over as many salts as it holds shares and its lookup row is
    repeated as often, so there are at most 1 / share hot keys and 2 / share copies.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    held = F.col("_n") / (counts.agg(F.sum("_n")).scalar() * F.lit(share))
    hot = F.broadcast(counts.where(held > 1).select(*keys, F.ceil(held).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = rows.join(hot, list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    copies = lookup.join(hot, list(keys), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def hot_key_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str | Column],
    weight: str,
    total: str,
    how: str = "inner",
    share: float = 0.001,
) -> DataFrame:
    """Join rows to a large ``lookup`` that knows how many rows each key has.

    Only keys with more than ``share`` of ``total`` are salted and repeated, each over as many
    salts as it holds shares, so no salt holds more than one. There are at most 1 / share such
    keys per total, and 1 / share salts in all, so their list can be broadcast.
    """
    held = F.col(weight) / (F.col(total) * F.lit(share))
    salts = F.when(held > 1, F.ceil(held).cast("int")).otherwise(1)
    hot_keys = lookup.where(held > 1).select(*keys, salts.alias("_salts"))
    marked = rows.join(F.broadcast(hot_keys), list(keys), "left")
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("_salts", F.lit(1))).cast("int")
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return marked.withColumn("_salt", salt).drop("_salts").join(
        repeated.drop(weight, total), [*keys, "_salt"], how
    ).drop("_salt")
