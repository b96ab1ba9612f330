"""Dataset preparation: duplicate groups, group-aware splits, planted leaks, draws.

Choices that the original tools make with a seeded generator are made here by a
seeded hash of the row key, so they do not depend on partitions or retries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.operators.order_stats import quantiles, running_totals, value_counts
from tablegauge.operators.skew import hot_key_join
from tablegauge.session import durable

HOLDOUT = 0.25


def group_code(names: Sequence[str]) -> Column:
    """A code equal exactly for equal rows; two NULLs are equal."""
    row = F.struct(*[C.col(n) for n in names])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def group_split(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    stratum: str | None = None,
    fraction: float = HOLDOUT,
    seed: int = 0,
) -> DataFrame:
    """Add ``group_code`` and ``holdout``: whole duplicate groups on one side.

    A stratum's groups are ordered by a seeded hash and the first ``fraction`` of
    them is held out; the order is ranked in parts, so a stratum may be large.
    """
    coded = df.withColumn("group_code", group_code(columns))
    label = F.coalesce(C.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    groups = coded.groupBy("group_code", label.alias("_stratum")).agg(F.count(F.lit(1)).alias("_copies"))
    order = F.sha2(F.concat("group_code", F.lit(str(seed))), 256)
    ranked = running_totals(
        groups.withColumns({"_order": order, "_one": F.lit(1)}), ["_stratum"], "_order", ["_one", "_copies"]
    )
    chosen = ranked.select(
        "group_code",
        (F.col("before__one") < F.round(F.col("total__one") * fraction)).alias("holdout"),
        "_copies",
        "total__copies",
    )
    return hot_key_join(coded, chosen, ["group_code"], list(keys), "_copies", "total__copies")


def contamination(holdout: DataFrame, train: DataFrame, keys: Sequence[str], code: str = "group_code") -> DataFrame:
    """Rows of the holdout whose identical copy is in the training side."""
    copies = holdout.groupBy(code).agg(F.count(F.lit(1)).alias("_copies"))
    total = holdout.agg(F.count(F.lit(1))).scalar()
    known = train.select(code).distinct().join(copies, code).withColumn("_total", total)
    return hot_key_join(holdout, known, [code], list(keys), "_copies", "_total", "left_semi")


def split_facts(split: DataFrame, stratum: str | None = None) -> DataFrame:
    """Rows, groups, duplicates and minority share of each side."""
    per_group = split.groupBy("holdout", "group_code").agg(F.count(F.lit(1)).alias("n"))
    facts = per_group.groupBy("holdout").agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("duplicates")
    )
    if stratum is None:
        return facts
    classes = split.where(C.col(stratum).isNotNull()).groupBy("holdout", C.col(stratum).alias("_c")).agg(
        F.count(F.lit(1)).alias("n")
    )
    share = classes.groupBy("holdout").agg((F.min("n") / F.sum("n")).alias("minority_share"))
    return facts.join(share, "holdout", "left")


# ---------------------------------------------------------------- planted leaks


def uniform(keys: Sequence[str], seed: int, stream: int = 0) -> Column:
    """A number in (0, 1) drawn from the hash of the row key."""
    bits = F.pmod(F.xxhash64(*[C.col(k) for k in keys], F.lit(seed), F.lit(stream)), F.lit(2**53))
    return (bits + 0.5) / F.lit(float(2**53))


def gaussian(keys: Sequence[str], seed: int) -> Column:
    """Standard normal noise per row key (Box-Muller)."""
    radius = F.sqrt(-2 * F.ln(uniform(keys, seed, 1)))
    return radius * F.cos(2 * math.pi * uniform(keys, seed, 2))


def inject_copy(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(f"{target}_copy", C.col(target))


def inject_noisy_proxy(df: DataFrame, target: str, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Target plus noise of a tenth of its deviation."""
    spread = df.agg(F.stddev_pop(C.col(target))).scalar()
    scale = F.when(spread == 0, 1.0).otherwise(spread)
    return df.withColumn(f"{target}_proxy", C.col(target) + 0.1 * scale * gaussian(keys, seed))


def inject_monotone_log(df: DataFrame, target: str, keys: Sequence[str], seed: int = 0) -> DataFrame:
    low = df.agg(F.min(C.col(target))).scalar()
    return df.withColumn(f"{target}_log", F.ln(C.col(target) - low + 1) + 0.01 * gaussian(keys, seed))


def inject_inverse(df: DataFrame, target: str) -> DataFrame:
    low = df.agg(F.min(C.col(target))).scalar()
    return df.withColumn(f"{target}_inverse", 1 / (C.col(target) - low + 1))


def inject_binned(df: DataFrame, target: str, bins: int = 20) -> DataFrame:
    """The mean of the target's quantile bin; bins are open below, closed above."""
    counts = value_counts(C.long_form(df, [target], "double"))
    totals = running_totals(counts, ["feature"], "value", ["n"], reused=True)
    cuts = quantiles(totals, [i / bins for i in range(1, bins)]).select(
        F.array_distinct(F.array_sort("q")).alias("cuts")
    )
    edges = cuts.scalar()

    def binned(rows: DataFrame, value: Column) -> DataFrame:
        below = F.size(F.filter("_cuts", lambda e: e < value))
        return rows.withColumn("_cuts", edges).withColumn("_bin", below).drop("_cuts")

    # One row per bin.
    means = binned(totals, F.col("value")).groupBy("_bin").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias(f"{target}_binned")
    )
    return binned(df, C.col(target).cast("double")).join(F.broadcast(means), "_bin", "left").drop("_bin")


def inject_memorised(df: DataFrame, target: str, prediction: str, keys: Sequence[str], share: float = 0.97, seed: int = 0) -> DataFrame:
    """Predictions equal to the truth on a share of the rows, as after contamination."""
    memorised = uniform(keys, seed) < share
    return df.withColumn(prediction, F.when(memorised, C.col(target)).otherwise(C.col(prediction)))


# ---------------------------------------------------------------- names and draws


def pseudonym(name: str) -> str:
    return "col_" + hashlib.sha256(name.encode()).hexdigest()[:8]


def pseudonymise(df: DataFrame, keep: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Columns renamed by the hash of their name, and the mapping."""
    mapping = {c: pseudonym(c) for c in df.columns if c not in keep}
    return df.withColumnsRenamed(mapping), mapping


def largest_remainder(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """Whole quotas proportional to ``n`` that sum to ``total``."""
    everything = counts.agg(F.sum(n)).scalar()
    exact = F.col(n) * total / everything
    rows = counts.withColumn("exact", exact).withColumn("quota", F.floor("exact"))
    given = rows.agg(F.sum("quota")).scalar()
    # One row per stratum.
    place = F.row_number().over(Window.orderBy((F.col("exact") - F.col("quota")).desc(), *counts.columns))
    rows = rows.withColumn("_place", place)
    return rows.select(*counts.columns, (F.col("quota") + (F.col("_place") <= total - given).cast("long")).alias("quota"))


def draw_proportional(pool: DataFrame, stratum: str, key: str, total: int, seed: int = 0) -> DataFrame:
    """A seeded draw of ``total`` rows, strata in proportion."""
    quotas = largest_remainder(pool.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), total).select(stratum, "quota")
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key)
    best = pool.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= total)
    return best.join(F.broadcast(quotas), stratum).where(F.col("_place") <= F.col("quota")).drop("_place", "quota")


def draw_fixed(items: DataFrame, quotas: Mapping[str, int], seed: int = 0) -> DataFrame:
    """Fixed quotas per stratum of (response_id, item, stratum), in the given order.

    One item per response, and no response twice across the strata.
    """
    used = picks = None
    for stratum, quota in quotas.items():
        order = F.xxhash64("response_id", "item", F.lit(seed))
        eligible = items.where(F.col("stratum") == stratum)
        if used is not None:
            eligible = eligible.join(used, "response_id", "left_anti")
        one = eligible.groupBy("response_id", "stratum").agg(F.min(F.struct(order.alias("h"), "item")).alias("best"))
        chosen = durable(
            one.orderBy("best.h", "response_id").limit(quota).select("response_id", "stratum", F.col("best.item").alias("item"))
        )
        picks = chosen if picks is None else picks.unionByName(chosen)
        used = picks.select("response_id")
    return picks
