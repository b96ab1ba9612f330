"""Exact quantiles of many number columns by selection, without sorting or shuffling the rows.

A quantile lies between the values of two neighbouring ranks. A sketch of each column, merged from the partitions,
gives a bracket that should hold both. One more scan counts the rows below each bracket and the values inside, which
proves it; a bracket that misses its ranks starts anew from all values. Where a sketch leaves many rows, brackets are
first narrowed by sketches of the rows inside, each of which leaves a small share of them, until few are left.

Brackets are a few numbers per column, so they are kept by the driver and written into the next scan. Values that a
large share of the rows hold cost nothing: they are a bracket's end, not rows inside it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.session import durable

ACCURACY = 1_000  # a sketch is off by at most this part of the rows
ENOUGH = 50_000  # rows strictly inside a bracket that are sorted
MOST_ROUNDS = 8


@dataclass
class _Bracket:
    """Between ``low`` and ``high`` lie the ranks ``first`` and ``last`` (zero-based) of a column's quantile ``point``."""

    name: str
    point: int
    first: int
    last: int
    part: float
    rows: int  # of the column
    ends: tuple[float, float]  # of the column
    low: float
    high: float
    below: int = 0
    inside: int = 0
    strictly: int = 0
    settled: bool = False

    def holds(self, value: Column) -> Column:
        return (value >= self.low) & (value <= self.high)


def _one_row(df: DataFrame, aggregates: Sequence[Column]) -> list:
    """The values of many aggregates, from one scan without a shuffle of rows."""
    return list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first()) if aggregates else []


def _sketch(value: Column, shares: Sequence[tuple[float, float]], accuracy: int) -> Column:
    """Of each (low, high) share of the rows a value below and one above, as one array."""
    spread = [F.lit(s) for low, high in shares for s in (max(0.0, low - 2 / accuracy), min(1.0, high + 2 / accuracy))]
    return F.percentile_approx(value, F.array(*spread), accuracy)


def _counted(df: DataFrame, brackets: Sequence[_Bracket]) -> None:
    counts = []
    for b in brackets:
        value = F.col(b.name)
        counts += [F.count_if(value < b.low), F.count_if(b.holds(value)), F.count_if((value > b.low) & (value < b.high))]
    found = _one_row(df, counts)
    for i, b in enumerate(brackets):
        b.below, b.inside, b.strictly = found[3 * i : 3 * i + 3]


def quantiles_of(
    df: DataFrame, names: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY, enough: int = ENOUGH
) -> DataFrame:
    """(feature, q): the linearly interpolated quantiles of each number column that has a value.

    NaN counts as missing. ``accuracy`` and ``enough`` change the work, never the result.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = df.select(*[C.value_or_null(n, types[n]).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    firsts = []
    for i in range(len(names)):
        value = F.col(f"c{i}")
        firsts += [F.count(value), F.min(value), F.max(value), _sketch(value, [(p, p) for p in probs], accuracy)]
    found, brackets = _one_row(wide, firsts), []
    for i in range(len(names)):
        rows, low, high, sketched = found[4 * i : 4 * i + 4]
        for k, p in enumerate(probs if rows else ()):
            # 1e-9 keeps (N - 1) * p on its integer when the product lands just beside it
            at = (rows - 1) * p
            first, last = math.floor(at + 1e-9), math.ceil(at - 1e-9)
            brackets.append(_Bracket(f"c{i}", k, first, last, max(at - first, 0.0), rows, (low, high), *sketched[2 * k : 2 * k + 2]))
    if not brackets:
        return df.sparkSession.createDataFrame([], "feature string, q array<double>")
    # a bracket spans four parts of the sketch, each end off by one more at most
    _narrow(wide, [b for b in brackets if 6 * b.rows / accuracy > enough], accuracy, enough)
    counts = _values_inside(wide, brackets)
    missed = _proved(counts, brackets)
    if missed:
        for b in missed:
            b.low, b.high, b.below, b.inside, b.strictly = *b.ends, 0, b.rows, b.rows
        _narrow(wide, missed, accuracy, enough)
        counts = _values_inside(wide, brackets)
        _proved(counts, brackets)
    listed = _sorted_out(counts, brackets)
    listed = listed.withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1))
    return listed.groupBy("feature").agg(F.array_sort(F.collect_list("point"))["q"].alias("q"))


def _narrow(wide: DataFrame, brackets: list[_Bracket], accuracy: int, enough: int) -> None:
    """Settle every bracket: proved by counts, and with few rows strictly inside."""
    for turn in range(MOST_ROUNDS):
        todo = [b for b in brackets if not b.settled]
        before = {id(b): b.strictly for b in todo}
        _counted(wide, todo)
        for b in todo:
            if not (b.below <= b.first and b.last < b.below + b.inside):
                b.low, b.high = b.ends
                b.below, b.inside, b.strictly = 0, b.rows, b.rows
            elif b.strictly <= enough or turn and b.strictly >= before[id(b)]:
                b.settled = True
        todo = [b for b in todo if not b.settled]
        if not todo:
            return
        inner = []
        for b in todo:
            value = F.when(b.holds(F.col(b.name)), F.col(b.name))
            inner.append(_sketch(value, [((b.first - b.below) / b.inside, (b.last - b.below) / b.inside)], accuracy))
        for b, (low, high) in zip(todo, _one_row(wide, inner)):
            b.low, b.high = low, high
    for b in brackets:
        if not b.settled:  # no sketch held: all values of the column are sorted
            (b.low, b.high), b.below = b.ends, 0


def _values_inside(wide: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """(bracket, value, n): rows per value inside each bracket, and the rows below it as a null value."""
    entries = []
    for i, b in enumerate(brackets):
        value = F.col(b.name)
        inside = F.when(value >= b.low, value)
        entries.append(F.when(value <= b.high, F.struct(F.lit(i).alias("bracket"), inside.alias("value"))))
    held = wide.select(F.inline(F.array(*entries))).where("bracket IS NOT NULL")
    return durable(held.groupBy("bracket", "value").agg(F.count(F.lit(1)).alias("n")))


def _proved(counts: DataFrame, brackets: Sequence[_Bracket]) -> list[_Bracket]:
    """Take the rows below and inside from ``counts``; the brackets that miss their ranks."""
    for b in brackets:
        b.below = b.inside = 0
    sums = counts.groupBy("bracket").agg(F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("below"), F.sum("n").alias("upto"))
    for r in sums.collect():
        b = brackets[r.bracket]
        b.below = r.below or 0
        b.inside = r.upto - b.below
    return [b for b in brackets if not b.below <= b.first <= b.last < b.below + b.inside]


def _sorted_out(counts: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """(at, point (k, q)) of each bracket, from the values inside it."""
    facts = F.array(*[
        F.struct(
            F.lit(int(b.name[1:])).alias("at"), F.lit(b.point).alias("k"), F.lit(b.first - b.below).alias("first"),
            F.lit(b.last - b.below).alias("last"), F.lit(b.part).alias("part"),
        )
        for b in brackets
    ])
    up_to = Window.partitionBy("bracket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = counts.where("value IS NOT NULL")
    ranked = inside.select("bracket", "value", "n", F.sum("n").over(up_to).alias("through"))
    fact = ranked.select("*", F.element_at(facts, F.col("bracket") + 1).alias("b"))

    def at_rank(rank: str) -> Column:
        return F.min(F.when(F.col("through") > F.col(f"b.{rank}"), F.col("value")))

    ends = fact.groupBy("bracket", "b").agg(at_rank("first").alias("low"), at_rank("last").alias("high"))
    q = F.col("low") + (F.col("high") - F.col("low")) * F.col("b.part")
    # equal ends may be infinite
    q = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(q)
    return ends.select("b.at", F.struct(F.col("b.k").alias("k"), q.alias("q")).alias("point"))
