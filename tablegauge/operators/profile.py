"""Column profiles: semantic types, summaries, target, task and quality warnings.

One scan without a shuffle gives the counts, means, extremes and lengths of all
columns, one more the outliers; quartiles are selected (``selection.quantiles_of``)
and never sort a column. What is shuffled are the values of columns with few of them,
and 128-bit hashes of texts to count the different ones. ``approximate=True`` takes
quartiles from sketches.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions import columns as C
from tablegauge.functions import dates
from tablegauge.functions.numbers import is_number
from tablegauge.operators.order_stats import value_counts
from tablegauge.operators.selection import quantiles_of
from tablegauge.session import durable

# Names that mark a target column, strongest list first.
TARGET_NAMES_HIGH = (
    "target", "label", "y", "churn", "fraud", "default", "is_fraud", "is_churn", "survived",
    "is_survived", "purchased", "is_purchase", "is_purchased", "clicked", "is_clicked", "converted",
    "is_converted", "accepted", "approved", "winner", "species", "class_label", "category_label",
    "digit", "genre", "sentiment", "intent", "language", "saleprice", "sale_price", "price",
    "saleamount", "sale_amount", "charges", "total_charges", "medical_cost",
)
TARGET_NAMES_MEDIUM = (
    "outcome", "result", "class", "category", "response", "engagement", "subscribed", "active",
    "amount", "value", "score", "revenue", "cost", "salary", "rating", "fee", "tuition", "expenses",
    "arpu", "spend",
)
# Fixed values of the profile rules.
YEAR_NAMES = ("year", "yr")
YEAR_RANGE = (1800, 2200)
FEW_LEVELS, MANY_LEVELS, TEXT_RATIO = 10, 500, 0.5
NUMBER_SHARE = 0.95
SPARSE_ABOVE = 0.5
HASHES_A_PART = 8_000_000  # of texts, told apart by one task
COUNTED_TEXTS = 50_000  # different texts of a column whose rows are counted; a categorical column has fewer
TEXT_FACTS = {
    "shaped_share": "double", "date_share": "double", "number_share": "double", "unparsed_count": "long",
    "text_min": "timestamp_ntz", "text_max": "timestamp_ntz", "text_midnight": "boolean",
}
SKETCHED_FEW = 8  # a sketch off by a few percent cannot give a column of two values more
DUPLICATE_SHARE = 0.005
CENSORED_SHARE, CENSORED_LEVELS = 0.01, 20


@dataclass
class ProfileTables:
    """A table with the reduced forms its profile reads."""

    df: DataFrame
    approximate: bool = False

    @cached_property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields}

    def base(self, name: str) -> str:
        dtype = self.types[name]
        if isinstance(dtype, T.BooleanType):
            return "boolean"
        if C.is_temporal(dtype):
            return "datetime"
        if C.is_integer(dtype):
            return "integer"
        return "numeric" if C.is_numeric(dtype) else "string"

    def named(self, *bases: str) -> list[str]:
        return [n for n in self.df.columns if self.base(n) in bases]

    @property
    def numbers(self) -> list[str]:
        return self.named("numeric", "integer")

    @cached_property
    def ends(self) -> dict[str, list[tuple[str, int]]]:
        """The values and their rows of the number columns that hold exactly two, told apart in their own type.

        Columns that a sketch gives many values are out; the others have few, which are counted.
        """
        few = [r.name for r in self.basics.where(F.col("sketched") <= SKETCHED_FEW).select("name").collect()]
        if not few:
            return {}
        texts = self.df.select(*[number_text(C.value_or_null(n, self.types[n]), self.types[n]).alias(n) for n in few])
        found = {n: [] for n in few}
        for r in value_counts(C.long_form(texts, few, "string")).collect():
            found[r.feature].append((r.value, r.n))
        return {n: values for n, values in found.items() if len(values) == 2}

    @cached_property
    def different_texts(self) -> dict[str, int]:
        """The number of different texts of each text column that holds any."""
        return {r.name: r.levels for r in text_levels(self).collect()} if self.named("string") else {}

    @cached_property
    def text_counts(self) -> DataFrame:
        """(feature, value, n) of the text columns with at most ``COUNTED_TEXTS`` different texts."""
        few = [n for n, levels in self.different_texts.items() if levels <= COUNTED_TEXTS]
        return durable(value_counts(C.long_form(self.df, few, "string")))

    @cached_property
    def basics(self) -> DataFrame:
        return durable(column_basics(self))


def number_text(value: Column, kind: T.DataType) -> Column:
    """A number as text; integers and decimals exactly, decimals without closing zeros."""
    if C.is_integer(kind):
        return value.cast("bigint").cast("string")
    if isinstance(kind, T.DecimalType):
        return F.regexp_replace(value.cast("string"), r"\.?0+$", "") if kind.scale else value.cast("string")
    return value.cast("double").cast("string")


def column_basics(tables: ProfileTables) -> DataFrame:
    """Per column, from one scan: missing, moments, extremes, zeros, flags, lengths."""
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []
    nothing = F.lit(None)

    def add(i: int, name: str, agg: Column) -> Column:
        aggs.append(agg.alias(f"{name}_{i}"))
        return F.col(f"{name}_{i}")

    for i, name in enumerate(tables.df.columns):
        base, value = tables.base(name), C.value_or_null(name, tables.types[name])
        number = value.cast("double")
        is_num, is_date = base in ("numeric", "integer"), base == "datetime"
        present = add(i, "present", F.count(value))
        stats = {
            "mean": F.avg(number), "std": F.stddev_samp(number), "min": F.min(number), "max": F.max(number)
        }
        fields = [
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("name"),
            F.lit(base).alias("base"),
            F.lit(tables.types[name].simpleString()).alias("dtype"),
            F.col("rows"),
            (F.col("rows") - present).alias("missing_count"),
            C.ratio(F.col("rows") - present, F.col("rows")).alias("missing_pct"),
            present.alias("present"),
        ]
        for stat, agg in stats.items():
            fields.append((add(i, stat, agg) if is_num else nothing.cast("double")).alias(stat))
        sketched = add(i, "sketched", F.approx_count_distinct(value)) if is_num else nothing.cast("long")
        fields.append(sketched.alias("sketched"))
        zeros = add(i, "zeros", F.count_if(number == 0)) if is_num else nothing.cast("long")
        fields.append(F.try_divide(zeros.cast("double"), present).alias("zero_ratio"))
        yes = add(i, "yes", F.count_if(value)) if base == "boolean" else nothing.cast("long")
        fields += [yes.alias("true_count"), (present - yes).alias("false_count")]
        length = add(i, "len", F.avg(F.char_length(value))) if base == "string" else nothing.cast("double")
        fields.append(length.alias("avg_length"))
        stamp = value.cast("timestamp_ntz")
        first = add(i, "first", F.min(stamp)) if is_date else nothing.cast("timestamp_ntz")
        last = add(i, "last", F.max(stamp)) if is_date else nothing.cast("timestamp_ntz")
        midnight = (
            add(i, "midnight", F.bool_and(F.date_trunc("day", stamp) == stamp))
            if is_date
            else nothing.cast("boolean")
        )
        fields += [first.alias("date_min"), last.alias("date_max"), midnight.alias("date_only")]
        rows.append(F.struct(*fields))
    return tables.df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing(tables: ProfileTables) -> DataFrame:
    """Missing values per column, from counts alone."""
    names = tables.df.columns
    counts = [F.count(C.value_or_null(n, tables.types[n])).alias(f"n{i}") for i, n in enumerate(names)]
    row = tables.df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    cells = F.array(
        *[F.struct(F.lit(n).alias("name"), (F.col("rows") - F.col(f"n{i}")).alias("missing_count")) for i, n in enumerate(names)]
    )
    share = C.ratio(F.col("c.missing_count"), F.col("rows"))
    return row.select("rows", F.explode(cells).alias("c")).select("c.*", share.alias("missing_pct"))


def text_facts(tables: ProfileTables) -> DataFrame:
    """Distinct count and the shares of dates and numbers, per text column.

    Texts of columns with few different ones are matched and parsed once each, with their rows as weight. The code
    is the same for all columns, so that it stays small enough to be compiled.
    """
    found = tables.different_texts
    levels = tables.df.sparkSession.createDataFrame(list(found.items()), "name string, levels long")
    many = [n for n, different in found.items() if different > COUNTED_TEXTS]
    texts = tables.text_counts
    if many:
        texts = texts.unionByName(C.long_form(tables.df, many, "string").withColumn("n", F.lit(1).cast("long")))
    value, rows = F.col("value"), F.col("n")
    shaped = dates.looks_shaped(value)
    # every format has the shape, so other texts need no parsing
    parsed = F.when(shaped, dates.parse_date(value))
    matched = texts.select("feature", "n", shaped.alias("shaped"), parsed.alias("parsed"), is_number(value).alias("number"))
    parsed, stamp = F.col("parsed"), F.col("parsed").cast("timestamp_ntz")

    def share(test: Column) -> Column:
        return F.sum(F.when(test, rows).otherwise(0)).cast("double") / F.sum(rows)

    facts = matched.groupBy(F.col("feature").alias("name")).agg(
        share(F.col("shaped")).alias("shaped_share"),
        share(parsed.isNotNull()).alias("date_share"),
        share(F.col("number")).alias("number_share"),
        F.sum(F.when(parsed.isNull(), rows).otherwise(0)).alias("unparsed_count"),
        F.min(stamp).alias("text_min"),
        F.max(stamp).alias("text_max"),
        F.bool_and(F.date_trunc("day", parsed) == parsed).alias("text_midnight"),
    )
    return facts.join(levels, "name")


def text_levels(tables: ProfileTables) -> DataFrame:
    """Distinct count per text column, over 128-bit hashes.

    No task holds all that its split has: batches drop their own repetitions as they pass, and what is left is dealt
    over so many parts that none holds more than about ``HASHES_A_PART`` of 16 bytes.
    """
    names = tables.named("string")
    pairs = []
    for i, n in enumerate(names):
        first = F.when(C.col(n).isNotNull(), F.xxhash64(C.col(n)))
        pairs += [first.alias(f"h1_{i}"), F.xxhash64(F.lit(1), C.col(n)).alias(f"h2_{i}")]
    once = tables.df.select(*pairs).mapInArrow(_once_a_batch(len(names)), "at int, h1 long, h2 long")
    # a part is one task, so there are at least as many as cores
    parts = max(tables.df.sparkSession.sparkContext.defaultParallelism, -(-tables.df.count() * len(names) // HASHES_A_PART))
    counted = once.repartition(parts, "at", "h1", "h2").mapInArrow(_count_a_part(), "at int, n long")
    name = F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1)
    return counted.groupBy("at").agg(F.sum("n").alias("levels")).select(name.alias("name"), "levels")


def _once_a_batch(columns: int):
    """A ``mapInArrow`` function: the different hash pairs of each column, told apart inside each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(columns):
                pairs = pa.table([batch.column(2 * i), batch.column(2 * i + 1)], names=["h1", "h2"]).drop_null()
                found = pairs.group_by(["h1", "h2"], use_threads=False).aggregate([])
                at = pa.array(np.full(found.num_rows, i, np.int32))
                yield from found.append_column("at", at).select(["at", "h1", "h2"]).combine_chunks().to_batches()

    return run


def _count_a_part():
    """A ``mapInArrow`` function: (at, n) of the different hash pairs of each column in a part, which has all rows of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            different = pa.Table.from_batches(held).group_by(["at", "h1", "h2"], use_threads=False).aggregate([])
            counts = different.group_by("at", use_threads=False).aggregate([([], "count_all")]).rename_columns(["at", "n"])
            yield from counts.combine_chunks().to_batches()

    return run


def number_levels(tables: ProfileTables) -> DataFrame:
    """Distinct count per number column, exact or sketched."""
    names = tables.numbers
    if tables.approximate:
        row = tables.df.agg(*[F.approx_count_distinct(C.col(n)).alias(n) for n in names])
        return row.unpivot([], [C.col(n) for n in names], "name", "levels")
    texts = tables.df.select(*[number_text(C.value_or_null(n, tables.types[n]), tables.types[n]).alias(n) for n in names])
    return value_counts(C.long_form(texts, names, "string")).groupBy(F.col("feature").alias("name")).agg(F.count(F.lit(1)).alias("levels"))


def is_year(tables_row_name: Column, minimum: Column) -> Column:
    """The name says year and the smallest value is a plausible one."""
    named = F.lower(tables_row_name).rlike("|".join(YEAR_NAMES))
    return named & minimum.between(*YEAR_RANGE)


def column_types(tables: ProfileTables) -> DataFrame:
    """Semantic type of every column, with the facts that decided it."""
    facts = tables.basics
    if tables.named("string"):
        facts = facts.join(text_facts(tables), "name", "left")
    for column, kind in {"levels": "long", **TEXT_FACTS}.items():
        if column not in facts.columns:
            facts = facts.withColumn(column, F.lit(None).cast(kind))
    # of a number's values only matters whether there are two
    levels = F.when(F.col("name").isin(*tables.ends), 2) if tables.ends else F.lit(None)
    levels = F.coalesce(levels.cast("long"), F.col("levels"), F.lit(0))
    number = F.col("base").isin("numeric", "integer")
    kind = (
        F.when(F.col("base").isin("boolean", "datetime"), F.col("base"))
        .when(number & (levels == 2) & ~is_year(F.col("name"), F.col("min")), "categorical")
        .when(number, "numeric")
        .when((F.col("shaped_share") >= dates.SHARE) & (F.col("date_share") >= dates.SHARE), "datetime")
        .when(levels <= FEW_LEVELS, "categorical")
        .when(levels >= MANY_LEVELS, "text")
        .when(levels / F.col("present") > TEXT_RATIO, "text")
        .otherwise("categorical")
    )
    return facts.withColumn("levels", levels).withColumn("type", kind)


def numeric_summary(tables: ProfileTables) -> DataFrame:
    """Moments, extremes and quartiles per number column."""
    if tables.approximate:
        names = tables.numbers
        probs = [0.25, 0.5, 0.75]
        row = tables.df.agg(*[F.percentile_approx(C.col(n).cast("double"), probs).alias(n) for n in names])
        q = row.unpivot([], [C.col(n) for n in names], "name", "q")
    else:
        q = quantiles_of(tables.df, tables.numbers, [0.25, 0.5, 0.75]).withColumnRenamed("feature", "name")
    return tables.basics.join(q, "name").select(
        "name", "mean", "std", "min", "max",
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"),
        "zero_ratio", (F.col("zero_ratio") > SPARSE_ABOVE).alias("sparse"),
    )


def outliers(tables: ProfileTables, summary: DataFrame | None = None) -> DataFrame:
    """Rows outside the quartile fences and rows more than three deviations off, from one scan."""
    summary = numeric_summary(tables) if summary is None else summary
    # one row per column
    known = [r for r in summary.where("NOT sparse").select("name", "mean", "std", "q25", "q75").collect()]
    aggs, rows = [], []
    for i, r in enumerate(known):
        value = C.value_or_null(r.name, tables.types[r.name]).cast("double")
        reach = 1.5 * (r.q75 - r.q25)
        outside = (value < r.q25 - reach) | (value > r.q75 + reach)
        far = F.abs(value - r.mean) / F.lit(r.std) > 3 if r.std and r.std > 0 else F.lit(False)
        aggs += [F.count_if(outside).alias(f"iqr_{i}"), F.count_if(far).alias(f"far_{i}")]
        rows.append(F.struct(F.lit(r.name).alias("name"), F.col(f"iqr_{i}").alias("iqr_count"), F.col(f"far_{i}").alias("z_score_count")))
    if not known:
        return tables.df.sparkSession.createDataFrame([], "name string, iqr_count long, z_score_count long")
    return tables.df.agg(*aggs).select(F.inline(F.array(*rows)))


def _level_texts(tables: ProfileTables, names: list[str]) -> DataFrame:
    """Rows per value of the categorical columns ``names``; those of numbers are known already."""
    texts = [n for n in names if tables.base(n) == "string"]
    known = [(n, value, rows) for n in names if n in tables.ends for value, rows in tables.ends[n]]
    counted = tables.df.sparkSession.createDataFrame(known, "name string, value string, n long")
    if not texts:
        return counted
    return counted.unionByName(tables.text_counts.where(F.col("feature").isin(texts)).withColumnRenamed("feature", "name"))


def top_values(tables: ProfileTables, types: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent values of every categorical column, ties by value."""
    # a few rows of columns, but many scans of the table stand behind them
    wanted = durable(types.where("type = 'categorical'").select("name", F.col("levels").alias("cardinality")))
    order = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    names = [r.name for r in wanted.select("name").collect()]  # of columns
    return (
        _level_texts(tables, names)
        .join(F.broadcast(wanted), "name")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def date_ranges(types: DataFrame) -> DataFrame:
    """First and last date per date column; midnight-only columns show no time."""
    typed = F.col("base") == "datetime"
    only = F.when(typed, F.col("date_only")).otherwise(F.col("text_midnight"))

    def shown(stamp: Column) -> Column:
        return F.when(only, F.date_format(stamp, "yyyy-MM-dd")).otherwise(
            F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")
        )

    return types.where("type = 'datetime'").select(
        "name",
        shown(F.when(typed, F.col("date_min")).otherwise(F.col("text_min"))).alias("range_min"),
        shown(F.when(typed, F.col("date_max")).otherwise(F.col("text_max"))).alias("range_max"),
        F.when(typed, 0).otherwise(F.col("unparsed_count")).cast("long").alias("unparsed_count"),
    )


def text_summary(types: DataFrame) -> DataFrame:
    return types.where("type = 'text'").select(
        "name",
        "avg_length",
        F.col("levels").alias("cardinality"),
        (F.col("number_share") >= NUMBER_SHARE).alias("looks_numeric"),
        (F.col("levels") == F.col("present")).alias("looks_like_id"),
    )


def profile(tables: ProfileTables) -> DataFrame:
    """One row per column: its type and the summary that type calls for."""
    tables.basics  # noqa: B018 - both sides below read it
    with ThreadPoolExecutor(1) as beside:  # quartiles are selected while the types are found
        numbers = beside.submit(lambda: durable(numeric_summary(tables))) if tables.numbers else None
        types = durable(column_types(tables))
        summary = numbers.result() if numbers else None
    result = types
    numeric = F.col("type") == "numeric"
    if tables.numbers:
        result = result.join(summary.select("name", "q25", "q50", "q75", "sparse"), "name", "left")
        result = result.join(outliers(tables, summary), "name", "left")
    else:
        for c, kind in (("q25", "double"), ("q50", "double"), ("q75", "double"), ("sparse", "boolean"),
                        ("iqr_count", "long"), ("z_score_count", "long")):
            result = result.withColumn(c, F.lit(None).cast(kind))
    tops = (
        top_values(tables, types)
        .groupBy("name")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
        .select(
            "name",
            F.transform("t", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))).alias(
                "top_values"
            ),
        )
    )
    result = result.join(tops, "name", "left")
    result = result.join(date_ranges(types).drop("unparsed_count"), "name", "left")
    text = F.col("type") == "text"

    def only(condition: Column, *names: str) -> list[Column]:
        return [F.when(condition, F.col(n)).alias(n) for n in names]

    return result.select(
        "ordinal", "name", "type", "dtype", "rows", "present", "missing_count", "missing_pct",
        *only(numeric, "mean", "std", "min", "max", "q25", "q50", "q75", "zero_ratio", "sparse",
              "iqr_count", "z_score_count"),
        F.when(F.col("type").isin("categorical", "text"), F.col("levels")).alias("cardinality"),
        "top_values",
        "range_min",
        "range_max",
        F.when(F.col("type") == "datetime", F.coalesce("unparsed_count", F.lit(0))).alias("unparsed_count"),
        *only(F.col("type") == "boolean", "true_count", "false_count"),
        *only(text, "avg_length"),
        F.when(text, F.col("number_share") >= NUMBER_SHARE).alias("looks_numeric"),
        F.when(text, F.col("levels") == F.col("present")).alias("looks_like_id"),
    )


def target_by_name(names: list[str]) -> tuple[str, str] | None:
    """(column, confidence) of the first name in the target lists, if any."""
    lowered = {n.lower(): n for n in names}
    for confidence, hints in (("high", TARGET_NAMES_HIGH), ("medium", TARGET_NAMES_MEDIUM)):
        for hint in hints:
            if hint in lowered:
                return lowered[hint], confidence
    return None


def detect_target(df: DataFrame) -> DataFrame:
    """One row (column, confidence): by name, else a last column of few levels."""
    spark = df.sparkSession
    named = target_by_name(df.columns)
    if named is not None:
        return spark.createDataFrame([named], "column string, confidence string")
    last = df.columns[-1]
    # Few levels show in the map-side aggregate, so the distinct set stays small there.
    found = df.select(C.col(last).alias("v")).where("v IS NOT NULL").distinct()
    few = F.count(F.lit(1)) <= FEW_LEVELS
    return found.agg(
        F.when(few, F.lit(last)).alias("column"), F.when(few, "low").otherwise("none").alias("confidence")
    )


def class_shares(df: DataFrame, target: str) -> DataFrame:
    """Share of every class among the non-null targets."""
    value = C.value_or_null(target, {f.name: f.dataType for f in df.schema.fields}[target])
    counts = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(F.col("v").cast("string").alias("class"), "n", (F.col("n") / total).alias("share"))


def infer_task(df: DataFrame, target: str) -> DataFrame:
    """One row: the learning task the target's values point to."""
    shares = class_shares(df, target)
    numeric = C.is_numeric({f.name: f.dataType for f in df.schema.fields}[target])
    levels = F.count(F.lit(1))
    kind = (
        F.when(F.lit(numeric) & (levels > FEW_LEVELS), "regression")
        .when(levels == 2, "binary_classification")
        .when((levels > 2) & (levels <= 20), "multiclass_classification")
        .otherwise("unknown")
    )
    return shares.agg(kind.alias("task"), levels.alias("levels"), F.min("share").alias("minority_share"))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Extra copies of identical rows; two NULLs are the same value."""
    names = columns or df.columns
    groups = df.groupBy(*[C.col(n) for n in names]).agg(F.count(F.lit(1)).alias("_copies"))
    row = groups.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"),
    )
    share = C.ratio(F.col("duplicates"), F.col("rows"))
    return row.select(
        "rows",
        "duplicates",
        share.alias("share"),
        ((F.col("duplicates") > 0) & (share >= DUPLICATE_SHARE)).alias("flagged"),
    )


def censored_target(df: DataFrame, target: str) -> DataFrame:
    """Rows of a continuous target sitting exactly at its minimum or maximum."""
    counts = value_counts(C.long_form(df, [target], "double"))
    ends = counts.groupBy("feature").agg(
        F.count(F.lit(1)).alias("levels"),
        F.sum("n").alias("rows"),
        F.min(F.struct("value", "n")).alias("low"),
        F.max(F.struct("value", "n")).alias("high"),
    )
    sides = F.array(
        F.struct(F.lit("minimum").alias("bound"), F.col("low.value").alias("value"), F.col("low.n").alias("n")),
        F.struct(F.lit("maximum").alias("bound"), F.col("high.value").alias("value"), F.col("high.n").alias("n")),
    )
    share = F.col("s.n") / F.col("rows")
    return ends.select("levels", "rows", F.explode(sides).alias("s")).select(
        "s.bound",
        "s.value",
        F.col("s.n").alias("rows_at_bound"),
        share.alias("share"),
        ((F.col("levels") >= CENSORED_LEVELS) & (share >= CENSORED_SHARE)).alias("flagged"),
    )


def column_warnings(profiled: DataFrame) -> DataFrame:
    """One row per warning rule that fires: (rule, n, all names in column order)."""
    missing_pct = F.col("missing_pct")
    rules = {
        "mostly_missing": missing_pct > 0.5,
        "partly_missing": (missing_pct > 0.1) & (missing_pct <= 0.5),
        "high_cardinality": (F.col("type") == "categorical") & (F.col("cardinality") > 50),
        "dirty_numeric": F.col("looks_numeric"),
        "id_like": F.col("looks_like_id"),
        "sparse_numeric": F.col("sparse"),
    }
    fired = F.filter(
        F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]), lambda r: r.isNotNull()
    )
    hits = profiled.select("ordinal", "name", F.explode(fired).alias("rule"))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "name")))
    # One element per column of the profiled table.
    return hits.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"), listed["name"].alias("names")
    )


def table_warnings(df: DataFrame, target: str | None) -> DataFrame:
    """Row-level and target-level warnings in the shape of ``column_warnings``."""
    duplicates = duplicate_rows(df).where("flagged").select(
        F.lit("duplicate_rows").alias("rule"), F.col("duplicates").alias("n"), F.array().cast("array<string>").alias("names")
    )
    if target is None:
        spark = df.sparkSession
        none = spark.createDataFrame([("no_target", 1, [])], "rule string, n long, names array<string>")
        return duplicates.unionByName(none)
    task = infer_task(df, target)
    rare = task.where("task = 'binary_classification' AND minority_share < 0.2").select(
        F.lit("class_imbalance").alias("rule"), F.lit(1).cast("long").alias("n"), F.array(F.lit(target)).alias("names")
    )
    result = duplicates.unionByName(rare)
    types = {f.name: f.dataType for f in df.schema.fields}
    if C.is_numeric(types[target]):
        censored = censored_target(df, target).where("flagged").select(
            F.concat(F.lit("censored_"), "bound").alias("rule"),
            F.col("rows_at_bound").alias("n"),
            F.array(F.lit(target)).alias("names"),
        )
        result = result.unionByName(censored)
    return result


def narrowed(profiled: DataFrame, max_columns: int | None = None) -> DataFrame:
    """The statistics a written claim may cite, one row per column."""
    kept = profiled if max_columns is None else profiled.where(F.col("ordinal") < max_columns)
    return kept.select(
        "ordinal", "name", "type", "missing_count", "missing_pct", "cardinality", "zero_ratio",
        "mean", "std", "min", "max", "q25", "q50", "q75", "iqr_count", "z_score_count",
    )
