import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablegauge.operators import order_stats as O
from tablegauge.operators.blocks import positions, previous
from tablegauge.operators.skew import hot_key_join, salted_join


def _frame(spark, n=500):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.integers(0, 60, n)] + [("b", float(v)) for v in rng.normal(size=n)]
    rows += [("a", 7.0)] * n  # one hot value
    return spark.createDataFrame(rows, "feature string, value double")


def test_running_totals_equal_a_plain_window(spark):
    counts = O.value_counts(_frame(spark))
    by = Window.partitionBy("feature")
    smaller = by.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    plain = counts.select(
        "feature", "value", "n", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("before_n"), F.sum("n").over(by).alias("total_n")
    )
    got = O.running_totals(counts, ["feature"], "value", ["n"]).select(*plain.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_quantiles_match_numpy(spark):
    df = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    totals = O.running_totals(O.value_counts(df), ["feature"], "value", ["n"], reused=True)
    got = {r.feature: r.q for r in O.quantiles(totals, probs).collect()}
    pdf = df.toPandas()
    for feature, part in pdf.groupby("feature"):
        np.testing.assert_allclose(got[feature], np.quantile(part.value, probs), rtol=1e-12)


def test_ordinal_codes_follow_sorted_order(spark):
    df = spark.createDataFrame([("c", v) for v in "zebra"], "feature string, value string")
    codes = {r.value: r.code for r in O.ordinal_codes(df).collect()}
    assert codes == {"a": 0.0, "b": 1.0, "e": 2.0, "r": 3.0, "z": 4.0}


def test_blocks_carry_values_over_borders(spark):
    rows = [(1, i, None if i % 3 else float(i)) for i in range(40)] + [(2, 5, 1.0), (2, 90, 2.0)]
    df = spark.createDataFrame(rows, "run long, seq long, v double")
    small = previous(df, ["run"], "seq", {"p": F.col("v")}, size=4).orderBy("run", "seq").collect()
    large = previous(df, ["run"], "seq", {"p": F.col("v")}).orderBy("run", "seq").collect()
    assert small == large
    placed = positions(df, ["run"], "seq", size=4).orderBy("run", "seq").collect()
    assert [r.position for r in placed if r.run == 1] == list(range(40))
    assert [r.position for r in placed if r.run == 2] == [0, 1]


def test_skew_joins_keep_every_row(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(2000)).withColumn("x", F.col("k") * 2)
    hot = hot_key_join(rows, lookup, ["k"], ["id"], "n", "t")
    assert hot.count() == 2000 and hot.where("x <> k * 2").count() == 0
    salted = salted_join(rows, lookup.where("k < 100"), ["k"], ["id"])
    assert salted.count() == 2000 and salted.where("k >= 100 AND x IS NOT NULL").count() == 0
