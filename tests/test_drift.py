import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.functions.probability import _chi_square_tail, _fisher, kolmogorov_tail
from tablegauge.operators import drift as D


def _frame(spark, x, cat=None):
    cat = cat if cat is not None else ["a"] * len(x)
    return spark.createDataFrame([(float(v), str(c)) for v, c in zip(x, cat)], "x double, cat string")


def _by_feature(df):
    return {r.feature: r for r in df.collect()}


def test_identical_tables_have_no_drift(spark):
    rng = np.random.default_rng(0)
    df = _frame(spark, rng.normal(size=400), rng.choice(list("abc"), 400))
    rows = _by_feature(D.feature_drift(D.drift_tables(df, df)))
    assert rows["x"].psi == 0 and rows["cat"].psi == 0
    assert rows["x"].ks_stat == 0 and rows["cat"].chi2_stat == 0


def test_shift_is_major_and_small_samples_are_not(spark):
    rng = np.random.default_rng(1)
    ref = _frame(spark, rng.normal(size=500), rng.choice(list("abc"), 500))
    cur = _frame(spark, rng.normal(3, 1.5, 500), rng.choice(list("abc"), 500, p=[0.05, 0.05, 0.9]))
    per = D.feature_drift(D.drift_tables(ref, cur))
    assert {r.severity for r in per.collect()} == {"major"}
    assert D.drift_summary(per).first().status == "major_drift"
    a, b = _frame(spark, rng.normal(size=250)), _frame(spark, rng.normal(size=250))
    halves = _by_feature(D.feature_drift(D.drift_tables(a, b, ["x"])))
    assert halves["x"].severity != "major" and not halves["x"].small_sample
    few = _by_feature(D.feature_drift(D.drift_tables(a.limit(20), b.limit(20), ["x"])))
    assert few["x"].small_sample


def test_statistics_match_numpy(spark):
    rng = np.random.default_rng(2)
    r, c = rng.normal(size=300).round(1), rng.normal(0.4, 1.2, 250).round(1)
    tables = D.drift_tables(_frame(spark, r), _frame(spark, c), ["x"])
    edges = np.unique(np.quantile(r, np.linspace(0, 1, 11)))
    edges[0] -= 1e-9
    edges[-1] += 1e-9
    hist = D.histogram(tables).orderBy("bin").collect()
    assert [h.ref for h in hist] == np.histogram(r, edges)[0].tolist()
    assert [h.cur for h in hist] == np.histogram(c, edges)[0].tolist()
    values = np.concatenate([r, c])
    gap = [abs((r <= v).mean() - (c <= v).mean()) for v in values]
    assert D.ks_statistics(tables).first().ks_stat == pytest.approx(max(gap))


def test_constant_reference_and_missing_side(spark):
    same = _frame(spark, [5.0] * 100)
    assert _by_feature(D.feature_drift(D.drift_tables(same, same, ["x"])))["x"].psi == 0
    empty = same.withColumn("x", F.lit(float("nan")))
    tables = D.drift_tables(same, empty)
    assert [r.feature for r in D.skipped_features(tables).collect()] == ["x"]


def test_integer_and_date_kinds(spark):
    rows = [(i % 5, i, f"2024-01-{i % 28 + 1:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "few int, many int, day string")
    kinds = {r.feature: r.kind for r in D.feature_kinds(D.drift_tables(df, df)).collect()}
    assert kinds == {"few": "categorical", "many": "numeric", "day": "datetime"}


def test_tail_probabilities(spark):
    assert _chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert _chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert _chi_square_tail(2e6, 2_000_000) == pytest.approx(0.5, abs=1e-3)
    assert _fisher(3, 4, 1, 4) == pytest.approx(0.4857142857)
    assert _fisher(0, 200, 0, 200) == 1.0
    lams = spark.createDataFrame([(0.001,), (1.0,), (1.3581,)], "lam double")
    got = [r[0] for r in lams.select(kolmogorov_tail(F.col("lam"))).collect()]
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(0.2699996717, abs=1e-9)
    assert got[2] == pytest.approx(0.05, abs=1e-4)
    assert all(not math.isnan(p) for p in got)
