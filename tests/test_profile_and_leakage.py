import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import drift as D
from tablegauge.operators import leakage as L
from tablegauge.operators import profile as P


def _profile(spark, rows, schema, **options):
    tables = P.ProfileTables(spark.createDataFrame(rows, schema), **options)
    return {r.name: r for r in P.profile(tables).collect()}


def test_column_types_and_summaries(spark):
    rows = [
        (float(i), i % 2, 2006 + i % 2, f"c{i % 3}", f"id-{i}", "" if i == 0 else f"{i}.5", f"2024-02-{i % 28 + 1:02d}", i % 4 == 0,
         0.0 if i % 3 else float(i), None if i % 5 else 1.0)
        for i in range(60)
    ]
    schema = "age double, flag int, yr_sold int, country string, customer string, charges string, day string, ok boolean, porch double, rare double"
    p = _profile(spark, rows, schema)
    types = {n: r.type for n, r in p.items()}
    assert types == {
        "age": "numeric", "flag": "categorical", "yr_sold": "numeric", "country": "categorical", "customer": "text",
        "charges": "text", "day": "datetime", "ok": "boolean", "porch": "numeric", "rare": "numeric",
    }
    assert p["age"].q25 == pytest.approx(14.75) and p["age"].std == pytest.approx(np.std(range(60), ddof=1))
    assert p["porch"].sparse and p["porch"].iqr_count is None
    assert p["charges"].looks_numeric and p["customer"].looks_like_id
    assert p["day"].range_min == "2024-02-01" and p["ok"].true_count == 15
    assert p["rare"].missing_pct == pytest.approx(0.8) and p["rare"].type == "numeric"
    assert p["country"].cardinality == 3 and [t.value for t in p["country"].top_values] == ["c0", "c1", "c2"]


def test_approximate_profile_keeps_shape(spark):
    rows = [(float(i), f"v{i % 4}") for i in range(200)]
    p = _profile(spark, rows, "x double, s string", approximate=True)
    assert p["x"].type == "numeric" and abs(p["x"].q50 - 99.5) < 2 and p["x"].iqr_count == 0


def test_target_task_and_row_warnings(spark):
    df = spark.createDataFrame([(i, float(i % 7), int(i < 5)) for i in range(100)], "feature int, x double, churn int")
    assert tuple(P.detect_target(df).first()) == ("churn", "high")
    task = P.infer_task(df, "churn").first()
    assert task.task == "binary_classification" and task.minority_share == pytest.approx(0.05)
    assert "class_imbalance" in {r.rule for r in P.table_warnings(df, "churn").collect()}
    copies = df.drop("feature").withColumn("y", df.churn)
    assert P.duplicate_rows(copies).first().flagged
    capped = spark.createDataFrame([(min(float(i), 90.0),) for i in range(100)], "price double")
    flags = {r.bound: r.flagged for r in P.censored_target(capped, "price").collect()}
    assert flags == {"minimum": True, "maximum": True}


def test_monotone_leak_and_perfect_separator(spark):
    rng = np.random.default_rng(5)
    y = rng.lognormal(3, 1, 200)
    rows = [(float(v), float(np.log(v)), float(v), float(n), "hi" if v > 20 else "lo") for v, n in zip(y, rng.normal(size=200))]
    tables = L.LeakageTables(spark.createDataFrame(rows, "y double, logged double, copied double, noise double, band string"), "y")
    found = {r.feature: r for r in L.strongest(tables).collect()}
    assert found["logged"].method == "spearman" and found["logged"].correlation == pytest.approx(1.0)
    assert found["copied"].method == "pearson" and abs(found["noise"].correlation) < 0.3
    assert {r.feature for r in L.candidate_leaks(L.strongest(tables)).collect()} == {"logged", "copied"}
    label = [(int(v > 20), float(v**3) if v > 20 else -1.0, "no" if v > 20 else "yes") for v in y]
    for target in ("label", "word"):
        binary = L.LeakageTables(spark.createDataFrame(label, "label int, code double, word string").select(target, "code"), target)
        best = L.strongest(binary).first()
        assert best.method == "rank_biserial" and abs(best.correlation) == pytest.approx(1.0)


def test_match_rate_counts_missing_as_mismatch_for_labels_only(spark):
    df = spark.createDataFrame([("a", "a"), ("b", None), ("a", "b"), ("b", "b")], "t string, p string")
    assert L.match_rate(df, "t", "p", "binary_classification").first().match_rate == 0.5
    nums = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "t double, p double")
    assert L.match_rate(nums, "t", "p", "regression").first().match_rate == 1.0


def test_large_integers_and_decimals_stay_apart(spark):
    big = 1 << 60
    rows = [(big + i % 2, big + i, f"{i % 3}.10") for i in range(1000)]
    df = spark.createDataFrame(rows, "two long, many long, d string").withColumn("d", F.col("d").cast("decimal(20,2)"))
    tables = P.ProfileTables(df)
    assert {r.name: r.levels for r in P.number_levels(tables).collect()} == {"two": 2, "many": 1000, "d": 3}
    types = P.column_types(tables)
    assert {r.value for r in P.top_values(tables, types).where("name = 'two'").collect()} == {str(big), str(big + 1)}
    levels = D.level_counts(D.drift_tables(df.select("two"), df.select("two")))
    assert {(r.level, r.ref, r.cur) for r in levels.collect()} == {(str(big), 500, 500), (str(big + 1), 500, 500)}


def test_all_names_and_candidates_are_returned(spark):
    wide = spark.range(200).select(*[F.when(F.col("id") % 4 == 0, F.col("id")).alias(f"c{k:02d}") for k in range(12)])
    warned = {r.rule: r.names for r in P.column_warnings(P.profile(P.ProfileTables(wide))).collect()}
    assert len(warned["mostly_missing"]) == 12
    leaks = spark.range(200).select(F.col("id").alias("y"), *[(F.col("id") * (k + 1)).alias(f"x{k:02d}") for k in range(13)])
    evidence = L.strongest(L.LeakageTables(leaks, "y"), None)
    assert L.candidate_leaks(evidence).count() == 13


def test_types_are_found_once_for_top_values(spark):
    rows = [(f"id-{i}", f"c{i % 3}", f"2024-01-0{1 + i % 9}") for i in range(90)]
    tables = P.ProfileTables(spark.createDataFrame(rows, "name string, color string, day string"))
    tops = P.top_values(tables, P.column_types(tables))
    assert "RLIKE" not in tops._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.name, r.value, r.n) for r in tops.orderBy("rank").collect()] == [("color", f"c{k}", 30) for k in range(3)]


def test_different_texts_are_counted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(P, "HASHES_A_PART", 2_000)
    monkeypatch.setattr(P, "COUNTED_TEXTS", 100)
    hot = F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("h"), "id"))
    df = spark.range(30_000, numPartitions=2).select(
        F.concat(F.lit("t"), "id").alias("every"), hot.alias("hot"), F.lit(None).cast("string").alias("none"),
        F.date_add(F.lit("2024-01-01"), (F.col("id") % 200).cast("int")).cast("string").alias("day"), (F.col("id") % 7).cast("string").alias("digit"),
    )
    tables = P.ProfileTables(df)
    levels = P.text_levels(tables)
    # a hash aggregate over all pairs of a split grows with the split
    assert "Aggregate [at#" in (plan := levels._jdf.queryExecution().optimizedPlan().toString()) and ", h1#" not in plan.split("MapInArrow")[0]
    assert {r.name: r.levels for r in levels.collect()} == {"every": 30_000, "hot": 3_001, "day": 200, "digit": 7}
    facts = {r.name: (r.shaped_share, r.date_share, r.number_share, r.unparsed_count) for r in P.text_facts(tables).collect()}
    assert facts == {"every": (0, 0, 0, 30_000), "hot": (0, 0, 0, 30_000), "day": (1, 1, 0, 0), "digit": (0, 0, 1, 30_000)}
    types = {r.name: r.type for r in P.column_types(tables).collect()}
    assert types == {"every": "text", "hot": "text", "none": "categorical", "day": "datetime", "digit": "categorical"}
