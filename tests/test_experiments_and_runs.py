import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import compare

from tablegauge.operators import experiments as X
from tablegauge.operators import runs as R


def test_newcombe_and_holm_pins(spark):
    pairs = spark.createDataFrame([("g", "b", 0, 200, 0, 200)], "series string, arm string, k1 long, n1 long, k2 long, n2 long")
    row = X.with_difference(pairs).first()
    assert row.low == pytest.approx(-0.0188, abs=1e-4) and row.high == pytest.approx(0.0188, abs=1e-4)
    assert X.with_difference(pairs).select(X.contrast_verdict(F.col("difference"), F.col("low"), F.col("high"))).first()[0] == "equivalent"
    tests = spark.createDataFrame([("f", "x", 0.01), ("f", "y", 0.04), ("f", "z", 0.03)], "family string, name string, p double")
    holm = {r.name: r.p_holm for r in X.with_holm(tests, ["family"], ["name"]).collect()}
    assert holm == pytest.approx({"x": 0.03, "z": 0.06, "y": 0.06})


def test_absent_arm_is_not_run(spark):
    cells = spark.createDataFrame([("g", "own", 1, 100), ("g", "base", 30, 100)], "series string, arm string, k long, n long")
    rows = {r.contrast: r for r in X.contrast_table(cells, ["series"], "own", [("A", "base", True), ("B", "gone", True)]).collect()}
    assert rows["A"].verdict == "contract lower" and rows["A"].p_holm == pytest.approx(rows["A"].p)
    assert rows["B"].verdict == "not run" and rows["B"].p is None


def test_kappa_constant_raters(spark):
    df = spark.createDataFrame([("g", 1, 1)] * 5, "g string, a int, b int")
    assert X.kappa(df, ["g"]).first().kappa is None
    assert X.kappa(df, ["g"], constant=1.0).first().kappa == 1.0


def test_direction_of_metric_names(spark):
    names = ["val_brier_score", "cancer_accuracy", "test wer", "latency", "ROC_AUC"]
    df = spark.createDataFrame([(n, 1.0, 2.0) for n in names], "m string, a double, b double")
    got = {r.m: r.side for r in df.select("m", R.better_side(F.col("m"), F.col("a"), F.col("b")).alias("side")).collect()}
    assert got == {"val_brier_score": "a", "cancer_accuracy": "b", "test wer": "a", "latency": None, "ROC_AUC": "b"}


@pytest.mark.parametrize("direction, rises", [("max", True), ("min", False)])
def test_exploit_steps_towards_better_scores(spark, direction, rises):
    scored = spark.createDataFrame([(i, float(i)) for i in range(6)], "run_id long, score double")
    config = spark.createDataFrame(
        [(i, k, v) for i in range(6) for k, v in (("lr", str(0.01 * (i + 1))), ("amp", "true"), ("batch_size", str(16 * (i + 1))))],
        "run_id long, key string, value string",
    )
    ranked = R.sensitivity(scored, config, direction)
    by = {r.key: r for r in ranked.collect()}
    assert by["amp"].kind == "categorical_or_constant" and abs(by["lr"].correlation) == pytest.approx(1.0)
    leader = config.where(F.col("run_id") == R.leaderboard(scored, 1, direction).first().run_id)
    first, second = R.suggestions(ranked, leader, 2).orderBy("suggestion").collect()
    assert (first.value > first.leader_num) == rises and (second.value > second.leader_num) != rises
    assert first.value == int(first.value)  # the leader's batch size is whole


def test_bounds_win(spark):
    ranked = spark.createDataFrame([("dropout", "numeric", 5, 0.9, 0.1, 0.7)], "key string, kind string, observations int, correlation double, min double, max double")
    leader = spark.createDataFrame([("dropout", "0.7")], "key string, value string")
    assert R.suggestions(ranked, leader, 1).first().value == pytest.approx(0.8)
    limits = spark.createDataFrame([("dropout", -1.0, 0.72)], "key string, low double, high double")
    assert R.suggestions(ranked, leader, 1, limits).first().value == pytest.approx(0.72)


def test_report_findings_fold_and_deduplicate(spark):
    text = "- early\n⚠ Warnings\n• one\n   more\n• Two\n• two\n🔧 Feature engineering\n- encode"
    df = spark.createDataFrame([(1, "d", text)], "report_id long, dataset string, text string")
    got = [(r.section, r.finding) for r in X.report_findings(df).orderBy("no").collect()]
    assert got == [("", "early"), ("warnings", "one more"), ("warnings", "Two"), ("features", "encode")]


def test_shift_setting_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    from tablegauge.plans import run_queries

    rows = spark.range(0, 40_000, 1, 1).select(
        F.col("id").alias("event_id"), (F.col("id") % 4000).alias("user_id"), (F.pmod(F.hash("id"), F.lit(50_000)) / 100).alias("value")
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")  # sums that end in half a cent
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet') ORDER BY event_id")
    name = "run_02_config_diff"
    equal, message, _ = compare(spark, con, str(tmp_path), run_queries.QUERIES[name], run_queries.ORACLES[name])
    assert equal, message
