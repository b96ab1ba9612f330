import math

import pytest
from pyspark.sql import functions as F

from tablegauge.functions import metric_names as M
from tablegauge.operators import metric_stream as S
from tablegauge.sources import logs
from tablegauge.streaming import watch, windowed_drift


def _parse(spark, lines):
    rows = [(1, i, line) for i, line in enumerate(lines)]
    return logs.parse_log_lines(spark.createDataFrame(rows, "run_id long, line_no long, line string"))


@pytest.mark.parametrize(
    "line, epoch, step, metrics",
    [
        ("Epoch 5/100 train_loss=0.4", 5, None, {"train_loss": 0.4}),
        ("epoch: 3, step=7, val/loss: 1e-3", 3, 7, {"val/loss": 0.001}),
        ("loss: 0.4 - val_loss: 0.5", None, None, {"loss": 0.4, "val_loss": 0.5}),
        ("train_loss=1,000.0", None, None, {"train_loss": 1000.0}),
        ("train_loss=0.42, val_loss=0.55", None, None, {"train_loss": 0.42, "val_loss": 0.55}),
        ("loss = -Infinity", None, None, {"loss": -math.inf}),
        ("loss=.5 loss=.7", None, None, {"loss": 0.7}),
        ("Epoch 9", 9, None, {}),
    ],
)
def test_log_lines(spark, line, epoch, step, metrics):
    row = _parse(spark, [line]).first()
    assert (row.epoch, row.step, row.metrics) == (epoch, step, metrics)


def test_lines_without_signal_drop(spark):
    assert _parse(spark, ["", "saving to /tmp/model.pt", "iter 4000", "status: infeasible"]).count() == 0
    assert math.isnan(_parse(spark, ["LOSS: NAN"]).first().metrics["LOSS"])


def test_metric_name_variants(spark):
    names = ["Loss/train", "train_loss", "Train Loss", "train-loss", "loss.train"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {tuple(r[0]) for r in df.select(M.words(F.col("n"))).collect()} == {("loss", "train")}


def _snapshots(spark, rows):
    data = [(1, i, e, m) for i, (e, m) in enumerate(rows)]
    return spark.createDataFrame(data, "run_id long, seq long, epoch long, metrics map<string,double>").withColumn("step", F.lit(None).cast("long"))


def _rules(spark, rows):
    return {r.rule_id: r for r in S.all_findings(_snapshots(spark, rows)).collect()}


def test_detectors(spark):
    nan = float("nan")
    assert _rules(spark, [(1, {"loss": 1.0}), (2, {"loss": nan}), (3, {"loss": nan}), (None, {"time": 3.0})])["nan"].epoch == 2
    assert "nan" not in _rules(spark, [(1, {"loss": nan}), (2, {"loss": 1.0})])
    jump = _rules(spark, [(e, {"train_loss": v}) for e, v in enumerate([-2.0, -2.1, -500.0, -501.0])])
    assert jump["divergence"].epoch == 2
    assert "divergence" not in _rules(spark, [(1, {"loss": 1e-9}), (2, {"loss": 1e-7}), (3, {"loss": 0.0})])
    assert "plateau" in _rules(spark, [(e, {"val_loss": 0.5}) for e in range(5)])
    over = _rules(spark, [(e, {"train_loss": 1 - 0.1 * e, "val_loss": 1 + 0.1 * e}) for e in range(5)])
    assert over["overfitting"].measure == pytest.approx(0.8)


def test_merge_keeps_order_over_block_borders(spark):
    lines = [f"Epoch {i // 4} train_loss={i}.0" if i % 2 else f"Epoch {i // 4} val_loss={i}.5" for i in range(40)]
    parsed = _parse(spark, lines)
    small, large = S.merge_epochs(parsed, size=3), S.merge_epochs(parsed)
    key = lambda df: sorted((r.seq, r.epoch, tuple(sorted(r.metrics.items())), r.lines) for r in df.collect())
    assert key(small) == key(large) and len(key(small)) == 10
    assert key(small)[0] == (0, 0, (("train_loss", 3.0), ("val_loss", 2.5)), 4)


def test_history_keeps_numbers_only(spark):
    lines = ['{"_step": 3, "_runtime": 1.0, "loss": NaN, "ok": true, "note": "1.5", "acc": 1}', "{bad", '["x"]', '{"_runtime": 2}']
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "run_id long, line_no long, line string")
    rows = logs.parse_history(df).collect()
    assert len(rows) == 1 and rows[0].step == 3 and set(rows[0].metrics) == {"loss", "acc"} and math.isnan(rows[0].metrics["loss"])


def test_scalars_pivot(spark):
    rows = [(1, 0, 5, "loss", 1.0), (1, 1, 5, "loss", 0.5), (1, 2, 5, "epoch", 2.0), (1, 3, None, "acc", 0.1), (1, 4, 6, "acc", None)]
    got = {r.step: r for r in logs.pivot_scalars(spark.createDataFrame(rows, "run_id long, ord long, step long, tag string, value double")).collect()}
    assert got[5].metrics == {"loss": 0.5} and got[5].epoch == 2 and got[6].metrics == {} and got[None].metrics == {"acc": 0.1}


@pytest.mark.parametrize("runs", [(1, 2), ("logs/a.txt", "logs/b.txt")])
def test_follow_equals_batch_at_the_end_and_reports_once(spark, tmp_path, runs):
    lines = [f"Epoch {i // 2} train_loss={1 - i * 0.01}" if i % 2 else f"Epoch {i // 2} val_loss={1 + i * 0.01}" for i in range(12)]
    lines += ["Epoch 6 train_loss=400.0", "Epoch 7 train_loss=nan", "Epoch 8 train_loss=nan"]
    schema = f"run_id {'long' if runs == (1, 2) else 'string'}, line_no long, line string"
    for part, cut in enumerate(([0, 5], [5, 9], [9, 15])):
        rows = [(r, i, lines[i]) for r in runs for i in range(*cut)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, watch.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = (
            watch.follow(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    found = spark.read.parquet(str(tmp_path / "out"))
    columns = ["run_id", "rule_id", "epoch", "message"]
    streamed = [tuple(r) for r in found.select(*columns).collect()]
    assert len(streamed) == len(set(streamed)) and found.where("message IS NULL").isEmpty()
    whole = spark.createDataFrame([(r, i, x) for r in runs for i, x in enumerate(lines)], schema)
    batch = S.all_findings(S.merge_epochs(logs.parse_log_lines(whole))).select(*columns)
    assert {tuple(r) for r in batch.collect()} <= set(streamed)


def test_follow_state_stays_small_and_a_flat_loss_is_told_once_an_epoch():
    state = {**watch._EMPTY, "open": None, "train": [], "val": [], "recent": [], "seen": []}
    told = []
    for i in range(watch.REMEMBERED * 3):
        watch._close(state, {"epoch": i // 3, "train": 0.5 + 1e-9 * i, "val": None, "has_loss": True, "bad": []})
        fresh = [f for f in watch._findings(state) if [f[0], f[2], f[4]] not in state["seen"]]
        state["seen"] = (state["seen"] + [[f[0], f[2], f[4]] for f in fresh])[-watch.REMEMBERED:]
        told += fresh
    assert len(told) == len({(f[0], f[2]) for f in told}) == watch.REMEMBERED - 1
    assert len(state["seen"]) <= watch.REMEMBERED and len(state["recent"]) == 5


def test_windowed_drift_stream_equals_batch(spark, tmp_path):
    rows = spark.range(4000).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 120).alias("ts"),
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0 + F.when(F.col("id") > 3000, 40.0).otherwise(0.0)).alias("v"),
    )
    reference = windowed_drift.reference_bins(rows.where("v < 100").limit(1500).drop("ts"), ["v"])
    batch = windowed_drift.window_drift(windowed_drift.window_bins(rows, reference, "ts", "1 day"), reference)
    rows.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_drift.stream_window_drift(
        stream, reference, "ts", "1 day", "1 minute", lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"), once=True
    )
    query.awaitTermination()
    want = {(r.window_start, r.feature): round(r.psi, 9) for r in batch.collect()}
    closed = {(r.window_start, r.feature): round(r.psi, 9) for r in got}
    assert closed and all(want[k] == v for k, v in closed.items())
    assert len(closed) >= len(want) - 1


def test_windowed_drift_of_text_and_few_integers(spark):
    rows = [(f"2024-01-{d:02d} 00:00:00", "ab"[(d + i) % 2] if d < 8 else "abz"[i % 3], i % 4) for d in range(1, 10) for i in range(60)]
    events = spark.createDataFrame(rows, "ts string, name string, kind long").withColumn("ts", F.col("ts").cast("timestamp"))
    reference = windowed_drift.reference_bins(events.where("ts < '2024-01-08'"), ["name", "kind"])
    binned = windowed_drift.window_bins(events, reference, "ts", "1 day")
    got = {(str(r.window_start)[:10], r.feature): r for r in windowed_drift.window_drift(binned, reference).collect()}
    assert len(got) == 18 and all(r.cur_rows == 60 for r in got.values())
    assert got["2024-01-02", "name"].psi < 0.01 < 0.3 < got["2024-01-09", "name"].psi and got["2024-01-09", "kind"].psi < 0.01


def test_any_number_of_levels_and_late_rows(spark):
    rows = [(f"2024-01-{1 + i % 4:02d} 00:00:00", f"level {i % 700}") for i in range(2800)] + [("2024-01-05 00:00:00", f"new {i}") for i in range(50)]
    events = spark.createDataFrame(rows, "ts string, name string").withColumn("ts", F.col("ts").cast("timestamp"))
    reference = windowed_drift.reference_bins(events.where("ts < '2024-01-05'"), ["name"])
    assert reference.cells.count() == 700
    found = windowed_drift.window_drift(windowed_drift.window_bins(events, reference, "ts", "1 day"), reference).collect()
    assert {str(r.window_start)[:10]: r.severity for r in found}["2024-01-05"] == "major"


@pytest.mark.parametrize("size", [None, 400])
def test_lines_are_numbered_over_the_splits_of_a_file(spark, tmp_path, size):
    written = {"a.log": [f"line {i} " + "x" * (i % 37) for i in range(500)], "b.log": ["only one"], "c.log": ["", "second", "", "fourth"]}
    for name, texts in written.items():
        end = "\r\n" if name == "c.log" else "\n"
        (tmp_path / name).write_bytes((end.join(texts) + end).encode())
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if size:
        spark.conf.set(key, size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        read = logs.read_lines(spark, str(tmp_path)).collect()
        parts = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in read:
        got.setdefault(r.run_id.rsplit("/", 1)[1], {})[r.line_no] = r.line
    assert {n: [lines[i] for i in sorted(lines)] for n, lines in got.items()} == written
    assert all(sorted(lines) == list(range(len(lines))) for lines in got.values())
    assert size is None or parts > 10


@pytest.mark.parametrize("size", [None, 300])
def test_runs_that_share_a_file_are_numbered_apart(spark, tmp_path, size):
    written = {f"run {i}": [f"line {k}\twith a tab" if k % 3 else "" for k in range(1 + 7 * i)] for i in range(12)}
    for part in range(2):
        texts = [f"{run}{logs.RUN_END}{line}\n" for i, (run, all_lines) in enumerate(written.items()) if i % 2 == part for line in all_lines]
        (tmp_path / f"{part}.log").write_text("".join(texts))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if size:
        spark.conf.set(key, size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        read = logs.lines_of_runs(logs.read_lines(spark, str(tmp_path))).collect()
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in read:
        got.setdefault(r.run_id, {})[r.line_no] = r.line
    assert {run: [lines[i] for i in range(len(lines))] for run, lines in got.items()} == written


def test_followed_batches_are_dealt_over_the_cores(spark):
    from tablegauge.plans import stream_queries

    named = stream_queries.LINES.replace("{{events}}", "{events}")
    batches = list(stream_queries._batches(spark, "/root/testdata/sf0.001", named, 4))
    assert [b.rdd.getNumPartitions() for b in batches] == [spark.sparkContext.defaultParallelism] * 4
    assert sum(b.count() for b in batches) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
