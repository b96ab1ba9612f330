"""One-pass operators against plain Python: merged epochs, exact quantiles, rank correlations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import leakage as L
from tablegauge.operators import metric_stream as S
from tablegauge.operators import profile as P
from tablegauge.operators import selection
from tablegauge.operators.order_stats import running_totals


@pytest.fixture
def tiny_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)
    yield
    spark.conf.set(name, before)


def merged(rows):
    found = []
    for run, seq, epoch, step, metrics in sorted(rows, key=lambda r: (r[0], r[1])):
        last = found[-1] if found else None
        if last and last["run_id"] == run and epoch is not None and last["epoch"] == epoch:
            last["metrics"] |= metrics or {}
            last["step"] = step if last["step"] is None else last["step"]
            last["last_seq"], last["lines"] = seq, last["lines"] + 1
            last["sources"].append(seq)
        else:
            found.append(dict(run_id=run, seq=seq, epoch=epoch, step=step, metrics=dict(metrics or {}), last_seq=seq, lines=1, sources=[seq]))
    return found


def test_merged_epochs_over_batches_and_partitions(spark, tiny_batches):
    draw = random.Random(4)
    rows = []
    for run in ("a", "b", "long"):
        epoch = 0
        for seq in range(150 if run == "long" else 40):
            epoch += draw.random() < 0.2 and run != "long"
            rows.append((
                run, seq * 2, None if draw.random() < 0.1 and run != "long" else epoch, draw.choice([None, seq]),
                draw.choice([{"loss": float(seq)}, {"acc": 0.5, "loss": float("inf")}, {}, {"z": -1.0, "a": float(seq)}]),
            ))
    schema = "run_id string, seq long, epoch long, step long, metrics map<string,double>"
    out = S.merge_epochs(spark.createDataFrame(rows, schema).repartition(5), sources=True).collect()
    got = sorted(({**r.asDict(), "sources": list(r.sources)} for r in out), key=lambda r: (r["run_id"], r["seq"]))
    assert got == merged(rows)
    assert [r["lines"] for r in got if r["run_id"] == "long"] == [150]
    empty = spark.createDataFrame([], schema)
    assert S.merge_epochs(empty).count() == 0 and "sources" not in S.merge_epochs(empty).columns


def test_divergence_tells_the_places_of_both_snapshots(spark):
    rows = [("r", 10 * i, i, None, {"train_loss": 100.0 if i == 7 else 1.0} if i != 5 else {"lr": 0.1}) for i in range(9)]
    snapshots = spark.createDataFrame(rows, "run_id string, seq long, epoch long, step long, metrics map<string,double>")
    found = S.divergence_findings(S.loss_rows(snapshots)).first()
    assert found.message == "train loss jumped 100.0 times between snapshots 6 and 7"


@pytest.mark.parametrize("enough", [50_000, 5])
def test_quantiles_equal_sorting(spark, enough):
    rng = np.random.default_rng(2)
    n = 3000
    columns = {
        "normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "hot": np.where(rng.random(n) < 0.6, 7.0, rng.random(n) * 9),
        "constant": np.full(n, 2.5), "wide": rng.lognormal(0, 8, n), "endless": np.where(rng.random(n) < 0.4, math.inf, rng.random(n)),
    }
    rows = [tuple(float(c[i]) if name != "normal" or i % 3 else None for name, c in columns.items()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).withColumn("none", F.lit(None).cast("int")).repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.feature: r.q for r in selection.quantiles_of(df, [*columns, "none"], probs, accuracy=100, enough=enough).collect()}
    assert set(got) == set(columns)
    for name, values in columns.items():
        kept = [v for i, v in enumerate(values) if name != "normal" or i % 3]
        if name == "endless":
            assert got[name][-1] == math.inf and got[name][2] == pytest.approx(np.sort(kept)[[int((n - 1) * 0.25), math.ceil((n - 1) * 0.25)]].mean(), abs=1e-3)
        else:
            assert got[name] == pytest.approx(np.quantile(kept, probs))


def test_a_bracket_that_misses_starts_anew(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    real, calls = selection._sketch, []

    def lying(value, shares, accuracy):
        calls.append(1)
        return F.array(*[F.lit(1.0), F.lit(2.0)] * len(shares)) if len(calls) == 1 else real(value, shares, accuracy)

    monkeypatch.setattr(selection, "_sketch", lying)
    assert selection.quantiles_of(df, ["x"], [0.25, 0.5]).first().q == pytest.approx([1249.75, 2499.5])


def test_running_totals_over_tiny_batches(spark, tiny_batches):
    rows = [(g, float(v), v % 3) for g in ("a", "b") for v in range(40)]
    totals = running_totals(spark.createDataFrame(rows, "g string, v double, n int"), ["g"], "v", ["n"])
    for g in ("a", "b"):
        before = 0
        for r in sorted(totals.where(F.col("g") == g).collect(), key=lambda r: r.v):
            assert (r.before_n, r.total_n) == (before, 39)
            before += r.n


def average_ranks(values):
    order = np.sort(values)
    return (np.searchsorted(order, values, "left") + np.searchsorted(order, values, "right") + 1) / 2


def test_correlations_with_missing_values_ties_and_hot_values(spark, tiny_batches):
    rng = np.random.default_rng(9)
    n = 400
    y = np.round(rng.normal(1e6, 3, n), 1)
    x = np.where(rng.random(n) < 0.4, 5.0, np.round(y * 2 + rng.normal(size=n), 1))
    text = np.array([f"t{int(v) % 7}" for v in x])
    rows = [
        (None if i % 11 == 0 else float(y[i]), None if i % 5 == 0 else float(x[i]), float(x[i]), None if i % 4 == 0 else str(text[i]), 1.0)
        for i in range(n)
    ] + [(None, 1.0, 1.0, "only beside a missing target", 1.0)]
    df = spark.createDataFrame(rows, "y double, holey double, full double, word string, same double").repartition(6)
    tables = L.LeakageTables(df, "y")
    ranks, plain = ({r.feature: r.correlation for r in f(tables).collect()} for f in (L.spearman, L.pearson))
    alone = {r.feature: r.correlation for r in L.pearson(L.LeakageTables(df, "y")).collect()}
    codes = {w: i for i, w in enumerate(sorted({r[3] for r in rows} - {None}))}
    for at, name in ((1, "holey"), (2, "full"), (3, "word")):
        pairs = np.array([(codes.get(r[at], r[at]), r[0]) for r in rows if r[at] is not None and r[0] is not None], dtype=float)
        assert plain[name] == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-6) and alone[name] == pytest.approx(plain[name], abs=1e-6)
        assert ranks[name] == pytest.approx(np.corrcoef(average_ranks(pairs[:, 0]), average_ranks(pairs[:, 1]))[0, 1])
    assert ranks["same"] is None and plain["same"] is None


def test_rank_biserial_equals_counting_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(bool(b), float(v), None if k % 3 == 0 else float(v)) for k, (b, v) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 20, 200)))]
    tables = L.LeakageTables(spark.createDataFrame(rows, "y boolean, x double, z double"), "y")
    got = {r.feature: r.correlation for r in L.rank_biserial(tables).collect()}
    for at, name in ((1, "x"), (2, "z")):
        high = [r[at] for r in rows if r[0] and r[at] is not None]
        low = [r[at] for r in rows if not r[0] and r[at] is not None]
        wins = sum((h > b) + (h == b) / 2 for h in high for b in low)
        assert got[name] == pytest.approx(2 * wins / (len(high) * len(low)) - 1)


def test_text_columns_are_counted_without_their_texts(spark):
    rows = [(f"id-{i}", ["red", "blue", None][i % 3], "2024-01-0%d" % (1 + i % 9), str(i % 5)) for i in range(600)]
    tables = P.ProfileTables(spark.createDataFrame(rows, "name string, color string, day string, digit string"))
    levels = {r.name: r.levels for r in P.text_levels(tables).collect()}
    assert levels == {"name": 600, "color": 2, "day": 9, "digit": 5}
    found = {r.name: r for r in P.profile(tables).collect()}
    assert found["color"].top_values[0] == ("blue", 200) and found["day"].type == "datetime" and found["name"].looks_like_id
