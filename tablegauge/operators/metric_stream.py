"""Anomaly findings over metric snapshots (run_id, seq, epoch, step, metrics).

NaN and infinities are measurements here and survive every step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablegauge.functions import metric_names as M
from tablegauge.operators.blocks import BLOCK, previous
from tablegauge.operators.order_stats import quantiles, running_totals
from tablegauge.operators.skew import salted_join
from tablegauge.session import durable

# Fixed values of the detectors.
DIVERGENCE_RATIO, DIVERGENCE_JUMP = 10.0, 1e-4
PLATEAU_WINDOW, PLATEAU_SHARE = 5, 1e-3
OVERFIT_WINDOW, OVERFIT_GAP = 3, 0.05


def merge_epochs(snapshots: DataFrame, size: int = BLOCK, sources: bool = False) -> DataFrame:
    """One snapshot per run of consecutive same-epoch rows, named by the seq of its first row.

    Later values of a metric win and the first step stays; rows without an epoch stay alone. ``lines`` counts the rows of
    a snapshot, ``sources`` adds the list of their seqs. Rows are range-partitioned by (run, seq) and folded in one
    sorted pass, at most ``size`` at a time, however long a run is; the first and the last snapshot of each partition may go on in the next one,
    so these few are put together afterwards.
    """
    spark = snapshots.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = snapshots.select(
        "run_id", F.col("seq").cast("bigint"), F.col("epoch").cast("bigint"), F.col("step").cast("bigint"),
        F.col("metrics").cast("map<string,double>"),
    )
    placed = rows.repartitionByRange(partitions, "run_id", "seq").sortWithinPartitions("run_id", "seq")
    folded = durable(placed.mapInArrow(folded_epochs(size), f"{_MERGED.format(rows.schema['run_id'].dataType.simpleString())}, {_EDGE}"))
    names = [c for c in folded.columns if c not in ("part", "place", *([] if sources else ["sources"]))]
    inner = folded.where("place IS NULL").select(*names)
    # two rows a partition at most
    along = Window.orderBy("part", "place")
    edges = folded.where("place IS NOT NULL").select("*", F.lag(F.struct("run_id", "epoch", "part")).over(along).alias("before"))
    goes_on = (F.col("before.run_id") == F.col("run_id")) & (F.col("before.epoch") == F.col("epoch")) & (F.col("before.part") < F.col("part"))
    opened = F.when(~F.coalesce(goes_on, F.lit(False)), F.col("seq"))
    joined = edges.withColumn("island", F.last(opened, ignorenulls=True).over(along)).drop("before")
    values = joined.select("run_id", "island", "last_seq", F.explode("metrics")).groupBy("run_id", "island", "key")
    maps = values.agg(F.max_by("value", "last_seq").alias("value")).groupBy("run_id", "island").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metrics")
    )
    whole = joined.groupBy("run_id", "island").agg(
        F.min("epoch").alias("epoch"),
        F.min(F.when(F.col("step").isNotNull(), F.struct("last_seq", "step")))["step"].alias("step"),
        F.max("last_seq").alias("last_seq"),
        F.sum("lines").alias("lines"),
        F.flatten(F.array_sort(F.collect_list("sources"))).alias("sources"),
    )
    none = F.create_map().cast("map<string,double>")
    ends = whole.join(maps, ["run_id", "island"], "left").withColumn("metrics", F.coalesce("metrics", none))
    return inner.unionByName(ends.withColumnRenamed("island", "seq").select(*names))


_MERGED = "run_id {}, seq bigint, epoch bigint, step bigint, metrics map<string,double>, last_seq bigint, lines bigint, sources array<bigint>"
_EDGE = "part int, place int"


def folded_epochs(size: int = BLOCK):
    """A ``mapInArrow`` function over rows sorted by (run_id, seq): the merged snapshots of a partition.

    ``place`` is 0 and 1 for the partition's first and last snapshot, else null.
    """

    def same(a: pa.Array, b: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)

    def islands(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The merged snapshots of the rows of one batch."""
        n = batch.num_rows
        new = np.ones(n, dtype=bool)
        for name in ("run_id", "epoch"):
            column = batch.column(name)
            held = same(column.slice(1), column.slice(0, n - 1))
            new[1:] = ~held if name == "run_id" else new[1:] | ~held
        starts = np.flatnonzero(new)
        island = np.cumsum(new) - 1
        ends = np.append(starts[1:], n) - 1
        step = batch.column("step")
        at = np.where(step.is_valid().to_numpy(zero_copy_only=False), np.arange(n), n)
        first_step = np.minimum.reduceat(at, starts)
        steps = step.take(pa.array(first_step, mask=first_step == n))
        metrics = batch.column("metrics")
        offsets = np.asarray(metrics.offsets, dtype=np.int64)
        keys, items = metrics.keys, metrics.items
        lengths = np.diff(offsets)
        entry = np.repeat(offsets[:-1], lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        owner = np.repeat(island, lengths)
        coded = keys.take(pa.array(entry)).dictionary_encode()
        order = np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), dtype=object))) if len(coded.dictionary) else np.zeros(0, int)
        code = owner * max(1, len(order)) + (order[coded.indices.to_numpy(zero_copy_only=False)] if len(order) else 0)
        _, back = np.unique(code[::-1], return_index=True)  # the last entry of each island and key
        pick = len(code) - 1 - back
        counts = np.bincount(owner[pick], minlength=len(starts)) if len(pick) else np.zeros(len(starts), int)
        bounds = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        taken = pa.array(entry[pick])
        seq = batch.column("seq")
        return pa.RecordBatch.from_arrays(
            [
                batch.column("run_id").take(pa.array(starts)),
                seq.take(pa.array(starts)),
                batch.column("epoch").take(pa.array(starts)),
                steps,
                pa.MapArray.from_arrays(bounds, keys.take(taken), items.take(taken)),
                seq.take(pa.array(ends)),
                pa.array(ends - starts + 1),
                pa.ListArray.from_arrays(pa.array(np.append(starts, n).astype(np.int32)), seq),
            ],
            names=["run_id", "seq", "epoch", "step", "metrics", "last_seq", "lines", "sources"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, given = TaskContext.get().partitionId(), None, 0

        def placed(table: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            """Mark the rows given out; the first of a partition and the last are edges."""
            nonlocal given
            place: list[int | None] = [None] * table.num_rows
            if last:
                place[-1] = 1
            if given == 0 and place:
                place[0] = 0
            given += table.num_rows
            arrays = [*table.columns, pa.array([part] * table.num_rows, pa.int32()), pa.array(place, pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, names=[*table.schema.names, "part", "place"])

        pieces = (b.slice(low, size) for b in batches for low in range(0, b.num_rows, size))
        for batch in pieces:
            table = islands(batch)
            if held is not None:
                old, new = held.slice(0, 1).to_pylist()[0], table.slice(0, 1).to_pylist()[0]
                if old["run_id"] == new["run_id"] and old["epoch"] is not None and old["epoch"] == new["epoch"]:
                    old["metrics"] = sorted((dict(old["metrics"]) | dict(new["metrics"])).items())
                    old["step"] = new["step"] if old["step"] is None else old["step"]
                    old["last_seq"], old["lines"] = new["last_seq"], old["lines"] + new["lines"]
                    old["sources"] += new["sources"]
                    joined = pa.RecordBatch.from_pylist([old], schema=table.schema)
                    table = pa.Table.from_batches([joined, table.slice(1)]).combine_chunks().to_batches()[0]
                else:
                    yield placed(held, False)
            if table.num_rows > 1:
                yield placed(table.slice(0, table.num_rows - 1), False)
            held = table.slice(table.num_rows - 1)
        if held is not None:
            yield placed(held, True)

    return run


def loss_rows(snapshots: DataFrame) -> DataFrame:
    """Train and validation loss and the state of all losses, per snapshot."""
    return snapshots.select(
        "run_id",
        "seq",
        "epoch",
        M.first_of(F.col("metrics"), M.TRAIN_LOSS).alias("train"),
        M.first_of(F.col("metrics"), M.VAL_LOSS).alias("val"),
        M.has_loss(F.col("metrics")).alias("has_loss"),
        M.bad_losses(F.col("metrics")).alias("bad_keys"),
    )


def _finding(df: DataFrame, rule: str, severity: str, measure, message) -> DataFrame:
    return df.select(
        "run_id",
        F.lit(rule).alias("rule_id"),
        F.lit(severity).alias("severity"),
        "epoch",
        measure.cast("double").alias("measure"),
        message.alias("message"),
    )


def nan_findings(losses: DataFrame) -> DataFrame:
    """Where the loss went bad, for runs whose last loss is still bad."""
    carrying = losses.where("has_loss").withColumn("bad", F.size("bad_keys") > 0)
    per_run = carrying.groupBy("run_id").agg(
        F.max(F.when(~F.col("bad"), F.col("seq"))).alias("last_good")
    )
    later = salted_join(carrying.where("bad"), per_run, ["run_id"], ["seq"], "inner").where(
        "last_good IS NULL OR seq > last_good"
    )
    first = later.groupBy("run_id").agg(F.min_by(F.struct("epoch", "bad_keys"), "seq").alias("f"))
    rows = first.select("run_id", "f.epoch", "f.bad_keys")
    message = F.concat(F.lit("loss became NaN or infinite: "), F.array_join("bad_keys", ", "))
    return _finding(rows, "nan", "error", F.lit(None), message)


def divergence_findings(losses: DataFrame, ratio: float = DIVERGENCE_RATIO, size: int = BLOCK) -> DataFrame:
    """The first jump of the train loss by ``ratio`` in magnitude, per run."""
    finite = losses.where(F.col("train").isNotNull() & ~M.not_finite(F.col("train")))
    pairs = previous(finite, ["run_id"], "seq", {"before": F.struct(F.col("train").alias("value"), "seq")}, size)
    was, now = F.abs("before.value"), F.abs("train")
    times = F.try_divide(now, was)
    jumped = (was > 0) & (now - was >= DIVERGENCE_JUMP) & (times >= ratio)
    first = pairs.where(jumped).groupBy("run_id").agg(
        F.min_by(F.struct("epoch", times.alias("times"), F.col("before.seq").alias("before"), "seq"), "seq").alias("f")
    )
    # the places of the two snapshots in their run: one finding a run meets its run's rows
    places = salted_join(losses.select("run_id", "seq"), first, ["run_id"], ["seq"], "inner").groupBy("run_id").agg(
        F.first("f").alias("f"),
        F.count_if(F.col("seq") < F.col("f.before")).alias("before"),
        F.count_if(F.col("seq") < F.col("f.seq")).alias("position"),
    )
    rows = places.select("run_id", "f.epoch", "f.times", "before", "position")
    message = F.format_string(
        "train loss jumped %.1f times between snapshots %d and %d", "times", "before", "position"
    )
    return _finding(rows, "divergence", "error", F.col("times"), message)


def _last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows per run; the limit applies before the shuffle."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("seq"))
    return rows.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)


def plateau_findings(
    losses: DataFrame, window: int = PLATEAU_WINDOW, share: float = PLATEAU_SHARE
) -> DataFrame:
    """Runs whose loss is flat over their last snapshots; validation loss first."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min_by("epoch", "age").alias("epoch")]
    for c in ("val", "train"):
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.max(F.abs(c)).alias(f"{c}_top"),
            (F.max(c) - F.min(c)).alias(f"{c}_spread"),
        ]
    recent = _last_rows(losses, window).groupBy("run_id").agg(*aggs)
    use_val = F.col("val_n") == window

    def pick(suffix: str):
        return F.when(use_val, F.col("val" + suffix)).otherwise(F.col("train" + suffix))

    base = F.when(pick("_top") == 0, 1.0).otherwise(pick("_top"))
    rows = recent.where((F.col("n") == window) & (use_val | (F.col("train_n") == window))).select(
        "run_id", "epoch", (pick("_spread") / base).alias("relative"), F.when(use_val, "val").otherwise("train").alias("side")
    )
    message = F.concat("side", F.lit(f" loss is flat over the last {window} snapshots"))
    return _finding(rows.where(F.col("relative") < share), "plateau", "warning", F.col("relative"), message)


def overfitting_findings(
    losses: DataFrame, window: int = OVERFIT_WINDOW, gap: float = OVERFIT_GAP
) -> DataFrame:
    """Runs whose train loss falls while their validation loss rises."""
    ends = None
    for c in ("train", "val"):
        finite = losses.where(F.col(c).isNotNull() & ~M.not_finite(F.col(c)))
        tail = _last_rows(finite.select("run_id", "seq", c), window + 1)
        side = tail.groupBy("run_id").agg(
            F.max(F.when(F.col("age") == 1, F.col(c))).alias(f"{c}_now"),
            F.max(F.when(F.col("age") == window + 1, F.col(c))).alias(f"{c}_then"),
        )
        ends = side if ends is None else ends.join(side, "run_id")
    last = losses.groupBy("run_id").agg(F.max_by("epoch", "seq").alias("epoch"))
    fell = F.col("train_now") < F.col("train_then")
    rose = F.col("val_now") > F.col("val_then")
    apart = F.col("val_now") - F.col("train_now")
    rows = ends.where(fell & rose & (apart > gap)).join(last, "run_id")
    message = F.lit(f"train loss fell and validation loss rose over the last {window} snapshots")
    return _finding(rows, "overfitting", "warning", apart, message)


def all_findings(snapshots: DataFrame) -> DataFrame:
    """Findings of every detector over merged snapshots."""
    losses = durable(loss_rows(snapshots))
    return (
        nan_findings(losses)
        .unionByName(divergence_findings(losses))
        .unionByName(overfitting_findings(losses))
        .unionByName(plateau_findings(losses))
    )


def latency_summary(
    calls: DataFrame, group: Sequence[str], seconds: str, retried: str, cost_per_call: float
) -> DataFrame:
    """Count, mean, deviation, median, 99th percentile, retry rate and cost."""
    base = calls.groupBy(*group).agg(
        F.count(F.lit(1)).alias("calls"),
        F.avg(seconds).alias("mean_s"),
        F.coalesce(F.stddev_samp(seconds), F.lit(0.0)).alias("std_s"),
        F.avg(F.col(retried).cast("int")).alias("retry_rate"),
        (F.count(F.lit(1)) * F.lit(cost_per_call)).alias("cost"),
    )
    counts = calls.groupBy(*group, F.col(seconds).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    q = quantiles(running_totals(counts, list(group), "value", ["n"], reused=True), [0.5, 0.99], group)
    return base.join(q, list(group)).select(
        *base.columns, F.col("q")[0].alias("p50_s"), F.col("q")[1].alias("p99_s")
    )
