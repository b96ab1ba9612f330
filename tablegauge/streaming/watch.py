"""Follow mode: findings of growing training logs, emitted once.

Each run keeps a state of fixed size: the snapshot still open to merging, the last
few loss points, the last finite loss, the first divergence, the start of a bad
streak and the last ``REMEMBERED`` findings that were reported. New lines update it;
the history is never read again. A finding is known by its rule, epoch and message,
whatever its measure is by then.
"""

from __future__ import annotations

import copy
import json
import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tablegauge.functions import metric_names as M
from tablegauge.functions.metric_names import TRAIN_LOSS, VAL_LOSS
from tablegauge.operators.metric_stream import (
    DIVERGENCE_JUMP, DIVERGENCE_RATIO, OVERFIT_GAP, OVERFIT_WINDOW, PLATEAU_SHARE, PLATEAU_WINDOW,
)
from tablegauge.sources.logs import parse_log_lines

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def output(run_id: T.DataType) -> T.StructType:
    """The findings' columns for runs identified by this type."""
    return T.StructType(
        [
            T.StructField("run_id", run_id),
            T.StructField("rule_id", T.StringType()),
            T.StructField("severity", T.StringType()),
            T.StructField("epoch", T.LongType()),
            T.StructField("measure", T.DoubleType()),
            T.StructField("message", T.StringType()),
        ]
    )


OUTPUT = output(T.LongType())
# Reported findings a run remembers. Rules speak of the current epoch, so older ones come back only if epochs do.
REMEMBERED = 200
_STATE = T.StructType([T.StructField("state", T.StringType())])
_EMPTY = {"open": None, "train": [], "val": [], "recent": [], "previous": None, "closed": 0, "divergence": None, "nan": None, "seen": []}


def _finite(x) -> bool:
    return x is not None and math.isfinite(x)


def _close(s: dict, snap: dict) -> None:
    """Fold a finished snapshot into the state."""
    if snap["has_loss"]:
        if not snap["bad"]:
            s["nan"] = None
        elif s["nan"] is None:
            s["nan"] = [snap["epoch"], ", ".join(snap["bad"])]
    train, val = snap["train"], snap["val"]
    if _finite(train):
        before = s["previous"]
        if s["divergence"] is None and before and before[0]:
            now, was = abs(train), abs(before[0])
            if now - was >= DIVERGENCE_JUMP and now / was >= DIVERGENCE_RATIO:
                s["divergence"] = [snap["epoch"], now / was, before[1], s["closed"]]
        s["previous"] = [train, s["closed"]]
        s["train"] = (s["train"] + [train])[-(OVERFIT_WINDOW + 1):]
    if _finite(val):
        s["val"] = (s["val"] + [val])[-(OVERFIT_WINDOW + 1):]
    s["recent"] = (s["recent"] + [[train, val, snap["epoch"]]])[-PLATEAU_WINDOW:]
    s["closed"] += 1


def _findings(s: dict) -> list[tuple]:
    found = []
    if s["nan"] is not None:
        found.append(("nan", "error", s["nan"][0], None, f"loss became NaN or infinite: {s['nan'][1]}"))
    if s["divergence"] is not None:
        epoch, times, was, now = s["divergence"]
        found.append(("divergence", "error", epoch, times, f"train loss jumped {times:.1f} times between snapshots {was} and {now}"))
    last = s["recent"][-1][2] if s["recent"] else None
    if len(s["train"]) > OVERFIT_WINDOW and len(s["val"]) > OVERFIT_WINDOW:
        gap = s["val"][-1] - s["train"][-1]
        if s["train"][-1] < s["train"][0] and s["val"][-1] > s["val"][0] and gap > OVERFIT_GAP:
            text = f"train loss fell and validation loss rose over the last {OVERFIT_WINDOW} snapshots"
            found.append(("overfitting", "warning", last, gap, text))
    if len(s["recent"]) == PLATEAU_WINDOW:
        for side in (1, 0):
            values = [r[side] for r in s["recent"]]
            if any(v is None for v in values):
                continue
            if all(math.isfinite(v) for v in values):
                flat = (max(values) - min(values)) / (max(abs(v) for v in values) or 1.0)
                if flat < PLATEAU_SHARE:
                    name = "val" if side else "train"
                    found.append(("plateau", "warning", last, flat, f"{name} loss is flat over the last {PLATEAU_WINDOW} snapshots"))
            break
    return found


def _losses(metrics: dict) -> dict:
    """The loss view of merged metrics, named as in the batch operators."""
    by_words = {}
    for name in sorted(metrics):
        by_words.setdefault(metrics[name][1], metrics[name][0])

    def first(names):
        return next((by_words[w] for w in ("_".join(sorted(set(n.split("_")))) for n in names) if w in by_words), None)

    values = [(k, v) for k, (v, _, loss) in metrics.items() if loss]
    return {
        "train": first(TRAIN_LOSS),
        "val": first(VAL_LOSS),
        "has_loss": bool(values),
        "bad": sorted(k for k, v in values if not math.isfinite(v)),
    }


class FollowRuns(StatefulProcessor):
    """Keeps one small state per run (the last snapshots, and what was reported) and yields findings not seen before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = self.state.get()
        s = json.loads(kept[0]) if kept is not None else copy.deepcopy(_EMPTY)
        # the lines of one run in one micro-batch, which the source's rate bounds
        lines = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        for line in lines.itertuples(index=False):
            epoch = None if pd.isna(line.epoch) else int(line.epoch)
            metrics = {
                k: [float(v), w, bool(loss)] for k, v, w, loss in zip(line.names, line.values_, line.words, line.losses)
            }
            if s["open"] is not None and epoch is not None and s["open"]["epoch"] == epoch:
                s["open"]["metrics"].update(metrics)
                continue
            if s["open"] is not None:
                _close(s, {"epoch": s["open"]["epoch"], **_losses(s["open"]["metrics"])})
            s["open"] = {"epoch": epoch, "metrics": metrics}
        view = copy.deepcopy(s)
        _close(view, {"epoch": s["open"]["epoch"], **_losses(s["open"]["metrics"])})
        found = _findings(view)
        def identity(finding: tuple) -> list:
            rule, _, epoch, _, message = finding
            return [rule, epoch, message]

        fresh = [f for f in found if identity(f) not in s["seen"]]
        # what was reported stays known, so a finding that goes and comes back is not repeated
        s["seen"] = (s["seen"] + [identity(f) for f in fresh])[-REMEMBERED:]
        self.state.update((json.dumps(s),))
        if fresh:
            frame = pd.DataFrame(fresh, columns=["rule_id", "severity", "epoch", "measure", "message"])
            frame.insert(0, "run_id", key[0])
            frame["epoch"] = frame["epoch"].astype("Int64")
            frame["measure"] = frame["measure"].astype("float64")
            yield frame

    def close(self) -> None:
        pass


def follow(lines: DataFrame) -> DataFrame:
    """Findings of a stream of log lines (run_id, line_no, line).

    Parsing stays in the JVM; the processor sees only names, values and epochs.
    Set ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKSDB`` first.
    """
    parsed = parse_log_lines(lines)
    entries = F.map_entries("metrics")
    rows = parsed.select(
        "run_id",
        "seq",
        "epoch",
        F.transform(entries, lambda e: e["key"]).alias("names"),
        F.transform(entries, lambda e: e["value"]).alias("values_"),
        F.transform(entries, lambda e: F.array_join(M.words(e["key"]), "_")).alias("words"),
        F.transform(entries, lambda e: M.is_loss(e["key"])).alias("losses"),
    )
    return rows.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=FollowRuns(), outputStructType=output(lines.schema["run_id"].dataType), outputMode="Append", timeMode="None"
    )
