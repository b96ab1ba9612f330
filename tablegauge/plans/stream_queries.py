"""Registered queries over training logs derived from the event table.

A user is a run and an event a log line; the line number is the event id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablegauge.functions import metric_names as M
from tablegauge.operators import metric_stream as S
from tablegauge.plans.inputs import derive, table, with_inputs
from tablegauge.plans.rounding import rounded
from tablegauge.session import durable, shared_folder
from tablegauge.sources import logs, runs as run_source
from tablegauge.streaming import watch, windowed_drift

_EPOCH = "CAST(floor(event_id / 300) AS BIGINT)"
_TRAIN = (
    "CASE WHEN user_id % 7 = 1 THEN round(100000 - event_id * 0.001, 3) WHEN user_id % 7 = 2 THEN 0.5 "
    "WHEN event_id % 97 = 0 THEN round(value * 100, 2) ELSE value END"
)
_VAL = (
    "CASE WHEN user_id % 7 = 1 THEN round(200000 + event_id * 0.001, 3) WHEN user_id % 7 = 2 THEN 0.25 ELSE value END"
)
_NAN = "(event_id % 101 = 0 OR (user_id % 11 = 0 AND event_id % 5 > 0))"
LINES = f"""
SELECT user_id AS run_id, event_id AS line_no,
  CASE WHEN event_id % 13 = 0 THEN 'Total time: 412.30'
       WHEN event_id % 17 = 0 THEN 'saving to /tmp/model.pt'
       WHEN {_NAN} THEN 'Epoch ' || {_EPOCH} || '/99 train_loss=nan'
       WHEN event_id % 2 = 0 THEN 'Epoch ' || {_EPOCH} || ' step: ' || event_id || ' Loss/train=' || {_TRAIN} || ', lr=0.001'
       ELSE '  epoch=' || {_EPOCH} || ' val_loss: ' || {_VAL} END AS line
FROM {{events}}"""
NAMES = """
SELECT CASE event_id % 5 WHEN 0 THEN 'Loss/train' WHEN 1 THEN ' train-loss' WHEN 2 THEN 'Train  Loss'
  WHEN 3 THEN '_val.' || event_type || '_' ELSE 'val/' || event_type || '/val' END AS name FROM {events}"""
HISTORY = """
SELECT user_id AS run_id, event_id AS line_no,
  CASE event_id % 6
   WHEN 0 THEN '{{"_step": ' || event_id || ', "_runtime": 3.5, "epoch": ' || (event_id % 9) || ', "loss": ' || value || '}}'
   WHEN 1 THEN '{{"_step": ' || event_id || ', "loss": NaN, "note": "1.5", "ok": true}}'
   WHEN 2 THEN '{{"_step": ' || event_id || ', "acc": ' || value || ', "bad'
   WHEN 3 THEN '{{"_runtime": 4.0, "note": "x"}}'
   WHEN 4 THEN '{{"val/loss": ' || value || ', "lr": 1e-3}}'
   ELSE '[1, 2]' END AS line
FROM {events}"""
SCALARS = """
SELECT user_id % 10 AS run_id, event_id AS ord, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 40 END AS step,
  CASE WHEN event_type = 'error' THEN 'epoch' ELSE event_type END AS tag, value FROM {events}"""
RECORDS = """
SELECT event_id AS run_id, CASE event_id % 4
  WHEN 0 THEN '{{"config": {{"lr": 0.1, "opt": "' || event_type || '"}}, "metrics": [{{"epoch": 1, "loss": ' || value || '}}, {{"epoch": 2, "loss": 0.5, "note": "high"}}]}}'
  WHEN 1 THEN '[{{"loss": ' || value || '}}, {{"loss": 2, "acc": 0.75}}]'
  WHEN 2 THEN '{{"metrics": [{{"loss": '
  ELSE '{{"config": {{"lr": ' || value || '}}}}' END AS text
FROM {events}"""
DETAILS = """
SELECT event_id AS run_id, CASE event_id % 3
  WHEN 0 THEN '{{"name": "' || event_type || '", "created": "2024-01-0' || (1 + user_id % 9) || '", "config": {{}}}}'
  WHEN 1 THEN '[{{"loss": 1}}]' ELSE '{{"name": null}}' END AS text,
  CASE WHEN event_id % 5 = 0 THEN 'note ' || user_id END AS notes FROM {events}"""
FILES = """
SELECT 'runs/' || user_id AS run_dir, CASE event_id % 41 WHEN 0 THEN 'events.out.tfevents.' || event_id
  WHEN 1 THEN 'files/wandb-history.jsonl' WHEN 2 THEN 'wandb-summary.json' ELSE 'log_' || event_type || '.txt' END AS name
FROM {events}"""
CALLS = "SELECT event_type, value / 100 AS seconds, event_id % 7 = 0 AS retried FROM {events}"


def lines(spark, folder):
    return derive(spark, folder, LINES)


def merged(spark, folder):
    return S.merge_epochs(durable(logs.parse_log_lines(lines(spark, folder))), sources=True)


def losses(spark, folder):
    return durable(S.loss_rows(merged(spark, folder)))


def _braces(sql):
    """Doubled braces are literal braces in a Spark derivation only."""
    return sql.replace("{{", "{").replace("}}", "}")


_SNAPSHOTS = f"""
src AS (SELECT user_id AS run_id, event_id AS seq, event_id % 13 = 0 AS timing, {_EPOCH} AS e, {_TRAIN} AS t,
  {_VAL} AS v, {_NAN} AS isnan_, event_id % 2 = 0 AS even FROM events WHERE NOT (event_id % 17 = 0 AND event_id % 13 <> 0)),
snap AS (SELECT run_id, seq, CASE WHEN timing THEN NULL ELSE e END AS epoch,
  CASE WHEN NOT timing AND NOT isnan_ AND even THEN seq END AS step,
  CASE WHEN NOT timing AND NOT isnan_ AND even THEN t END AS train,
  CASE WHEN NOT timing AND NOT isnan_ AND NOT even THEN v END AS val,
  NOT timing AND isnan_ AS bad, timing FROM src),
starts AS (SELECT *, CASE WHEN NOT coalesce(epoch = lag(epoch) OVER (PARTITION BY run_id ORDER BY seq), false) THEN seq END AS st
  FROM snap),
isl AS (SELECT *, max(st) OVER (PARTITION BY run_id ORDER BY seq) AS island FROM starts),
merged AS (SELECT run_id, island AS seq, min(epoch) AS epoch, arg_min(step, seq) FILTER (step IS NOT NULL) AS step,
  arg_max(train, seq) FILTER (train IS NOT NULL) AS good_train, arg_max(val, seq) FILTER (val IS NOT NULL) AS val,
  bool_or(bad) AS bad, bool_or(timing) AS timing, count(*) AS lines, max(seq) AS last_seq, string_agg(seq, ',' ORDER BY seq) AS sources FROM isl GROUP BY run_id, island),
losses AS (SELECT run_id, seq, epoch, CASE WHEN good_train IS NOT NULL THEN good_train WHEN bad THEN 'nan'::DOUBLE END AS train,
  good_train, val, bad, good_train IS NOT NULL OR val IS NOT NULL OR bad AS has_loss FROM merged)"""
_DETECT = """
lossy AS (SELECT * FROM losses WHERE has_loss),
good AS (SELECT run_id, max(seq) FILTER (NOT bad) AS last_good FROM lossy GROUP BY run_id),
f_nan AS (SELECT run_id, 'nan' AS rule_id, 'error' AS severity, arg_min(coalesce(epoch, -1), seq) AS epoch, NULL::DOUBLE AS measure
  FROM lossy JOIN good USING (run_id) WHERE bad AND (last_good IS NULL OR seq > last_good) GROUP BY run_id),
fin AS (SELECT *, lag(good_train) OVER (PARTITION BY run_id ORDER BY seq) AS prev FROM losses WHERE good_train IS NOT NULL),
f_div AS (SELECT run_id, 'divergence' AS rule_id, 'error' AS severity, arg_min(epoch, seq) AS epoch,
  arg_min(abs(good_train) / abs(prev), seq) AS measure FROM fin
  WHERE abs(prev) > 0 AND abs(good_train) - abs(prev) >= 1e-4 AND abs(good_train) / abs(prev) >= 10 GROUP BY run_id),
aged AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM losses),
recent AS (SELECT run_id, count(*) AS n, coalesce(arg_min(coalesce(epoch, -1), age), -1) AS epoch, count(val) AS vn, count(train) AS tn,
  max(abs(val)) AS vt, max(val) - min(val) AS vs, max(abs(train)) AS tt, max(train) - min(train) AS ts
  FROM aged WHERE age <= 5 GROUP BY run_id),
flat AS (SELECT run_id, epoch, CASE WHEN vn = 5 THEN vs / (CASE WHEN vt = 0 THEN 1 ELSE vt END)
  ELSE ts / (CASE WHEN tt = 0 THEN 1 ELSE tt END) END AS rel FROM recent WHERE n = 5 AND (vn = 5 OR tn = 5)),
f_pla AS (SELECT run_id, 'plateau' AS rule_id, 'warning' AS severity, epoch, rel AS measure FROM flat WHERE rel < 1e-3),
tr AS (SELECT run_id, good_train AS x, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM losses WHERE good_train IS NOT NULL),
va AS (SELECT run_id, val AS x, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM losses WHERE val IS NOT NULL),
ends AS (SELECT run_id, max(x) FILTER (age = 1) AS t1, max(x) FILTER (age = 4) AS t4 FROM tr GROUP BY run_id),
vends AS (SELECT run_id, max(x) FILTER (age = 1) AS v1, max(x) FILTER (age = 4) AS v4 FROM va GROUP BY run_id),
f_ovr AS (SELECT run_id, 'overfitting' AS rule_id, 'warning' AS severity,
  (SELECT coalesce(epoch, -1) FROM aged a WHERE a.run_id = ends.run_id AND age = 1) AS epoch, v1 - t1 AS measure
  FROM ends JOIN vends USING (run_id) WHERE t1 < t4 AND v1 > v4 AND v1 - t1 > 0.05)"""


def _sql(body, detect=True):
    return "WITH " + _SNAPSHOTS.strip() + (", " + _DETECT.strip() if detect else "") + " " + body


def _prefix_sql(batches):
    """Findings of every prefix of the batches, each once: by rule and epoch, and for a plateau by its side too."""
    parts = []
    for k in range(1, batches + 1):
        upto = f"FROM (SELECT * FROM events WHERE event_id < (SELECT (max(event_id) + 1) * {k} // {batches} FROM events)) events"
        body = (_SNAPSHOTS + ", " + _DETECT).replace("FROM events", upto, 1).strip()
        parts.append(
            f"SELECT * FROM (WITH {body} SELECT run_id, rule_id, severity, nullif(epoch, -1) AS epoch, '' AS said FROM f_nan UNION ALL "
            "SELECT run_id, rule_id, severity, nullif(epoch, -1), round(measure, 1)::VARCHAR FROM f_div UNION ALL "
            "SELECT run_id, rule_id, severity, nullif(epoch, -1), '' FROM f_ovr UNION ALL "
            "SELECT run_id, 'plateau', 'warning', nullif(flat.epoch, -1), CASE WHEN vn = 5 THEN 'val' ELSE 'train' END "
            "FROM flat JOIN recent USING (run_id) WHERE rel < 1e-3)"
        )
    return (
        "SELECT 'run-' || run_id AS run_id, rule_id, severity, epoch, count(DISTINCT said) AS reports FROM (" + " UNION ALL ".join(parts)
        + ") GROUP BY ALL"
    )


def _found(df):
    return rounded(df.select("run_id", "rule_id", "severity", "epoch", "measure"), 4)


def _found_sql(*names):
    return _sql(
        " UNION ALL ".join(
            f"SELECT run_id, rule_id, severity, nullif(epoch, -1) AS epoch, ROUND(measure, 4) AS measure FROM {n}" for n in names
        )
    )


BATCHES = 4


def _batches(spark, folder, sql, bounds):
    """The derivation cut by ranges of event ids, each range dealt out so that every core parses lines of it."""
    events = table(spark, folder, "events")
    last = events.agg(F.max("event_id")).first()[0] or 0
    rows, low = spark.sql(sql, events=events), 0
    for k in range(1, bounds + 1):
        high = (last + 1) * k // bounds
        yield rows.where(f"line_no >= {low} AND line_no < {high}").repartition(spark.sparkContext.defaultParallelism, "line_no")
        low = high


def _follow(spark, folder):
    """The event table as a stream of log lines of named runs, in several micro-batches; findings land in a table.

    The stream is taken up again after every range is written and reads all its files as one micro-batch.
    """
    base = f"{shared_folder(spark)}/follow-{uuid.uuid4()}"
    named = LINES.replace("user_id AS run_id", "'run-' || user_id AS run_id").replace("{{events}}", "{events}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, watch.ROCKSDB)
    try:
        for batch in _batches(spark, folder, named, BATCHES):
            batch.write.mode("append").parquet(f"{base}/lines")
            query = (
                watch.follow(spark.readStream.schema(batch.schema).parquet(f"{base}/lines"))
                .writeStream.format("parquet")
                .option("path", f"{base}/found")
                .option("checkpointLocation", f"{base}/state")
                .outputMode("append")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    found = spark.read.schema(watch.output(T.StringType())).parquet(f"{base}/found")
    return found.groupBy("run_id", "rule_id", "severity", "epoch").agg(F.count(F.lit(1)).alias("reports"))


WINDOWED = "SELECT ts, value, user_id FROM {events}"


def _windowed(spark, folder):
    rows = derive(spark, folder, WINDOWED)
    early = rows.where("ts < TIMESTAMP '2024-01-08 00:00:00'").drop("ts")
    reference = windowed_drift.reference_bins(early, ["value", "user_id"])
    return rounded(windowed_drift.window_drift(windowed_drift.window_bins(rows, reference, "ts", "1 day"), reference))


def _windowed_stream(spark, folder):
    """The events as a stream by id, so rows come late; two last rows far ahead close all windows."""
    base = f"{shared_folder(spark)}/windows-{uuid.uuid4()}"
    events = table(spark, folder, "events")
    # event time has to be an instant; the clock times of the table are read as UTC, whatever the session's zone is
    instant = F.expr("timestamp_seconds(0) + (ts - TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    events = events.select("event_id", instant.alias("ts"), "value", "user_id", "event_type")
    rows = events.drop("event_id")
    early = rows.where("ts < timestamp_seconds(1704672000)").drop("ts")  # 8 January 2024
    reference = windowed_drift.reference_bins(early, ["value", "user_id", "event_type"])
    for part in range(3):
        events.where(f"event_id % 3 = {part}").drop("event_id").coalesce(1).write.mode("append").parquet(f"{base}/in")
    for days in (365, 400):
        ahead = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts"))
        ahead = ahead.select("ts", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("user_id"), F.lit("none").alias("event_type"))
        ahead.coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")

    def sink(found, batch_id):
        found.write.mode("append").parquet(f"{base}/found")

    query = windowed_drift.stream_window_drift(stream, reference, "ts", "1 day", "60 days", sink, f"{base}/state", once=True)
    query.awaitTermination()
    clock = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + (window_start - timestamp_seconds(0))")
    return rounded(spark.read.parquet(f"{base}/found").withColumn("window_start", clock))


def _numbered_files(spark, folder):
    """The log lines written as text files that hold many runs each, then read by split and numbered within their run."""
    base = f"{shared_folder(spark)}/logs-{uuid.uuid4()}"
    rows = lines(spark, folder).select("run_id", "line_no", "line")
    together = rows.repartition("run_id").sortWithinPartitions("run_id", "line_no")
    together.select(F.concat("run_id", F.lit(logs.RUN_END), F.coalesce("line", F.lit("")))).write.text(base)
    numbered = logs.lines_of_runs(logs.read_lines(spark, base))
    parsed = logs.parse_log_lines(numbered.withColumn("run_id", F.col("run_id").cast("long")))
    return parsed.select("run_id", "seq", "epoch", "step", F.explode_outer("metrics").alias("metric", "value"))


QUERIES = {
    "src_06_read_lines": _numbered_files,
    "drf_17_stream": _windowed_stream,
    "src_03_run_records": lambda s, f: run_source.run_metrics(derive(s, f, RECORDS)),
    "src_03_run_config": lambda s, f: run_source.run_config(derive(s, f, RECORDS)),
    "src_03_run_details": lambda s, f: run_source.run_details(
        derive(s, f, DETAILS).select("run_id", "text"), derive(s, f, DETAILS).where("notes IS NOT NULL").select("run_id", "notes")
    ),
    "src_04_tracker_history": lambda s, f: logs.parse_history(derive(s, f, HISTORY)).select(
        "run_id", "seq", "epoch", "step", F.explode_outer("metrics").alias("metric", "value")
    ),
    "src_05_long_scalars": lambda s, f: logs.pivot_scalars(derive(s, f, SCALARS)).select(
        "run_id", "step", "epoch", F.explode_outer("metrics").alias("tag", "value")
    ),
    "src_06_log_lines": lambda s, f: logs.parse_log_lines(lines(s, f)).select(
        "run_id", "seq", "epoch", "step", F.explode_outer("metrics").alias("metric", "value")
    ),
    "src_07_run_folders": lambda s, f: logs.classify_run_folders(derive(s, f, FILES)),
    "met_01_metric_names": lambda s, f: derive(s, f, NAMES)
    .groupBy(M.normalised(F.col("name")).alias("normal"), F.array_join(M.words(F.col("name")), "+").alias("words"))
    .agg(F.count(F.lit(1)).alias("n")),
    "met_02_loss_state": lambda s, f: losses(s, f).groupBy("run_id").agg(
        F.count_if("has_loss").alias("with_loss"), F.count_if(F.size("bad_keys") > 0).alias("invalid")
    ),
    "met_03_canonical_losses": lambda s, f: losses(s, f).select("run_id", "seq", "train", "val"),
    "met_04_merged_epochs": lambda s, f: merged(s, f).select(
        "run_id", "seq", "epoch", "step", "lines", "last_seq", F.size("metrics").alias("n_metrics"),
        F.array_join("sources", ",").alias("sources"),
    ),
    "met_05_nan": lambda s, f: _found(S.nan_findings(losses(s, f))),
    "met_06_divergence": lambda s, f: _found(S.divergence_findings(losses(s, f))),
    "met_07_plateau": lambda s, f: _found(S.plateau_findings(losses(s, f))),
    "met_08_overfitting": lambda s, f: _found(S.overfitting_findings(losses(s, f))),
    "met_09_all_findings": lambda s, f: _found(S.all_findings(merged(s, f))),
    "met_10_follow": _follow,
    "drf_17_windowed_drift": _windowed,
    "met_11_latency": lambda s, f: rounded(
        S.latency_summary(derive(s, f, CALLS), ["event_type"], "seconds", "retried", 0.008)
    ),
}
_TENTHS = ", ".join(f"{i / 10}" for i in range(11))
ORACLES = {
    "src_03_run_records": """
SELECT event_id AS run_id, u.seq, u.metric, u.value FROM events, LATERAL (SELECT * FROM (VALUES
  (0, 0, 'epoch', 1.0), (0, 0, 'loss', value), (0, 1, 'epoch', 2.0), (0, 1, 'loss', 0.5),
  (1, 0, 'loss', value), (1, 1, 'loss', 2.0), (1, 1, 'acc', 0.75)) AS t(m, seq, metric, value) WHERE m = event_id % 4) u""",
    "src_03_run_config": """
SELECT event_id AS run_id, u.key, u.value FROM events, LATERAL (SELECT * FROM (VALUES (0, 'lr', '0.1'),
  (0, 'opt', event_type), (3, 'lr', CAST(value AS VARCHAR))) AS t(m, key, value) WHERE m = event_id % 4) u""",
    "src_03_run_details": """
SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS name,
  CASE WHEN event_id % 3 = 0 THEN '2024-01-0' || (1 + user_id % 9) END AS created,
  CASE WHEN event_id % 5 = 0 THEN 'note ' || user_id END AS notes FROM events""",
    "src_04_tracker_history": """
SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN event_id % 9 END AS epoch,
  CASE WHEN event_id % 6 < 2 THEN event_id END AS step, u.metric, u.value
FROM events, LATERAL (SELECT * FROM (VALUES (0, 'loss', value), (1, 'loss', 'nan'::DOUBLE), (4, 'val/loss', value),
  (4, 'lr', 0.001)) AS t(m, metric, value) WHERE m = event_id % 6) u""",
    "src_05_long_scalars": with_inputs(
        "SELECT run_id, step, epoch, tag, value FROM (SELECT DISTINCT run_id, step FROM s) k LEFT JOIN "
        "(SELECT run_id AS r1, step AS s1, CAST(trunc(arg_max(value, ord)) AS BIGINT) AS epoch FROM s WHERE tag = 'epoch' GROUP BY ALL) "
        "ON r1 = run_id AND s1 IS NOT DISTINCT FROM step LEFT JOIN "
        "(SELECT run_id AS r2, step AS s2, tag, arg_max(value, ord) AS value FROM s WHERE tag <> 'epoch' GROUP BY ALL) "
        "ON r2 = run_id AND s2 IS NOT DISTINCT FROM step",
        s=SCALARS,
    ),
    "src_06_log_lines": "WITH " + _SNAPSHOTS.strip() + """
SELECT run_id, seq, epoch, step, metric, value FROM snap, LATERAL (SELECT * FROM (VALUES
  ('time', CASE WHEN timing THEN 412.3 END), ('train_loss', CASE WHEN bad THEN 'nan'::DOUBLE END), ('Loss/train', train),
  ('lr', CASE WHEN train IS NOT NULL THEN 0.001 END), ('val_loss', val)) AS t(metric, value) WHERE value IS NOT NULL) u""",
    "src_07_run_folders": with_inputs(
        "SELECT run_dir, CASE WHEN bool_or(starts_with(name, 'events.out.tfevents.')) THEN 'tensorboard' "
        "WHEN bool_or(name IN ('wandb-summary.json', 'files/wandb-history.jsonl')) THEN 'wandb' ELSE 'plain_text' END AS source "
        "FROM f GROUP BY run_dir",
        f=FILES,
    ),
    "met_01_metric_names": "SELECT normal, words, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 < 3 THEN CASE WHEN event_id % 5 = 0 "
    "THEN 'loss_train' ELSE 'train_loss' END WHEN event_id % 5 = 3 THEN 'val_' || event_type ELSE 'val_' || event_type || '_val' END AS normal, "
    "CASE WHEN event_id % 5 < 3 THEN 'loss+train' WHEN event_type < 'val' THEN event_type || '+val' ELSE 'val+' || event_type END AS words "
    "FROM events) GROUP BY ALL",
    "met_02_loss_state": _sql(
        "SELECT run_id, count(*) FILTER (has_loss) AS with_loss, count(*) FILTER (bad) AS invalid FROM losses GROUP BY run_id", False
    ),
    "met_03_canonical_losses": _sql("SELECT run_id, seq, train, val FROM losses", False),
    "met_04_merged_epochs": _sql(
        "SELECT run_id, seq, epoch, step, lines, last_seq, sources, CAST(CASE WHEN timing THEN 1 ELSE 0 END + CASE WHEN bad THEN 1 ELSE 0 END "
        "+ CASE WHEN good_train IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN val IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_metrics FROM merged",
        False,
    ),
    "met_05_nan": _found_sql("f_nan"),
    "met_06_divergence": _found_sql("f_div"),
    "met_07_plateau": _found_sql("f_pla"),
    "met_08_overfitting": _found_sql("f_ovr"),
    "met_09_all_findings": _found_sql("f_nan", "f_div", "f_pla", "f_ovr"),
    "met_10_follow": _prefix_sql(BATCHES),
    "drf_17_windowed_drift": f"""WITH r AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-08 00:00:00'),
  n AS (SELECT 'value' AS feature, value AS v, ts FROM events UNION ALL SELECT 'user_id', user_id, ts FROM events),
  d AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, [{_TENTHS}]))) AS d FROM n WHERE ts < TIMESTAMP '2024-01-08 00:00:00' GROUP BY feature),
  b AS (SELECT feature, i AS bin, len(d) - 1 AS k, d[i] - CASE WHEN i = 1 THEN 1e-9 ELSE 0 END AS lo, d[i + 1] + CASE WHEN i = len(d) - 1 THEN 1e-9 ELSE 0 END AS hi
    FROM d, unnest(range(1, len(d))) AS u(i)),
  h AS (SELECT n.feature, bin, k, CAST(ts AS DATE) AS day, ts < TIMESTAMP '2024-01-08 00:00:00' AS early FROM n JOIN b ON b.feature = n.feature AND v >= lo AND (v < hi OR (bin = k AND v = hi))),
  ref AS (SELECT feature, bin, count(*) AS ref FROM h WHERE early GROUP BY feature, bin),
  days AS (SELECT feature, CAST(ts AS DATE) AS day, count(*) AS cur_rows FROM n GROUP BY ALL),
  g AS (SELECT days.feature, day, cur_rows, b.bin, b.k, coalesce(ref, 0) AS ref, (SELECT count(*) FROM h WHERE h.feature = days.feature AND h.day = days.day AND h.bin = b.bin) AS cur
    FROM days JOIN b USING (feature) LEFT JOIN ref ON ref.feature = b.feature AND ref.bin = b.bin),
  s AS (SELECT *, ref / sum(ref) OVER w AS rs, cur / sum(cur) OVER w AS cs, sum(ref) OVER w AS rt FROM g WINDOW w AS (PARTITION BY feature, day)),
  p AS (SELECT feature, day, any_value(cur_rows) AS cur_rows, any_value(k) AS k, any_value(rt) AS rt, greatest(0, sum(((CASE WHEN cs = 0 THEN 1e-6 ELSE cs END) - (CASE WHEN rs = 0 THEN 1e-6 ELSE rs END))
    * ln((CASE WHEN cs = 0 THEN 1e-6 ELSE cs END) / (CASE WHEN rs = 0 THEN 1e-6 ELSE rs END)))) AS psi FROM s GROUP BY feature, day),
  x AS (SELECT *, greatest(0, psi - (k - 1) * (1.0::DOUBLE / rt + 1.0::DOUBLE / cur_rows)) AS excess FROM p)
  SELECT CAST(day AS TIMESTAMP) AS window_start, feature, cur_rows, ROUND(psi, 6) AS psi, ROUND(excess, 6) AS psi_excess,
    CASE WHEN excess < 0.1 THEN 'stable' WHEN excess < 0.2 THEN 'moderate' ELSE 'major' END AS severity FROM x""",
    "met_11_latency": with_inputs(
        "SELECT event_type, count(*) AS calls, ROUND(avg(seconds), 6) AS mean_s, ROUND(stddev_samp(seconds), 6) AS std_s, "
        "ROUND(avg(CASE WHEN retried THEN 1 ELSE 0 END), 6) AS retry_rate, ROUND(count(*) * 0.008::DOUBLE, 6) AS cost, "
        "ROUND(quantile_cont(seconds, 0.5), 6) AS p50_s, ROUND(quantile_cont(seconds, 0.99), 6) AS p99_s FROM c GROUP BY event_type",
        c=CALLS,
    ),
}
_LINE_NO = "(SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no FROM events)"
ORACLES["src_06_read_lines"] = (
    f"SELECT run_id, line_no AS seq, epoch, step, metric, value FROM ({ORACLES['src_06_log_lines']}) JOIN {_LINE_NO} ON event_id = seq"
)
_NUMBERS, _, _SHOWN = ORACLES["drf_17_windowed_drift"].rpartition("SELECT CAST(day AS TIMESTAMP)")
ORACLES["drf_17_stream"] = (
    _NUMBERS.rstrip()
    + """,
  lev AS (SELECT event_type AS l, count(*) AS ref FROM r GROUP BY 1),
  tdays AS (SELECT CAST(ts AS DATE) AS day, count(*) AS cur_rows FROM events GROUP BY 1),
  tg AS (SELECT day, cur_rows, ref, (SELECT count(*) FROM events WHERE CAST(ts AS DATE) = day AND event_type = l) AS cur FROM tdays, lev),
  ts_ AS (SELECT *, ref / sum(ref) OVER w AS rs, cur / sum(cur) OVER w AS cs, sum(ref) OVER w AS rt, count(*) OVER w AS k FROM tg WINDOW w AS (PARTITION BY day)),
  tp AS (SELECT 'event_type' AS feature, day, any_value(cur_rows) AS cur_rows, any_value(k) + 1 AS k, any_value(rt) AS rt, greatest(0, sum(((CASE WHEN cs = 0 THEN 1e-6 ELSE cs END) - rs)
    * ln((CASE WHEN cs = 0 THEN 1e-6 ELSE cs END) / rs))) AS psi FROM ts_ GROUP BY day),
  xs AS (SELECT feature, day, cur_rows, psi, excess FROM x UNION ALL SELECT feature, day, cur_rows, psi,
    greatest(0, psi - (k - 1) * (1.0::DOUBLE / rt + 1.0::DOUBLE / cur_rows)) FROM tp)
  SELECT CAST(day AS TIMESTAMP)"""
    + _SHOWN.replace("FROM x", "FROM xs")
)
