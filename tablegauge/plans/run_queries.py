"""Registered run-history queries: a user is a run, 1500 events a history row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablegauge.operators import runs as R
from tablegauge.plans.inputs import derive, table, with_inputs
from tablegauge.plans.rounding import rounded

METRICS = """
SELECT user_id AS run_id, CAST(floor(event_id / 1500) AS BIGINT) AS seq,
  CASE event_type WHEN 'purchase' THEN 'Accuracy' WHEN 'signup' THEN 'val_loss' WHEN 'error' THEN 'test-wer'
    WHEN 'click' THEN 'latency' ELSE 'epoch' END AS metric, round(avg(value), 4) AS value
FROM {events} GROUP BY 1, 2, 3"""
CONFIG = """
SELECT user_id AS run_id, key, value FROM (
  SELECT user_id, 'lr' AS key, CASE user_id % 4 WHEN 0 THEN '0.1' WHEN 1 THEN '0.01' WHEN 2 THEN '0.001' ELSE '0.5' END AS value,
    count(*) AS n FROM {events} GROUP BY user_id
  UNION ALL SELECT user_id, 'batch_size', CAST(16 * (1 + user_id % 5) AS STRING), count(*) FROM {events} GROUP BY user_id
  UNION ALL SELECT user_id, 'events', CAST(count(*) AS STRING), count(*) FROM {events} GROUP BY user_id
  UNION ALL SELECT user_id, 'optimizer', CASE WHEN user_id % 3 = 0 THEN 'adam' ELSE 'sgd' END, count(*) FROM {events} GROUP BY user_id
  UNION ALL SELECT user_id, 'amp', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, count(*) FROM {events} GROUP BY user_id
  UNION ALL SELECT user_id, 'shift', CAST(round(sum(value) / 100 - 120, 2) AS STRING), count(*) FROM {events} GROUP BY user_id
  UNION ALL SELECT user_id, 'dropout', '0.5', count(*) FROM {events} WHERE user_id % 9 = 0 GROUP BY user_id) AS t"""
PAIRS = "SELECT DISTINCT user_id AS a, user_id + 1 AS b FROM {events}"


def config(spark, folder):
    """The settings of the runs, ``shift`` added up in the order of the events and rounded as a scaled whole number.

    A sum of doubles depends on its order: where it ends in half a cent, rows in any other order give another text.
    """
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = table(spark, folder, "events").select("user_id", "event_id", F.sum("value").over(before).alias("total"))
    total = sums.groupBy(F.col("user_id").alias("run_id")).agg(F.max_by("total", "event_id").alias("total"))
    shift = F.round((F.col("total") / 100 - 120) * 100) / 100
    shifts = total.select("run_id", F.lit("shift").alias("key"), shift.cast("string").alias("value"))
    return derive(spark, folder, CONFIG).where("key <> 'shift'").unionByName(shifts)


def finals(spark, folder):
    return R.final_metrics(derive(spark, folder, METRICS))


def compared(spark, folder):
    return R.metric_comparison(derive(spark, folder, PAIRS), finals(spark, folder))


def scored(spark, folder, metric="accuracy"):
    return R.score_runs(finals(spark, folder), metric)


def ranked(spark, folder, direction):
    return R.sensitivity(scored(spark, folder), config(spark, folder), direction)


def _suggest(spark, folder, direction):
    best = R.leaderboard(scored(spark, folder), 1, direction).select("run_id")
    leader = config(spark, folder).join(best, "run_id", "left_semi")
    return R.suggestions(ranked(spark, folder, direction), leader, 3)


_FINAL = """final AS (SELECT run_id, seq, metric, value FROM m WHERE seq = (SELECT max(seq) FROM m x WHERE x.run_id = m.run_id))"""
_BETTER = """CASE WHEN metric IN ('val_loss', 'test-wer') THEN CASE WHEN av < bv THEN 'a' WHEN bv < av THEN 'b' ELSE 'tie' END
  WHEN metric = 'Accuracy' THEN CASE WHEN av > bv THEN 'a' WHEN bv > av THEN 'b' ELSE 'tie' END END"""
_CMP = f"""cmp AS (SELECT p.a, p.b, x.metric, x.value AS av, y.value AS bv FROM pairs p JOIN final x ON x.run_id = p.a
  JOIN final y ON y.run_id = p.b AND y.metric = x.metric WHERE x.metric <> 'epoch'),
judged AS (SELECT *, {_BETTER} AS better FROM cmp)"""
_SCORED = "scored AS (SELECT run_id, value AS score FROM final WHERE metric = 'Accuracy')"


def _rank(x, part=""):
    over = f"PARTITION BY {part} " if part else ""
    same = f"{part}, {x}" if part else x
    return f"(rank() OVER ({over}ORDER BY {x}) + (count(*) OVER (PARTITION BY {same}) - 1) / 2)"


def _sens(direction):
    sign = "" if direction == "max" else "-"
    return f"""sr AS (SELECT run_id, {sign}{_rank('score')} AS rs FROM scored),
st AS (SELECT key, run_id, TRY_CAST(value AS DOUBLE) AS num, rs FROM c JOIN sr USING (run_id)
  WHERE key NOT IN ('optimizer', 'amp')),
rk AS (SELECT *, {_rank('num', 'key')} AS rn FROM st),
sens AS (SELECT key, 'numeric' AS kind, count(*) AS observations, corr(rn, rs) AS correlation, min(num) AS min, max(num) AS max
  FROM rk GROUP BY key HAVING count(*) >= 3 AND min(num) < max(num)
  UNION ALL SELECT key, 'categorical_or_constant', count(*) FILTER (key NOT IN ('optimizer', 'amp')), NULL, NULL, NULL
  FROM c JOIN sr USING (run_id) WHERE key NOT IN (SELECT key FROM rk GROUP BY key HAVING count(*) >= 3 AND min(num) < max(num)) GROUP BY key)"""


def _sugg(direction):
    order = "DESC" if direction == "max" else "ASC"
    return f"""lead AS (SELECT key, value FROM c WHERE run_id = (SELECT run_id FROM scored ORDER BY score {order}, run_id LIMIT 1)),
top AS (SELECT *, row_number() OVER (ORDER BY round(abs(correlation), 9) DESC, key) AS place FROM sens
  WHERE kind = 'numeric' AND abs(correlation) >= 0.05),
plan AS (SELECT 1 AS no, 'exploit' AS move, 1 AS s, * FROM top WHERE place = 1 UNION ALL
  SELECT 2, 'explore', -1, * FROM top WHERE place = 1 UNION ALL SELECT 3, 'exploit', 1, * FROM top WHERE place = 2),
vals AS (SELECT p.*, l.value AS lv, coalesce(TRY_CAST(l.value AS DOUBLE), p.min) AS now, sign(correlation) * s AS dir
  FROM plan p LEFT JOIN lead l USING (key)),
raw AS (SELECT *, min > 0 AND now > 0 AS mult, greatest(max - min, abs(now) * 0.5, 1e-6) AS span,
  CASE WHEN key = 'lr' THEN 1e-7 END AS slo, CASE WHEN key = 'lr' THEN 10.0 END AS shi FROM vals),
clamped AS (SELECT *, greatest(greatest(CASE WHEN mult THEN min / 10 ELSE min - span END, slo),
  least(least(CASE WHEN mult THEN max * 10 ELSE max + span END, shi),
   CASE WHEN mult THEN now * pow(10, dir * 0.5) ELSE now + dir * 0.5 * span END)) AS v FROM raw)"""


def _sql(body, *ctes, **inputs):
    return with_inputs("", **inputs).rstrip() + "".join(", " + c for c in ctes) + " " + body


_SENS_COLS = "key, kind, observations, ROUND(correlation, 6) AS correlation, ROUND(min, 6) AS min, ROUND(max, 6) AS max"
_SUGG_COLS = (
    "SELECT CAST(no AS INTEGER) AS suggestion, move, key, ROUND(correlation, 6) AS correlation, ROUND(now, 6) AS leader_num, "
    "ROUND(CASE WHEN regexp_full_match(lv, '\\s*[-+]?\\d+\\s*') THEN round_even(v, 0) ELSE v END, 6) AS value FROM clamped"
)

QUERIES = {
    "run_01_final_metrics": lambda s, f: finals(s, f),
    "run_02_config_diff": lambda s, f: R.config_diff(derive(s, f, PAIRS), config(s, f)),
    "run_03_metric_comparison": lambda s, f: rounded(compared(s, f).drop("better")),
    "run_04_better_side": lambda s, f: compared(s, f).select("a", "b", "metric", "better"),
    "run_05_verdict": lambda s, f: R.comparison_verdict(compared(s, f)),
    "run_06_scores": lambda s, f: scored(s, f),
    "run_06_skipped": lambda s, f: R.skipped_runs(derive(s, f, METRICS), scored(s, f)),
    "run_07_leaderboard": lambda s, f: R.leaderboard(scored(s, f), 10),
    "run_08_sensitivity": lambda s, f: rounded(ranked(s, f, "max")),
    "run_08_sensitivity_min": lambda s, f: rounded(ranked(s, f, "min")),
    "run_09_suggestions": lambda s, f: rounded(_suggest(s, f, "max")),
    "run_09_suggestions_min": lambda s, f: rounded(_suggest(s, f, "min")),
}
_M, _MC = {"m": METRICS}, {"m": METRICS, "c": CONFIG}
ORACLES = {
    "run_01_final_metrics": _sql("SELECT * FROM final", _FINAL, **_M),
    "run_02_config_diff": _sql(
        "SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, coalesce(x.key, y.key) AS key, x.value AS a_value, y.value AS b_value "
        "FROM (SELECT a, b, key, value FROM pairs JOIN c ON run_id = a) x FULL JOIN (SELECT a, b, key, value FROM pairs JOIN c ON run_id = b) y "
        "ON x.a = y.a AND x.b = y.b AND x.key = y.key WHERE x.value IS DISTINCT FROM y.value",
        pairs=PAIRS, c=CONFIG,
    ),
    "run_03_metric_comparison": _sql(
        "SELECT a, b, metric, av AS a_value, bv AS b_value, ROUND(bv - av, 6) AS delta FROM judged", _FINAL, _CMP, pairs=PAIRS, **_M
    ),
    "run_04_better_side": _sql("SELECT a, b, metric, better FROM judged", _FINAL, _CMP, pairs=PAIRS, **_M),
    "run_05_verdict": _sql(
        "SELECT *, CASE WHEN a_wins + b_wins = 0 THEN 'inconclusive' WHEN b_wins = 0 THEN 'a_better' WHEN a_wins = 0 THEN 'b_better' "
        "ELSE 'mixed' END AS verdict FROM (SELECT a, b, count(*) FILTER (better = 'a') AS a_wins, count(*) FILTER (better = 'b') AS b_wins, "
        "count(*) FILTER (better = 'tie') AS ties FROM judged GROUP BY a, b)",
        _FINAL, _CMP, pairs=PAIRS, **_M,
    ),
    "run_06_scores": _sql("SELECT * FROM scored", _FINAL, _SCORED, **_M),
    "run_06_skipped": _sql(
        "SELECT runs, scored, runs - scored AS skipped FROM (SELECT count(DISTINCT run_id) AS runs, (SELECT count(*) FROM scored) AS scored FROM m)",
        _FINAL, _SCORED, **_M,
    ),
    "run_07_leaderboard": _sql("SELECT * FROM scored ORDER BY score DESC, run_id LIMIT 10", _FINAL, _SCORED, **_M),
    "run_08_sensitivity": _sql(f"SELECT {_SENS_COLS} FROM sens", _FINAL, _SCORED, _sens("max"), **_MC),
    "run_08_sensitivity_min": _sql(f"SELECT {_SENS_COLS} FROM sens", _FINAL, _SCORED, _sens("min"), **_MC),
    "run_09_suggestions": _sql(_SUGG_COLS, _FINAL, _SCORED, _sens("max"), _sugg("max"), **_MC),
    "run_09_suggestions_min": _sql(_SUGG_COLS, _FINAL, _SCORED, _sens("min"), _sugg("min"), **_MC),
}
