"""Registered evaluation queries over predictions derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import evaluate as E
from tablegauge.operators import leakage as L
from tablegauge.plans import leakage_queries as K
from tablegauge.plans.inputs import derive, table, with_inputs
from tablegauge.plans.rounding import rounded

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_KEYS = ", ".join(KEYS)
BINARY = f"""
SELECT {_KEYS}, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  CASE WHEN l_discount * 10 >= 0.5 THEN 1 ELSE 0 END AS y_pred,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS y_prob
FROM {{lineitem}}"""
NAMED = f"""
SELECT {_KEYS}, CASE WHEN l_returnflag = 'R' THEN 'back' ELSE 'kept' END AS label,
  CASE WHEN l_returnflag = 'R' AND l_linenumber < 6 OR l_linenumber = 1 THEN 'back' ELSE 'kept' END AS pred,
  CASE WHEN l_returnflag = 'R' AND l_linenumber < 6 OR l_linenumber = 1 THEN 0.9 ELSE 0.2 END - l_tax AS score
FROM {{lineitem}}"""
LEAKY = f"""
SELECT {_KEYS}, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_pred,
  CASE WHEN l_returnflag = 'R' THEN 0.9 ELSE 0.1 END AS y_prob
FROM {{lineitem}}"""
_LEAKY_FEATURES = LEAKY.replace("FROM", ", l_quantity, l_returnflag, l_tax FROM")
CLASSES = f"""
SELECT {_KEYS}, l_returnflag AS y_true,
  CASE WHEN l_linestatus = 'F' AND l_linenumber < 4 THEN 'R' WHEN l_linenumber = 7 THEN 'Z'
       WHEN l_linenumber > 4 AND l_returnflag <> 'N' THEN l_returnflag ELSE 'A' END AS y_pred
FROM {{lineitem}}"""
PRICES = f"""
SELECT {_KEYS}, l_extendedprice AS y_true, l_quantity * 1500 AS y_pred FROM {{lineitem}}"""


BIASED = PRICES.replace("l_quantity * 1500", "l_quantity * 300")


def binary(spark, folder):
    return E.binary_rows(E.predictions(derive(spark, folder, BINARY), KEYS))


def named(spark, folder):
    return E.binary_rows(E.predictions(derive(spark, folder, NAMED), KEYS))


def leaky(spark, folder):
    return E.binary_rows(E.predictions(derive(spark, folder, LEAKY), KEYS))


def classes(spark, folder):
    return E.per_class(E.class_cells(E.predictions(derive(spark, folder, CLASSES), KEYS)))


def residuals(spark, folder):
    return E.residual_rows(E.predictions(derive(spark, folder, PRICES), KEYS))


def _small(spark, folder):
    """Quality labels against a not-toxic guess: no scores."""
    return E.binary_rows(E.predictions(table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred")), ["doc_id"]))


def _leak_evidence(spark, folder):
    """The smell of perfect predictions, then the strongest feature behind it."""
    facts = E.binary_facts(leaky(spark, folder))
    smell = E.smell_metric(E.TASKS[0], facts, E.binary_warnings(facts))
    if not smell.head(1):
        return smell.withColumn("feature", F.lit(None).cast("string"))
    frame = derive(spark, folder, _LEAKY_FEATURES)
    best = L.strongest(L.LeakageTables(frame.drop(*KEYS), "y_true", ["y_pred", "y_prob"]), 1)
    return smell.withColumn("feature", F.lit(None).cast("string")).unionByName(
        best.select(F.col("method").alias("metric"), F.col("correlation").alias("value"), "feature")
    )


H_BINARY = """
SELECT event_id, CASE WHEN event_type = 'purchase' OR value > 150 THEN 1 ELSE 0 END AS y_true,
  CASE WHEN value > 100 THEN 1 ELSE 0 END AS y_pred, CASE WHEN value > 100 THEN 0.9 ELSE value / 200 END AS y_prob FROM {events}"""
H_CLASSES = """
SELECT event_id, event_type AS y_true, CASE WHEN value > 60 THEN event_type WHEN event_id % 3 = 0 THEN 'click' ELSE 'view' END AS y_pred FROM {events}"""
H_PRICES = "SELECT event_id, value AS y_true, value * 0.9 + user_id / 50 AS y_pred FROM {events}"


def _holdout(spark, folder):
    """Stored predictions joined to the holdout by event, one score per task."""

    def split(sql):
        df = derive(spark, folder, sql)
        return df.drop("y_true"), df.select("event_id", "y_true")

    parts = [
        E.holdout_score(*split(sql), ["event_id"], task)
        for sql, task in ((H_BINARY, E.TASKS[0]), (H_CLASSES, E.TASKS[1]), (H_PRICES, E.TASKS[2]))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_ROWS = """rows AS (SELECT *, y_true AS y, y_pred AS p FROM input WHERE y_prob IS NOT NULL)"""
_METRICS = """CASE WHEN tp + fp + fn + tn = 0 THEN 0 ELSE ROUND((tp + tn) / (tp + fp + fn + tn), 4) END AS accuracy,
  ROUND(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision,
  ROUND(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
  ROUND(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 4) AS f1"""
_CONF = """count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp,
  count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn"""
_AUC = """auc AS (SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM (SELECT y,
  rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2 AS r FROM rows))"""
_SWEEP = "sweep AS (SELECT t AS threshold, " + _METRICS + """ FROM (SELECT t,
  count(*) FILTER (y = 1 AND y_prob >= t) AS tp, count(*) FILTER (y = 0 AND y_prob >= t) AS fp,
  count(*) FILTER (y = 1 AND y_prob < t) AS fn, count(*) FILTER (y = 0 AND y_prob < t) AS tn
  FROM rows, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9]::DOUBLE[]) AS u(t) GROUP BY t))"""
_CLASS = """labels AS (SELECT y_true AS label FROM input UNION SELECT y_pred FROM input),
counts AS (SELECT label, (SELECT count(*) FROM input WHERE y_true = label) AS support,
  (SELECT count(*) FROM input WHERE y_pred = label) AS predicted,
  (SELECT count(*) FROM input WHERE y_pred = label AND y_true = label) AS tp FROM labels),
scored AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS pre,
  CASE WHEN support = 0 THEN 0 ELSE tp / support END AS rec FROM counts),
cls AS (SELECT *, CASE WHEN pre + rec = 0 THEN 0 ELSE 2 * pre * rec / (pre + rec) END AS f1 FROM scored)"""
_RES = """res AS (SELECT *, y_true - y_pred AS e FROM input),
facts AS (SELECT count(*) AS n, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
  1 - sum(e * e) / (var_pop(y_true) * count(*)) AS r2, avg(e) AS mean, stddev_pop(e) AS std, min(e) AS lo, max(e) AS hi,
  max(y_true) - min(y_true) AS span FROM res)"""


def _sql(source, ctes, body):
    return with_inputs("", input=source).rstrip() + "".join(", " + c for c in ctes) + " " + body


_NAMED_SRC = NAMED.replace("AS label", "AS y_true").replace("AS pred,", "AS y_pred,").replace("AS score", "AS y_prob")
_NAMED_ROWS = """rows AS (SELECT * EXCLUDE (y_true, y_pred), CASE WHEN y_true = 'back' THEN 1 ELSE 0 END AS y,
  CASE WHEN y_pred = 'back' THEN 1 ELSE 0 END AS p FROM input)"""

QUERIES = {
    "evl_01_predictions": lambda s, f: E.predictions(derive(s, f, BINARY), KEYS),
    "evl_02_task": lambda s, f: E.infer_task(E.predictions(derive(s, f, BINARY)))
    .unionByName(E.infer_task(E.predictions(derive(s, f, CLASSES))))
    .unionByName(E.infer_task(E.predictions(derive(s, f, PRICES)))),
    "evl_03_positive_label": lambda s, f: E.binary_labels(E.predictions(derive(s, f, NAMED))).unionByName(
        E.binary_labels(E.predictions(derive(s, f, BINARY)))
    ),
    "evl_04_confusion": lambda s, f: E.confusion(binary(s, f)),
    "evl_05_metrics": lambda s, f: E.binary_metrics(named(s, f)),
    "evl_06_auc": lambda s, f: rounded(E.auc(binary(s, f)).unionByName(E.auc(named(s, f)))),
    "evl_07_threshold_sweep": lambda s, f: E.threshold_sweep(binary(s, f)),
    "evl_08_best_threshold": lambda s, f: E.best_threshold(E.threshold_sweep(named(s, f))),
    "evl_09_binary_warnings": lambda s, f: E.binary_warnings(E.binary_facts(leaky(s, f)))
    .withColumn("source", F.lit("leaky"))
    .unionByName(E.binary_warnings(E.binary_facts(binary(s, f))).withColumn("source", F.lit("binary"))),
    "evl_10_hard_examples": lambda s, f: rounded(E.binary_hard_examples(named(s, f), [*KEYS, "y", "p"], 20)),
    "evl_10_hard_examples_no_score": lambda s, f: E.binary_hard_examples(_small(s, f), ["doc_id"], 20).select(
        "doc_id", "y", "p", "error"
    ),
    "evl_11_per_class": lambda s, f: rounded(classes(s, f), 4),
    "evl_12_multiclass_metrics": lambda s, f: E.multiclass_metrics(classes(s, f)),
    "evl_13_dense_confusion": lambda s, f: E.dense_confusion(
        E.class_cells(E.predictions(derive(s, f, CLASSES)))
    ).orderBy(*E.label_order(F.col("t")), *E.label_order(F.col("p"))),
    "evl_14_multiclass_warnings": lambda s, f: E.multiclass_warnings(classes(s, f)),
    "evl_15_misclassified": lambda s, f: E.misclassified(
        E.predictions(derive(s, f, CLASSES), KEYS), [*KEYS, "y_true", "y_pred"], 20
    ),
    "evl_16_regression_metrics": lambda s, f: E.regression_metrics(E.regression_facts(residuals(s, f))),
    "evl_17_residual_summary": lambda s, f: E.residual_summary(E.regression_facts(residuals(s, f))),
    "evl_18_largest_residuals": lambda s, f: rounded(E.largest_residuals(residuals(s, f), [*KEYS, "y_true"], 20)),
    "evl_19_regression_warnings": lambda s, f: E.regression_warnings(
        E.regression_facts(E.residual_rows(E.predictions(derive(s, f, BIASED), KEYS)))
    ),
    "evl_20_holdout_score": lambda s, f: rounded(_holdout(s, f)),
    "lkg_09_smell_and_evidence": lambda s, f: rounded(_leak_evidence(s, f)),
}
ORACLES = {
    "evl_01_predictions": _sql(BINARY, [], "SELECT * FROM input WHERE y_prob IS NOT NULL"),
    "evl_02_task": with_inputs(
        " UNION ALL ".join(
            f"SELECT CASE WHEN {num} AND count(*) > 10 THEN 'regression' WHEN count(*) > 2 THEN 'multiclass_classification' "
            f"ELSE 'binary_classification' END AS task, count(*) AS levels FROM (SELECT DISTINCT y_true FROM {t})"
            for t, num in (("b", "true"), ("c", "false"), ("p", "true"))
        ),
        b=BINARY, c=CLASSES, p=PRICES,
    ),
    "evl_03_positive_label": _sql(
        _NAMED_SRC,
        ["agree AS (SELECT label, avg(CASE WHEN (y_pred = label) = (y_prob >= 0.5) THEN 1 ELSE 0 END) AS a FROM input, "
         "(SELECT DISTINCT y_true AS label FROM input) GROUP BY label)"],
        "SELECT (SELECT label FROM agree ORDER BY a DESC LIMIT 1) AS positive, "
        "(SELECT label FROM agree ORDER BY a LIMIT 1) AS negative UNION ALL SELECT '1', '0'",
    ),
    "evl_04_confusion": _sql(BINARY, [_ROWS], f"SELECT {_CONF} FROM rows"),
    "evl_05_metrics": _sql(_NAMED_SRC, [_NAMED_ROWS], f"SELECT {_METRICS} FROM (SELECT {_CONF} FROM rows)"),
    "evl_06_auc": _sql(BINARY, [_ROWS, _AUC], "SELECT ROUND(auc, 6) AS auc FROM auc UNION ALL SELECT * FROM ("
                       + _sql(_NAMED_SRC, [_NAMED_ROWS, _AUC], "SELECT ROUND(auc, 6) FROM auc") + ")"),
    "evl_07_threshold_sweep": _sql(BINARY, [_ROWS, _SWEEP], "SELECT * FROM sweep"),
    "evl_08_best_threshold": _sql(
        _NAMED_SRC, [_NAMED_ROWS, _SWEEP], "SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1"
    ),
    "evl_09_binary_warnings": _sql(
        BINARY, [_ROWS, _AUC, f"facts AS (SELECT {_METRICS}, rate, n FROM (SELECT {_CONF}, avg(y) AS rate, count(*) AS n FROM rows))"],
        "SELECT 'auc_below_half' AS rule, 'binary' AS source FROM auc WHERE ROUND(auc, 4) < 0.5 "
        "UNION ALL SELECT 'imbalance_inflates_accuracy', 'binary' FROM facts WHERE rate < 0.1 AND accuracy > 0.9 AND recall < 0.5 "
        "UNION ALL SELECT 'threshold_too_aggressive', 'binary' FROM facts WHERE precision < 0.2 AND recall > 0.7 "
        "UNION ALL SELECT 'threshold_too_conservative', 'binary' FROM facts WHERE recall < 0.2 AND precision > 0.7 "
        "UNION ALL SELECT 'too_good_to_be_true', 'leaky' FROM lineitem HAVING count(*) >= 50",
    ),
    "evl_10_hard_examples": _sql(
        _NAMED_SRC, [_NAMED_ROWS],
        f"SELECT {_KEYS}, y, p, ROUND(y_prob, 6) AS y_prob, ROUND(abs(y - y_prob), 6) AS error FROM rows "
        f"ORDER BY abs(y - y_prob) DESC, {_KEYS}, y, p LIMIT 20",
    ),
    "evl_10_hard_examples_no_score": "SELECT doc_id, quality AS y, 1 - toxic AS p, CASE WHEN quality <> 1 - toxic THEN 1.0 "
    "ELSE 0.0 END::DOUBLE AS error FROM labels ORDER BY error DESC, doc_id LIMIT 20",
    "evl_11_per_class": _sql(
        CLASSES, [_CLASS],
        "SELECT label, ROUND(pre, 4) AS precision, ROUND(rec, 4) AS recall, ROUND(f1, 4) AS f1, support, tp FROM cls",
    ),
    "evl_12_multiclass_metrics": _sql(
        CLASSES, [_CLASS],
        "SELECT ROUND(sum(tp) / sum(support), 4) AS accuracy, ROUND(avg(f1), 4) AS macro_f1, "
        "ROUND(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM cls",
    ),
    "evl_13_dense_confusion": _sql(
        CLASSES, [_CLASS],
        "SELECT a.label AS t, b.label AS p, (SELECT count(*) FROM input WHERE y_true = a.label AND y_pred = b.label) AS n "
        "FROM labels a, labels b",
    ),
    "evl_14_multiclass_warnings": _sql(
        CLASSES, [_CLASS],
        "SELECT 'weak_class' AS rule FROM cls HAVING count(*) FILTER (ROUND(f1, 4) < 0.3 AND support >= 5) > 0 UNION ALL "
        "SELECT 'too_good_to_be_true' FROM cls HAVING sum(support) >= 50 AND (ROUND(sum(tp) / sum(support), 4) > 0.99 "
        "OR bool_and(support >= 5 AND ROUND(f1, 4) > 0.99))",
    ),
    "evl_15_misclassified": _sql(
        CLASSES, [], f"SELECT * FROM input WHERE y_true <> y_pred ORDER BY {_KEYS}, y_true, y_pred LIMIT 20"
    ),
    "evl_16_regression_metrics": _sql(
        PRICES, [_RES], "SELECT ROUND(mae, 4) AS mae, ROUND(rmse, 4) AS rmse, ROUND(r2, 4) AS r2 FROM facts"
    ),
    "evl_17_residual_summary": _sql(
        PRICES, [_RES],
        "SELECT ROUND(mean, 4) AS mean, ROUND(std, 4) AS std, ROUND(lo, 4) AS min, ROUND(hi, 4) AS max, n AS count FROM facts",
    ),
    "evl_18_largest_residuals": _sql(
        PRICES, [_RES],
        f"SELECT {_KEYS}, ROUND(y_true, 6) AS y_true, ROUND(y_pred, 6) AS y_pred, ROUND(e, 6) AS residual FROM res "
        f"ORDER BY abs(e) DESC, {_KEYS}, y_true LIMIT 20",
    ),
    "evl_19_regression_warnings": _sql(
        BIASED, [_RES],
        "SELECT 'biased_residuals' AS rule FROM facts WHERE abs(mean) > 0.5 * std UNION ALL "
        "SELECT 'wide_residuals' FROM facts WHERE std / span > 0.5 UNION ALL "
        "SELECT 'too_good_to_be_true' FROM facts WHERE r2 > 0.999 AND n >= 50",
    ),
    "evl_20_holdout_score": "SELECT 'roc_auc' AS metric, ROUND(auc, 6) AS score FROM (" + _sql(H_BINARY, [_ROWS, _AUC], "SELECT * FROM auc")
    + ") UNION ALL SELECT 'macro_f1', ROUND(f, 6) FROM (" + _sql(H_CLASSES, [_CLASS], "SELECT avg(f1) AS f FROM cls")
    + ") UNION ALL SELECT 'r2', ROUND(r2, 6) FROM (" + _sql(H_PRICES, [_RES], "SELECT r2 FROM facts") + ")",
    "lkg_09_smell_and_evidence": "SELECT 'auc' AS metric, CAST(1.0 AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS feature "
    "FROM lineitem HAVING count(*) >= 50 UNION ALL SELECT method, correlation, feature FROM ("
    + K._sql(
        _LEAKY_FEATURES,
        [K._pairs(["l_quantity", "l_tax"], ["l_returnflag"], "y_true"), K._RANKS, K._PEARSON, K._SPEARMAN, K._BISERIAL],
        K._best(["pearson", "spearman", "rank_biserial"], 1),
    )
    + ")",
}
