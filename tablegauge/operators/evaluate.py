"""Evaluation of a predictions table: binary, multiclass and regression.

Binary metrics read counts per (score, class); multiclass metrics read counts per
(truth, prediction). Both are map-side aggregates, so the rows are scanned once
and a score shared by a third of the rows is one row downstream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.operators.order_stats import running_totals

# Column names that mark truth, prediction and score, best first.
TRUTH_NAMES = ("y_true", "label", "target", "actual", "gt", "true", "y")
PREDICTION_NAMES = ("y_pred", "pred", "prediction", "predicted")
SCORE_NAMES = ("y_prob", "prob", "score", "confidence", "proba")
# Label spellings of known polarity, and the default thresholds.
POSITIVE_LABELS = ("1", "yes", "y", "true", "t", "positive", "pos")
NEGATIVE_LABELS = ("0", "-1", "no", "n", "false", "f", "negative", "neg")
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8, 0.9)
TASKS = ("binary_classification", "multiclass_classification", "regression")


def resolve_columns(df: DataFrame, **given: str | None) -> dict[str, str | None]:
    """Truth, prediction and score columns: given names win, then the hint order."""
    lowered = {c.lower(): c for c in df.columns}
    hints = {"y_true": TRUTH_NAMES, "y_pred": PREDICTION_NAMES, "y_prob": SCORE_NAMES}
    found = {
        role: given.get(role) or next((lowered[h] for h in names if h in lowered), None)
        for role, names in hints.items()
    }
    if found["y_true"] is None:
        raise ValueError(f"no truth column among {df.columns}")
    if found["y_pred"] is None and found["y_prob"] is None:
        raise ValueError(f"no prediction column among {df.columns}")
    return found


def predictions(df: DataFrame, keys: Sequence[str] = (), **given: str | None) -> DataFrame:
    """(keys, y_true, y_pred, y_prob) with rows dropped that miss a used column."""
    roles = resolve_columns(df, **given)
    types = {f.name: f.dataType for f in df.schema.fields}
    used = {role: name for role, name in roles.items() if name is not None}
    picked = [
        (C.value_or_null(n, types[n]).try_cast("double") if r == "y_prob" else C.value_or_null(n, types[n])).alias(r)
        for r, n in used.items()
    ]
    return df.select(*[C.col(k) for k in keys], *picked).na.drop(subset=list(used))


def infer_task(pred: DataFrame) -> DataFrame:
    """One row with the task; the truth column decides before the scores do."""
    numeric = C.is_numeric({f.name: f.dataType for f in pred.schema.fields}["y_true"])
    score = F.col("y_prob") if "y_prob" in pred.columns else F.lit(None).cast("double")
    per_value = pred.groupBy("y_true").agg(
        F.bool_and(score.between(0, 1)).alias("in_unit"), F.count(score).alias("scores")
    )
    levels = F.count(F.lit(1))
    unit = F.coalesce(F.bool_and("in_unit"), F.lit(True)) & F.lit("y_prob" in pred.columns)
    task = (
        F.when(F.lit(numeric) & (levels > 10), TASKS[2])
        .when(levels > 2, TASKS[1])
        .when(levels == 2, TASKS[0])
        .when(unit, TASKS[0])
        .otherwise(TASKS[1])
    )
    return per_value.agg(task.alias("task"), levels.alias("levels"))


# ---------------------------------------------------------------- binary


def binary_labels(pred: DataFrame) -> DataFrame:
    """One row (positive, negative), both as text, for a truth of two labels."""
    types = {f.name: f.dataType.simpleString() for f in pred.schema.fields}
    has_pred, has_prob = "y_pred" in pred.columns, "y_prob" in pred.columns
    guess = F.col("y_pred").cast("string") if has_pred else F.lit(None).cast("string")
    score = F.col("y_prob") if has_prob else F.lit(None).cast("double")
    finite = score.isNotNull() & ~score.isin(float("inf"), float("-inf"))
    rows = pred.select(F.col("y_true").cast("string").alias("t"), guess.alias("p"), F.when(finite, score >= 0.5).alias("high"))
    ends = rows.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    low, high = ends.select("a").scalar(), ends.select("b").scalar()

    def agrees(label: Column) -> Column:
        return F.count_if(F.col("high").isNotNull() & (F.col("p").eqNullSafe(label) == F.col("high")))

    # counters of two labels, whatever is predicted
    row = rows.agg(
        F.min("t").alias("a"),
        F.max("t").alias("b"),
        F.count_if((F.col("t") != low) & (F.col("t") != high)).alias("others"),
        F.count_if(F.col("t") == low).alias("a_rows"),
        F.count_if(F.col("t") == high).alias("b_rows"),
        F.count("high").alias("scored"),
        agrees(low).alias("a_agrees"),
        agrees(high).alias("b_agrees"),
    )

    def agreement(side: str) -> Column:
        return F.try_divide(F.col(f"{side}_agrees"), F.col("scored"))

    a, b = F.col("a"), F.col("b")
    numeric = types["y_true"] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    zero_one = F.lit(numeric) & (a.try_cast("double") == 0) & (b.try_cast("double") == 1)
    by_score = F.greatest(agreement("a"), agreement("b")) > 0.5 if has_pred and has_prob else F.lit(False)
    a_name, b_name = F.lower(F.trim(a)), F.lower(F.trim(b))
    positive = (
        F.when(zero_one | F.lit(types["y_true"] == "boolean"), b)
        .when(by_score, F.when(agreement("b") > agreement("a"), b).otherwise(a))
        .when(a_name.isin(*POSITIVE_LABELS) & b_name.isin(*NEGATIVE_LABELS), a)
        .when(b_name.isin(*POSITIVE_LABELS) & a_name.isin(*NEGATIVE_LABELS), b)
        .when(F.col("b_rows") < F.col("a_rows"), b)
        .otherwise(a)
    )
    return row.where("a < b AND others = 0").select(positive.alias("positive"), "a", "b").select(
        "positive", F.when(F.col("positive") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("negative")
    )


def binary_rows(pred: DataFrame) -> DataFrame:
    """Truth and prediction as 0/1 against the positive label, score kept."""
    positive = binary_labels(pred).select("positive").scalar()
    truth = (F.col("y_true").cast("string") == positive).cast("int")
    if "y_pred" in pred.columns:
        guess = (F.col("y_pred").cast("string") == positive).cast("int")
    else:
        guess = (F.col("y_prob") >= 0.5).cast("int")
    rest = [c for c in pred.columns if c not in ("y_true", "y_pred", "y_prob")]
    score = F.col("y_prob") if "y_prob" in pred.columns else F.lit(None).cast("double")
    return pred.select(*rest, truth.alias("y"), guess.alias("p"), score.alias("y_prob"))


def confusion(rows: DataFrame) -> DataFrame:
    y, p = F.col("y") == 1, F.col("p") == 1
    return rows.agg(
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    )


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Accuracy, precision, recall and F1 to four digits, 0 on empty denominators."""
    precision, recall = C.ratio(tp, tp + fp), C.ratio(tp, tp + fn)
    return [
        F.round(C.ratio(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(C.ratio(2 * precision * recall, precision + recall), 4).alias("f1"),
    ]


def binary_metrics(rows: DataFrame) -> DataFrame:
    return confusion(rows).select(*metric_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def score_counts(rows: DataFrame) -> DataFrame:
    return rows.where("y_prob IS NOT NULL").groupBy("y_prob").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    )


def auc(rows: DataFrame) -> DataFrame:
    """Tie-correct ROC AUC; NaN when one class is absent."""
    totals = running_totals(score_counts(rows), [], "y_prob", ["pos", "neg"])
    wins = F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2.0)
    one = totals.agg(
        F.sum(wins).alias("wins"),
        F.max("total_pos").cast("double").alias("p"),
        F.max("total_neg").cast("double").alias("n"),
    )
    value = F.coalesce(F.try_divide(F.col("wins"), F.col("p") * F.col("n")), F.lit(float("nan")))
    return one.select(value.alias("auc"))


def threshold_sweep(rows: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Metrics at every threshold, from one aggregate with two sums per threshold."""
    aggs = [F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")]
    for i, t in enumerate(thresholds):
        above = F.col("y_prob") >= float(t)
        aggs.append(F.count_if(above & (F.col("y") == 1)).alias(f"tp{i}"))
        aggs.append(F.count_if(above & (F.col("y") == 0)).alias(f"fp{i}"))
    points = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
            for i, t in enumerate(thresholds)
        ]
    )
    swept = rows.where("y_prob IS NOT NULL").agg(*aggs).select("pos", "neg", F.explode(points).alias("s"))
    tp, fp = F.col("s.tp"), F.col("s.fp")
    return swept.select("s.threshold", *metric_columns(tp, fp, F.col("pos") - tp, F.col("neg") - fp))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def _rules(row: DataFrame, rules: dict[str, Column]) -> DataFrame:
    fired = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull()
    )
    return row.select(F.explode(fired).alias("rule"))


def binary_facts(rows: DataFrame) -> DataFrame:
    """One row: the metrics, the AUC, the row count and the positive rate."""
    score = auc(rows).scalar()
    base = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("y").alias("positive_rate"),
        F.count_if((F.col("y") == 1) & (F.col("p") == 1)).alias("tp"),
        F.count_if((F.col("y") == 0) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("p") == 0)).alias("fn"),
        F.count_if((F.col("y") == 0) & (F.col("p") == 0)).alias("tn"),
    )
    counts = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return base.select("rows", "positive_rate", *metric_columns(*counts), F.round(score, 4).alias("auc"))


def binary_warnings(facts: DataFrame) -> DataFrame:
    acc, pre, rec = F.col("accuracy"), F.col("precision"), F.col("recall")
    score = F.nanvl("auc", F.lit(None).cast("double"))
    aggressive = (pre < 0.2) & (rec > 0.7)
    too_good = (score > 0.995) | (acc > 0.99) | ((pre >= 0.99) & (rec >= 0.99))
    return _rules(
        facts,
        {
            "auc_below_half": score < 0.5,
            "imbalance_inflates_accuracy": (F.col("positive_rate") < 0.1) & (acc > 0.9) & (rec < 0.5),
            "threshold_too_aggressive": aggressive,
            "threshold_too_conservative": ~aggressive & (rec < 0.2) & (pre > 0.7),
            "too_good_to_be_true": (F.col("rows") >= 50) & too_good,
        },
    )


def binary_hard_examples(rows: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Rows farthest from their truth; without scores, misclassified rows first."""
    by_score = F.abs(F.col("y") - F.col("y_prob"))
    error = F.coalesce(by_score, (F.col("y") != F.col("p")).cast("double"))
    return rows.withColumn("error", error).orderBy(F.desc("error"), *keys).limit(k)


# ---------------------------------------------------------------- multiclass


def class_cells(pred: DataFrame) -> DataFrame:
    return pred.groupBy(
        F.col("y_true").cast("string").alias("t"), F.col("y_pred").cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support over the union of both label sets."""
    sides = F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).alias("support"), F.col("n").alias("predicted"), F.lit(0).alias("tp")),
    )
    sums = cells.select(F.explode(sides).alias("s")).groupBy(F.col("s.label").alias("label")).agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")]
    )
    precision, recall = C.ratio(F.col("tp"), F.col("predicted")), C.ratio(F.col("tp"), F.col("support"))
    return sums.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        C.ratio(2 * precision * recall, precision + recall).alias("f1"),
        "support",
        "tp",
    )


def multiclass_metrics(classes: DataFrame) -> DataFrame:
    rows = F.sum("support")
    return classes.agg(
        F.round(C.ratio(F.sum("tp"), rows), 4).alias("accuracy"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.round(C.ratio(F.sum(F.col("f1") * F.col("support")), rows), 4).alias("weighted_f1"),
    )




def label_order(label: Column) -> tuple[Column, Column, Column]:
    """Sort keys of labels kept as text: numbers by value, then text."""
    number = label.try_cast("double")
    return number.isNull(), number, label


def dense_confusion(cells: DataFrame) -> DataFrame:
    """Every (truth, prediction) pair of labels with its count, zeros included.

    The label set is an array of one row, as long as a side of the matrix; the matrix is written row by row.
    ``cells`` alone holds what occurs.
    """
    labels = cells.agg(F.array_distinct(F.flatten(F.array(F.collect_set("t"), F.collect_set("p")))).alias("labels"))
    # the rows are dealt out before each is filled
    sides = labels.select("labels", F.explode("labels").alias("t")).repartition("t")
    grid = sides.select("t", F.explode("labels").alias("p"))
    return grid.join(cells, ["t", "p"], "left").select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def multiclass_warnings(classes: DataFrame) -> DataFrame:
    f1 = F.round("f1", 4)
    facts = classes.agg(
        F.sum("support").alias("rows"),
        F.count_if((f1 < 0.3) & (F.col("support") >= 5)).alias("weak"),
        F.bool_and((F.col("support") >= 5) & (f1 > 0.99)).alias("all_strong"),
        F.round(C.ratio(F.sum("tp"), F.sum("support")), 4).alias("accuracy"),
    )
    return _rules(
        facts,
        {
            "weak_class": F.col("weak") > 0,
            "too_good_to_be_true": (F.col("rows") >= 50) & ((F.col("accuracy") > 0.99) | F.col("all_strong")),
        },
    )


def misclassified(pred: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    wrong = pred.where(F.col("y_true").cast("string") != F.col("y_pred").cast("string"))
    return wrong.orderBy(*keys).limit(k)


# ---------------------------------------------------------------- regression


def residual_rows(pred: DataFrame) -> DataFrame:
    t, p = F.col("y_true").try_cast("double"), F.col("y_pred").try_cast("double")
    rest = [c for c in pred.columns if c not in ("y_true", "y_pred", "y_prob")]
    both = pred.select(*rest, t.alias("y_true"), p.alias("y_pred")).na.drop(subset=["y_true", "y_pred"])
    return both.withColumn("residual", F.col("y_true") - F.col("y_pred"))


def regression_facts(rows: DataFrame) -> DataFrame:
    """One row of unrounded error measures; the variance aggregates are stable."""
    e, n = F.col("residual"), F.count(F.lit(1))
    spread = F.var_pop("y_true") * n
    return rows.agg(
        n.alias("count"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.min("y_true") == F.max("y_true"), 0.0).otherwise(1 - F.try_divide(F.sum(e * e), spread)).alias("r2"),
        F.avg(e).alias("mean"),
        F.stddev_pop(e).alias("std"),
        F.min(e).alias("min"),
        F.max(e).alias("max"),
        (F.max("y_true") - F.min("y_true")).alias("target_range"),
    )


def regression_metrics(facts: DataFrame) -> DataFrame:
    return facts.select(*[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")])


def residual_summary(facts: DataFrame) -> DataFrame:
    return facts.select(*[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], "count")


def largest_residuals(rows: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    return rows.orderBy(F.abs("residual").desc(), *keys).limit(k)


def regression_warnings(facts: DataFrame) -> DataFrame:
    spread = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return _rules(
        facts,
        {
            "biased_residuals": F.abs("mean") > 0.5 * spread,
            "wide_residuals": (F.col("target_range") != 0) & (F.try_divide(spread, F.col("target_range")) > 0.5),
            "too_good_to_be_true": (F.col("count") >= 50) & (F.col("r2") > 0.999),
        },
    )


# ---------------------------------------------------------------- smell and holdout


def smell_metric(task: str, metrics: DataFrame, warnings: DataFrame) -> DataFrame:
    """(metric, value) when the too-good warning fired, else no row."""
    name = {TASKS[0]: "auc", TASKS[1]: "accuracy", TASKS[2]: "r2"}[task]
    fired = warnings.where("rule = 'too_good_to_be_true'").agg(F.count(F.lit(1))).scalar()
    value = F.col(name)
    label = F.lit(name)
    if task == TASKS[0]:
        label = F.when(value.isNull(), "accuracy").otherwise("auc")
        value = F.coalesce(value, F.col("accuracy"))
    return metrics.where(fired > 0).select(label.alias("metric"), value.alias("value"))


def holdout_score(stored: DataFrame, holdout: DataFrame, keys: Sequence[str], task: str) -> DataFrame:
    """(metric, score) of stored predictions joined to holdout truths by row key."""
    joined = stored.join(holdout, list(keys))
    if task == TASKS[0]:
        return auc(binary_rows(predictions(joined, keys))).select(
            F.lit("roc_auc").alias("metric"), F.col("auc").alias("score")
        )
    if task == TASKS[1]:
        classes = per_class(class_cells(predictions(joined, keys)))
        return classes.agg(F.avg("f1").alias("score")).select(F.lit("macro_f1").alias("metric"), "score")
    facts = regression_facts(residual_rows(predictions(joined, keys)))
    return facts.select(F.lit("r2").alias("metric"), F.col("r2").alias("score"))
