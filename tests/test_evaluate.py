import math

import pytest

from tablegauge.operators import evaluate as E


def _rows(spark, rows, schema="y_true int, y_pred int, y_prob double"):
    return E.binary_rows(E.predictions(spark.createDataFrame(rows, schema)))


def test_auc_ignores_row_order_and_counts_ties_half(spark):
    assert E.auc(_rows(spark, [(1, 1, 0.5), (0, 0, 0.5), (1, 0, 0.5)])).first().auc == 0.5
    good = [(0, 0, 0.1), (1, 1, 0.9), (0, 0, 0.2), (1, 1, 0.8)]
    assert E.auc(_rows(spark, good)).first().auc == 1.0
    assert E.auc(_rows(spark, good[::-1])).first().auc == 1.0


def test_auc_of_one_class_is_nan(spark):
    df = spark.createDataFrame([(1, 1, 0.3), (1, 0, 0.6)], "y int, p int, y_prob double")
    assert math.isnan(E.auc(df).first().auc)


@pytest.mark.parametrize(
    "rows, positive",
    [
        ([("yes", "yes", 0.1), ("no", "no", 0.9), ("no", "no", 0.8)], "no"),
        ([("yes", "yes", 0.9), ("no", "no", 0.1), ("yes", "yes", 0.7)], "yes"),
    ],
)
def test_positive_label_is_the_one_the_scores_mean(spark, rows, positive):
    pred = E.predictions(spark.createDataFrame(rows, "label string, pred string, prob double"))
    assert E.binary_labels(pred).first().positive == positive


def test_positive_label_by_name_then_minority(spark):
    named = spark.createDataFrame([("neg", "pos"), ("neg", "neg"), ("pos", "neg"), ("pos", "pos"), ("pos", "pos")], "y_true string, y_pred string")
    assert E.binary_labels(E.predictions(named)).first().positive == "pos"
    rare = spark.createDataFrame([("stay", "go"), ("stay", "stay"), ("go", "stay")], "y_true string, y_pred string")
    assert E.binary_labels(E.predictions(rare)).first().positive == "go"


def test_metrics_and_empty_denominators(spark):
    row = E.binary_metrics(_rows(spark, [(1, 0, 0.1), (0, 0, 0.2)])).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (0.5, 0.0, 0.0, 0.0)


def test_warnings(spark):
    inverted = _rows(spark, [(1, 1, 0.1), (0, 1, 0.9), (1, 0, 0.2), (0, 0, 0.8)] * 20)
    assert "auc_below_half" in {r.rule for r in E.binary_warnings(E.binary_facts(inverted)).collect()}
    perfect = _rows(spark, [(1, 1, 0.9), (0, 0, 0.1)] * 30)
    assert {r.rule for r in E.binary_warnings(E.binary_facts(perfect)).collect()} == {"too_good_to_be_true"}
    assert E.binary_warnings(E.binary_facts(_rows(spark, [(1, 1, 0.9), (0, 0, 0.1)]))).count() == 0


def test_multiclass_union_of_labels(spark):
    pred = E.predictions(spark.createDataFrame([("a", "a"), ("b", "c"), ("b", "b")], "y_true string, y_pred string"))
    cells = E.class_cells(pred)
    by = {r.label: r for r in E.per_class(cells).collect()}
    assert by["c"].support == 0 and by["c"].f1 == 0 and by["b"].recall == 0.5
    assert E.dense_confusion(cells).count() == 9
    assert [r.task for r in E.infer_task(pred).collect()] == ["binary_classification"]


def test_regression(spark):
    pred = E.predictions(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0), (5.0, float("nan"))], "y_true double, y_pred double"))
    facts = E.regression_facts(E.residual_rows(pred)).first()
    assert facts["count"] == 3 and facts.mae == pytest.approx(0.5) and facts.r2 == pytest.approx(1 - 1.25 / (14 / 3))
    flat = E.predictions(spark.createDataFrame([(1.0, 1.5), (1.0, 2.0)], "y_true double, y_pred double"))
    assert E.regression_facts(E.residual_rows(flat)).first().r2 == 0.0
