from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowforge.operators import evaluate as ev
from rowforge.operators import health


def checks(spark, *states):
    rows = [(f"c{i}", s, f"m{i}", i) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "name string, status string, message string, timestamp int")


@pytest.mark.parametrize(
    "states, status, message",
    [
        (["healthy", "healthy"], "healthy", "All systems operational"),
        (["healthy", "degraded", "degraded"], "degraded", "Service degraded: 2 warnings"),
        (["degraded", "unhealthy", "lost"], "unhealthy", "Service unhealthy: 2 critical issues"),
    ],
)
def test_worst_status_wins(spark, states, status, message):
    row = health.status_rollup(checks(spark, *states)).first()
    assert (row["status"], row["message"], row["total_checks"]) == (status, message, len(states))


def test_startup_gate(spark):
    rows = [
        ("model_files", "unhealthy", "old", 1),
        ("model_files", "unhealthy", "no file", 2),
        ("ml_models", "unhealthy", "no model", 1),
        ("system_resources", "unhealthy", "cpu", 1),
        ("preprocessor", "degraded", "stats", 1),
    ]
    df = spark.createDataFrame(rows, "name string, status string, message string, timestamp int")
    with pytest.raises(health.StartupError, match="ml_models: no model; model_files: no file"):
        health.startup_gate(df)
    assert health.startup_gate(df.where("status <> 'unhealthy'")).count() == 0


def test_resource_limits_are_strict(spark):
    rows = [
        (80.0, 85.0, 90.0, "healthy"),
        (80.1, 0.0, 0.0, "degraded"),
        (0.0, 95.0, 0.0, "degraded"),
        (0.0, 95.1, 0.0, "unhealthy"),
        (0.0, 0.0, 98.0, "degraded"),
        (95.1, 0.0, 98.1, "unhealthy"),
    ]
    df = spark.createDataFrame(rows, "c double, m double, d double, expected string")
    for row in health.resource_severity(df, "c", "m", "d").collect():
        assert row["status"] == row["expected"]


def test_required_statistics(spark):
    stats = spark.createDataFrame([("age_median",), ("other",)], "name string")
    row = health.check_prep_state(spark, stats, ["age_median", "embarked_mode", "fare_median"]).first()
    assert tuple(row) == ("degraded", 2, "embarked_mode,fare_median")
    row = health.check_prep_state(spark, stats, ["age_median"]).first()
    assert tuple(row) == ("healthy", 0, "")


@pytest.mark.parametrize(
    "code, status",
    [("VALIDATION_ERROR", 400), ("EXTERNAL_SERVICE_ERROR", 502), ("BUSINESS_LOGIC_ERROR", 422), ("?", 500), (None, 500)],
)
def test_error_status(spark, code, status):
    df = spark.createDataFrame([(code,)], "c string")
    assert df.select(health.error_status(F.col("c"))).first()[0] == status


def test_field_errors(spark):
    rows = [([(["body", "age"], "bad"), (["body", "age"], "old"), (["q"], None)],), ([],)]
    df = spark.createDataFrame(rows, "errors array<struct<loc:array<string>,msg:string>>")
    found = [r[0] for r in df.select(health.field_errors(F.col("errors"))).collect()]
    assert found == [{"body.age": ["bad", "old"], "q": ["Invalid value"]}, {}]


def test_confusion_keeps_empty_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    rows = ev.confusion(df, "y", "p").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 0), (1, 0, 0)]


def test_report_with_a_class_that_is_only_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 0), (0, 0)], "y int, p int")
    rows = {r["label"]: r for r in ev.classification_report(df, "y", "p").collect()}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["support"]) == (0.0, 0.0, 0)
    assert (rows["0"]["precision"], rows["0"]["recall"]) == (1.0, 0.75)
    assert rows["macro avg"]["recall"] == 0.375 and rows["weighted avg"]["recall"] == 0.75


def test_best_model_prefers_the_ensemble(spark):
    table = [("decision_tree", 0.8), ("logistic_regression", 0.8), ("ensemble", 0.8)]
    df = spark.createDataFrame(table, "model string, accuracy double")
    assert ev.best_model(df).first()["model"] == "ensemble"
    assert ev.best_model(df.where("model <> 'ensemble'")).first()["model"] == "logistic_regression"


def test_accuracy_gate(spark):
    df = spark.createDataFrame([("a", 0.7), ("b", 0.69)], "model string, accuracy double")
    assert sorted(tuple(r) for r in ev.accuracy_gate(df).collect()) == [
        ("a", False, "degraded"),
        ("b", True, "degraded"),
    ]
    assert ev.accuracy_gate(df.where("model = 'a'")).first()["status"] == "healthy"


def test_pairs_are_matched_by_id(spark):
    truth = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, y int")
    guess = spark.createDataFrame([(3, 0), (2, 1)], "id int, p int")
    pairs = ev.pair_label_prediction(truth, guess, "id", "y", "p").collect()
    assert sorted(tuple(r) for r in pairs) == [(2, 1, 1), (3, 1, 0)]
