from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.operators.models import FALLBACK_ACCURACY, ModelPair, load_accuracies
from rowforge.operators.preparation import NotFittedError, Preparation
from rowforge.operators.training import TrainingRun, split_rows, train
from rowforge.plans.common import held_out, trained


@pytest.fixture(scope="module")
def fitted(tables):
    run = trained(tables)
    return run.preparation, run.models


def test_feature_order(fitted):
    assert fitted[0].feature_columns == [
        "pclass",
        "sex",
        "age",
        "sibsp",
        "parch",
        "fare",
        "embarked",
        "family_size",
        "is_alone",
        "age_group",
    ]


def test_probabilities(tables, fitted):
    preparation, models = fitted
    rows = models.ensemble(preparation.transform(tables.passengers)).collect()
    for row in rows:
        low, high = sorted([row["lr_prob"], row["dt_prob"]])
        assert 0 <= low <= row["ensemble_prob"] <= high <= 1
        assert row["lr_label"] == int(row["lr_prob"] > 0.5)
        assert row["ensemble_label"] == int(row["ensemble_prob"] >= 0.5)


def test_logistic_is_the_optimum(tables, fitted):
    """Compare with Newton's method on the same penalised loss."""
    preparation, models = fitted
    rows = split_rows(tables.passengers).where("part = 'train'").drop("part")
    pdf = preparation.transform(rows).toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[preparation.feature_columns].to_numpy(float)])
    y = pdf["survived"].to_numpy(float)
    penalty = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - y) + penalty @ w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, gradient)
    found = np.array([models.logistic.intercept, *models.logistic.coefficients])
    assert np.allclose(1 / (1 + np.exp(-x @ found)), 1 / (1 + np.exp(-x @ w)), atol=2e-3)


def test_run_is_stored_and_fits_on_request_only_the_train_part(spark, tables, tmp_path):
    run = train(tables.passengers, fit_on="train")
    assert run.preparation.stats["rows"] == 1200.0
    assert trained(tables).preparation.stats["rows"] == 1500.0
    run.save(spark, str(tmp_path / "run"))
    again = TrainingRun.load(spark, str(tmp_path / "run"))
    assert again.accuracies == run.accuracies
    with pytest.raises(ValueError, match="fit_on"):
        train(tables.passengers, fit_on="test")


def test_better_than_the_majority(tables, fitted):
    preparation, models = fitted
    rows = held_out(tables, preparation)
    rate = rows.agg(F.avg("survived")).first()[0]
    found = {r["model"]: r["accuracy"] for r in models.evaluate(rows, "survived").collect()}
    assert set(found) == set(FALLBACK_ACCURACY)
    assert min(found.values()) > max(rate, 1 - rate)


def test_info(spark, fitted):
    info = {r["name"]: r["value"] for r in fitted[1].info(spark).collect()}
    assert info["tree_depth"] <= 10 and info["n_features"] == 10
    assert (info["coefficient_rows"], info["coefficient_columns"]) == (1, 10)
    assert info["accuracy_logistic_regression"] == 0.83


def test_save_and_load(spark, tables, fitted, tmp_path):
    preparation, models = fitted
    path = str(tmp_path / "models")
    with pytest.raises(FileNotFoundError):
        ModelPair.load(spark, path)
    assert load_accuracies(spark, path) == FALLBACK_ACCURACY
    rows = preparation.transform(tables.passengers)
    models.save(spark, path, models.evaluate(rows, "survived"))
    preparation.save(spark, path)
    again, state = ModelPair.load(spark, path), Preparation.load(spark, path)
    assert state.stats == preparation.stats and state.categories == preparation.categories
    columns = ["passenger_id", "lr_prob", "dt_prob"]
    before = sorted(models.predict_proba(rows).select(*columns).collect())
    after = again.predict_proba(state.transform(tables.passengers)).select(*columns)
    assert sorted(after.collect()) == before
    assert set(load_accuracies(spark, path)) == set(FALLBACK_ACCURACY)


def test_a_missing_feature_gives_no_score(spark, tables, fitted):
    preparation, models = fitted
    old = tables.passengers.limit(3).withColumn("age", F.lit(101.0))
    scored = models.score(preparation.transform(old)).select("score.ensemble_result.*")
    for row in scored.collect():
        assert tuple(row) == (None, None, None, None)
    with pytest.raises(Exception, match="age outside all bands"):
        preparation.transform(old, on_unbinned="error").collect()


def test_single_row_and_unfitted_use(spark, fitted):
    request = dict(pclass=1, sex="female", age=29.0, sibsp=0, parch=0, fare=211.3375, embarked="Z")
    row = fitted[0].single(spark, request).first()
    assert tuple(row) == (1, 0, 29.0, 0, 0, 211.3375, 0, 1, 1, 1)
    for call in (lambda p: p.single(spark, request), lambda p: p.save(spark, "x")):
        with pytest.raises(NotFittedError):
            call(Preparation())


def test_optional_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (0, None, 2.0)], "survived int, name string, fare double")
    prep = Preparation().fit(df)
    assert prep.feature_columns == ["fare"]
    assert [r["fare"] for r in prep.features(df).collect()] == [2.0, 2.0]


def test_all_null_category(spark):
    df = spark.createDataFrame([("male", None), ("female", None)], "sex string, embarked string")
    prep = Preparation().fit(df)
    assert prep.stats["embarked_mode"] is None
    stored = Preparation().fit(spark.createDataFrame([("male", "S")], df.schema))
    assert {r["embarked"] for r in stored.transform(df).collect()} == {0}
