"""Quality measures of binary and multi-class predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Order in which equal accuracies win, and the accuracy floor.
MODEL_PRIORITY = ["ensemble", "logistic_regression", "decision_tree"]
ACCURACY_FLOOR = 0.7


def pair_label_prediction(
    truth: DataFrame, predicted: DataFrame, id_col: str, label: str, prediction: str
) -> DataFrame:
    """Truth and prediction of the same row, matched by id and never by position."""
    return truth.select(id_col, F.col(label).alias("y_true")).join(
        predicted.select(id_col, F.col(prediction).alias("y_pred")), id_col
    )


def accuracy(y_true: Column, y_pred: Column) -> Column:
    """Share of correct predictions; a row without a prediction counts as wrong."""
    return F.avg(F.coalesce((y_true == y_pred).cast("int"), F.lit(0)))


def evaluate_predictors(
    df: DataFrame, label: str, predictions: dict[str, Column]
) -> DataFrame:
    """Accuracy of several predictors in one pass, as a long table."""
    one = df.agg(*[accuracy(F.col(label), p).alias(name) for name, p in predictions.items()])
    pairs = [
        F.struct(F.lit(name).alias("model"), F.col(name).alias("accuracy"))
        for name in predictions
    ]
    return one.select(F.inline(F.array(*pairs)))


def confusion(df: DataFrame, y_true: str, y_pred: str, labels: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows of counts per true label, with a zero for a cell that never occurs."""
    cells = df.agg(
        *[
            F.count_if((F.col(y_true) == t) & (F.col(y_pred) == p)).alias(f"c_{t}_{p}")
            for t in labels
            for p in labels
        ]
    )
    rows = [
        F.struct(
            F.lit(t).alias("actual"),
            *[F.col(f"c_{t}_{p}").alias(f"predicted_{p}") for p in labels],
        )
        for t in labels
    ]
    return cells.select(F.inline(F.array(*rows)))


def _ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Precision, recall, f1 and support per class, and their two averages.

    The rows are counted per pair of labels first; the rest works on these counts.
    """
    cells = df.groupBy(F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("t").alias("label"),
            F.col("n").alias("support"),
            none.alias("predicted"),
            hit.cast("long").alias("hits"),
        ),
        F.struct(
            F.col("p").alias("label"),
            none.alias("support"),
            F.col("n").alias("predicted"),
            none.alias("hits"),
        ),
    )
    per_class = (
        cells.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
        .withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn(
            "f1_score",
            _ratio(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
        )
    )
    measures = ["precision", "recall", "f1_score"]
    weight = F.sum("support")
    averages = per_class.agg(
        F.struct(
            F.lit("macro avg").alias("label"),
            *[F.avg(m).alias(m) for m in measures],
            weight.alias("support"),
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("label"),
            *[_ratio(F.sum(F.col(m) * F.col("support")), weight).alias(m) for m in measures],
            weight.alias("support"),
        ).alias("weighted"),
    ).select(F.inline(F.array("macro", "weighted")))
    classes = per_class.select(F.col("label").cast("string").alias("label"), *measures, "support")
    return classes.unionByName(averages)


def score_summary(df: DataFrame, first: Column, second: Column, joint: Column) -> DataFrame:
    """Mean probability per model and of the ensemble."""
    return df.agg(
        F.avg(first).alias("logistic_mean"),
        F.avg(second).alias("tree_mean"),
        F.avg(joint).alias("ensemble_mean"),
    )


def best_model(accuracies: DataFrame) -> DataFrame:
    """Model of the highest accuracy; equal ones in the fixed order."""
    rank = F.array_position(F.array(*[F.lit(m) for m in MODEL_PRIORITY]), F.col("model"))
    return accuracies.orderBy(F.col("accuracy").desc(), rank, "model").limit(1)


def accuracy_gate(accuracies: DataFrame, floor: float = ACCURACY_FLOOR) -> DataFrame:
    """Which models are under the floor; any of them degrades the common status."""
    low = F.col("accuracy") < floor
    # a few models, so the window over all of them is short
    any_low = F.coalesce(F.bool_or(low).over(Window.partitionBy()), F.lit(False))
    return accuracies.select(
        "model",
        low.alias("low"),
        F.when(any_low, "degraded").otherwise("healthy").alias("status"),
    )
