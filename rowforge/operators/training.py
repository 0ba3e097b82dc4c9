"""A whole training run: prepare, split, train both models, evaluate, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .models import SEED, TEST_SHARE, ModelPair, load_accuracies
from .preparation import LABEL, Preparation
from .split import stratified_split

ID = "passenger_id"


@dataclass
class TrainingRun:
    """Fitted preparation and models, and their accuracies on the held-out rows."""

    preparation: Preparation
    models: ModelPair
    accuracies: dict[str, float]

    def score(self, df: DataFrame, served: bool = True) -> DataFrame:
        """Score raw rows of a batch or a stream."""
        return self.models.score(self.preparation.transform(df), served)

    def save(self, spark: SparkSession, path: str) -> None:
        table = spark.createDataFrame(
            list(self.accuracies.items()), "model string, accuracy double"
        )
        self.preparation.save(spark, path)
        self.models.save(spark, path, table)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TrainingRun":
        return cls(
            Preparation.load(spark, path),
            ModelPair.load(spark, path),
            load_accuracies(spark, path),
        )


def split_rows(df: DataFrame, label: str = LABEL, id_col: str = ID) -> DataFrame:
    return stratified_split(df, label, id_col, TEST_SHARE, SEED)


def train(
    df: DataFrame, label: str = LABEL, id_col: str = ID, fit_on: str = "all"
) -> TrainingRun:
    """Train on 80 percent of each label and evaluate on the rest.

    The preparation is fitted on all rows, test rows included, or with
    ``fit_on='train'`` only on those the models see.
    """
    if fit_on not in ("all", "train"):
        raise ValueError(f"fit_on must be all or train: {fit_on}")
    parts = split_rows(df, label, id_col)
    train_part, test_part = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    preparation = Preparation(label=label, key_columns=(id_col,))
    preparation.fit(df if fit_on == "all" else train_part)
    models = ModelPair.train(
        preparation.transform(train_part), preparation.feature_columns, label
    )
    measured = models.evaluate(preparation.transform(test_part), label).collect()
    return TrainingRun(preparation, models, {r["model"]: r["accuracy"] for r in measured})
