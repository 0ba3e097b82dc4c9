"""Training, scoring and describing the two classifiers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scores import (
    MODEL_NAMES,
    agreement_record,
    ensemble_mean,
    margin_record,
    threshold_label,
)
from .evaluate import evaluate_predictors

# Model settings and the accuracies shown when none are stored.
SEED, TEST_SHARE = 42, 0.2
MAX_ITERATIONS, INVERSE_PENALTY = 1000, 1.0
TREE_DEPTH, TREE_MIN_SPLIT = 10, 20
FALLBACK_ACCURACY = {
    "logistic_regression": 0.83,
    "decision_tree": 0.80,
    "ensemble": 0.82,
}

FEATURES = "features"


def assemble(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Feature vector next to the kept columns; a row with a missing feature is an error."""
    assembler = VectorAssembler(inputCols=columns, outputCol=FEATURES, handleInvalid="error")
    return assembler.transform(df).select(*keep, FEATURES)


def train_logistic(data: DataFrame, label: str, rows: int) -> LogisticRegressionModel:
    """L2-penalised logistic regression. Spark minimises the mean loss, so the penalty
    of the summed loss is divided by the number of rows."""
    return LogisticRegression(
        featuresCol=FEATURES,
        labelCol=label,
        regParam=1.0 / (INVERSE_PENALTY * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MAX_ITERATIONS,
        probabilityCol="lr_vector",
        rawPredictionCol="lr_raw",
        predictionCol="lr_label",
    ).fit(data)


def train_tree(data: DataFrame, label: str) -> DecisionTreeClassificationModel:
    """Tree of limited depth. Spark limits the size of a leaf, not of a split, so half
    the smallest split is the smallest leaf."""
    return DecisionTreeClassifier(
        featuresCol=FEATURES,
        labelCol=label,
        maxDepth=TREE_DEPTH,
        minInstancesPerNode=TREE_MIN_SPLIT // 2,
        maxBins=256,
        seed=SEED,
        probabilityCol="dt_vector",
        rawPredictionCol="dt_raw",
        predictionCol="dt_label",
    ).fit(data)


@dataclass
class ModelPair:
    """The logistic model and the tree over one feature list."""

    logistic: LogisticRegressionModel
    tree: DecisionTreeClassificationModel
    feature_columns: list[str]

    @classmethod
    def train(cls, df: DataFrame, feature_columns: list[str], label: str) -> "ModelPair":
        """Both fits read the same prepared rows several times, so these are kept."""
        data = assemble(df.withColumn(label, F.col(label).cast("double")), feature_columns, [label])
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows = data.count()
            return cls(train_logistic(data, label, rows), train_tree(data, label), feature_columns)
        finally:
            data.unpersist()

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``lr_prob`` and ``dt_prob``, P(class 1), and the labels of both models.

        Both models read the same row, so their scores need no join. A row with a
        missing feature gets no score.
        """
        assembler = VectorAssembler(
            inputCols=self.feature_columns, outputCol=FEATURES, handleInvalid="keep"
        )
        scored = self.tree.transform(self.logistic.transform(assembler.transform(df)))
        complete = reduce(and_, [F.col(c).isNotNull() for c in self.feature_columns])
        outputs = {
            "lr_prob": vector_to_array("lr_vector")[1],
            "dt_prob": vector_to_array("dt_vector")[1],
            "lr_label": F.col("lr_label").cast("int"),
            "dt_label": F.col("dt_label").cast("int"),
        }
        return scored.withColumns(
            {name: F.when(complete, value) for name, value in outputs.items()}
        ).drop(FEATURES, "lr_raw", "lr_vector", "dt_raw", "dt_vector")

    def ensemble(self, df: DataFrame, strict: bool = False) -> DataFrame:
        scored = self.predict_proba(df)
        joint = ensemble_mean(F.col("lr_prob"), F.col("dt_prob"))
        return scored.withColumn("ensemble_prob", joint).withColumn(
            "ensemble_label", threshold_label(F.col("ensemble_prob"), strict)
        )

    def score(self, df: DataFrame, served: bool = True) -> DataFrame:
        """Score record per row, with agreement (served) or margin confidence."""
        record = agreement_record if served else margin_record
        scored = self.predict_proba(df)
        return scored.withColumn("score", record(F.col("lr_prob"), F.col("dt_prob")))

    def evaluate(self, df: DataFrame, label: str) -> DataFrame:
        """Accuracy of both models and the ensemble, in one pass."""
        return evaluate_predictors(
            self.ensemble(df),
            label,
            {
                MODEL_NAMES[0]: F.col("lr_label"),
                MODEL_NAMES[1]: F.col("dt_label"),
                "ensemble": F.col("ensemble_label"),
            },
        )

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [("intercept", float(self.logistic.intercept))]
        rows += list(zip(self.feature_columns, map(float, self.logistic.coefficients)))
        return spark.createDataFrame(rows, "feature string, weight double")

    def info(self, spark: SparkSession, accuracies: dict[str, float] | None = None) -> DataFrame:
        """Depth, node count, feature count, coefficient shape and accuracies."""
        matrix = self.logistic.coefficientMatrix
        values = {
            "tree_depth": self.tree.depth,
            "tree_nodes": self.tree.numNodes,
            "n_features": self.tree.numFeatures,
            "coefficient_rows": matrix.numRows,
            "coefficient_columns": matrix.numCols,
        }
        shown = accuracies or FALLBACK_ACCURACY
        values.update({f"accuracy_{name}": value for name, value in shown.items()})
        rows = [(name, float(value)) for name, value in values.items()]
        return spark.createDataFrame(rows, "name string, value double")

    # -- persistence ---------------------------------------------------------

    def save(self, spark: SparkSession, path: str, accuracies: DataFrame | None = None) -> None:
        self.logistic.write().overwrite().save(f"{path}/logistic_model")
        self.tree.write().overwrite().save(f"{path}/decision_tree_model")
        columns = list(enumerate(self.feature_columns))
        spark.createDataFrame(columns, "pos int, name string").write.mode("overwrite").parquet(
            f"{path}/model_features"
        )
        if accuracies is not None:
            accuracies.write.mode("overwrite").parquet(f"{path}/evaluation_results")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ModelPair":
        from ..sources.files import require_paths

        parts = ["logistic_model", "decision_tree_model", "model_features"]
        require_paths(spark, [f"{path}/{part}" for part in parts])
        features = spark.read.parquet(f"{path}/model_features").orderBy("pos").collect()
        return cls(
            LogisticRegressionModel.load(f"{path}/logistic_model"),
            DecisionTreeClassificationModel.load(f"{path}/decision_tree_model"),
            [row["name"] for row in features],
        )


def load_accuracies(spark: SparkSession, path: str) -> dict[str, float]:
    """Stored accuracies, or the fallback ones where no table was stored."""
    from ..sources.files import path_exists

    if not path_exists(spark, f"{path}/evaluation_results"):
        return dict(FALLBACK_ACCURACY)
    rows = spark.read.parquet(f"{path}/evaluation_results").collect()
    return {row["model"]: row["accuracy"] for row in rows}
