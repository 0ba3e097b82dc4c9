"""Inputs that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import ensemble_mean, linear_score
from ..functions.text import words
from ..operators.preparation import Preparation
from ..operators.training import TrainingRun, split_rows, train
from ..sources.files import file_state
from ..sources.tables import Tables
from .registry import FIRST_INTERCEPT, FIRST_MODEL, SECOND_INTERCEPT, SECOND_MODEL

CODED = [
    "passenger_id",
    "survived",
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

_TRAINED: dict[tuple, TrainingRun] = {}


def prepared(t: Tables) -> DataFrame:
    passengers = t.passengers
    return Preparation().fit(passengers).transform(passengers).select(*CODED)


def linear_scores(t: Tables) -> DataFrame:
    """Prepared rows with two probabilities from fixed coefficients, and their mean."""
    return (
        prepared(t)
        .withColumn("p1", linear_score(FIRST_INTERCEPT, FIRST_MODEL))
        .withColumn("p2", linear_score(SECOND_INTERCEPT, SECOND_MODEL))
        .withColumn("p", ensemble_mean(F.col("p1"), F.col("p2")))
    )


def trained(t: Tables) -> TrainingRun:
    """The training run of these files, done once per application; other files under the
    same path, or changed ones, are trained on anew."""
    state = file_state(t.spark, f"{t.root}/orders.parquet")
    key = (t.spark.sparkContext.applicationId, t.root, state)
    if key not in _TRAINED:
        for old in [k for k in _TRAINED if k[:2] == key[:2]]:
            del _TRAINED[old]
        _TRAINED[key] = train(t.passengers)
    return _TRAINED[key]


def held_out(t: Tables, preparation: Preparation) -> DataFrame:
    """The prepared rows that no model was trained on."""
    parts = split_rows(t.passengers)
    return preparation.transform(parts.where(F.col("part") == "test").drop("part"))


def word_documents(t: Tables) -> DataFrame:
    return t.spread["documents"].select(
        F.col("doc_id").cast("string").alias("id"), "doc_id", words(F.col("text")).alias("words")
    )


def part_documents(t: Tables) -> DataFrame:
    return t["part"].select(F.col("p_partkey").cast("string").alias("id"), "*")
