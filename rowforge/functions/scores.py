"""Probabilities to classes, confidences and texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .formats import fixed, round_to

# Class names, decision threshold and confidence cut-offs.
POSITIVE, NEGATIVE = "survived", "did_not_survive"
THRESHOLD = 0.5
MARGIN_LEVELS = {"high": 0.7, "medium": 0.4}
AGREEMENT_LEVELS = {"high": 0.8, "medium": 0.6}
MODEL_NAMES = ("logistic_regression", "decision_tree")


def linear_score(intercept: float, weights: Mapping[str, float]) -> Column:
    """Logistic probability from a coefficient table."""
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(name)
    return 1 / (1 + F.exp(-total))


def ensemble_mean(first: Column, second: Column) -> Column:
    return (first + second) / 2


def threshold_label(probability: Column, strict: bool = False) -> Column:
    """1 from 0.5 on; with ``strict`` only above 0.5. No score, no label."""
    hit = probability > THRESHOLD if strict else probability >= THRESHOLD
    return F.when(hit, 1).when(probability.isNotNull(), 0)


def threshold_class(probability: Column, strict: bool = False) -> Column:
    label = threshold_label(probability, strict)
    return F.when(label == 1, POSITIVE).when(label == 0, NEGATIVE)


def confidence_margin(probability: Column) -> Column:
    """Distance from the decision boundary, scaled to 0..1."""
    return F.abs(probability - THRESHOLD) * 2


def confidence_agreement(first: Column, second: Column) -> Column:
    """How close two models are to each other."""
    return 1 - F.abs(first - second)


def confidence_level(confidence: Column, levels: Mapping[str, float]) -> Column:
    return (
        F.when(confidence > levels["high"], "high")
        .when(confidence > levels["medium"], "medium")
        .when(confidence.isNotNull(), "low")
    )


def round3(value: Column) -> Column:
    """Three places, half to even."""
    return round_to(value, 3)


def percent_whole(value: Column) -> Column:
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))


def percent_tenth(value: Column) -> Column:
    return F.concat(fixed(value * 100, 1), F.lit("%"))


def _record(first, second, confidence, level, strict, places):
    shown = round3 if places else (lambda column: column)

    def model(probability: Column) -> Column:
        return F.struct(
            shown(probability).alias("probability"),
            threshold_class(probability, strict).alias("prediction"),
        )

    joint = ensemble_mean(first, second)
    return F.struct(
        F.create_map(
            F.lit(MODEL_NAMES[0]), model(first), F.lit(MODEL_NAMES[1]), model(second)
        ).alias("individual_models"),
        F.struct(
            shown(joint).alias("probability"),
            threshold_class(joint, strict).alias("prediction"),
            shown(confidence).alias("confidence"),
            level.alias("confidence_level"),
        ).alias("ensemble_result"),
    )


def margin_record(first: Column, second: Column) -> Column:
    """Score record with the margin confidence, rounded to three places."""
    confidence = confidence_margin(ensemble_mean(first, second))
    level = confidence_level(confidence, MARGIN_LEVELS)
    return _record(first, second, confidence, level, strict=False, places=True)


def agreement_record(first: Column, second: Column) -> Column:
    """Score record with the agreement confidence, unrounded (the served one)."""
    confidence = confidence_agreement(first, second)
    level = confidence_level(confidence, AGREEMENT_LEVELS)
    return _record(first, second, confidence, level, strict=True, places=False)
