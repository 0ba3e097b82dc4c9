from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rowforge.functions import formats, numbers, scores
from rowforge.operators.features import age_group, age_group_legacy


def column(spark, values, kind, function, *args, **options):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    rows = df.select("i", function(F.col("v"), *args, **options).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


TEXTS = ["2", " 2.0 ", "25.5", "-3.9", "1e3", ".5", "5.", "1_000", "2.0f", "1d", "0x10", "abc", "", "nan", "inf", None]


def _python_float(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def test_coercion_like_python(spark):
    found = column(spark, TEXTS, "string", numbers.coerce_float)
    for text, value in zip(TEXTS, found):
        expected = _python_float(text)
        assert value == expected or (math.isnan(value) and math.isnan(expected)), text
    whole = column(spark, TEXTS, "string", numbers.coerce_int)
    assert whole == [
        None if x is None or not math.isfinite(x) else int(x) for x in map(_python_float, TEXTS)
    ]


def test_form_numbers(spark):
    texts = ["12abc", " 7", "-3.5x", "0x1f", "x1", "", ".5", "1e2z", "Infinity", None]
    floats = column(spark, texts, "string", numbers.parse_form_float)
    assert str(floats) == str([12.0, 7.0, -3.5, 0.0, math.nan, math.nan, 0.5, 100.0, math.inf, math.nan])
    whole = column(spark, texts, "string", numbers.parse_form_int)
    assert str(whole) == str([12.0, 7.0, -3.0, 31.0, math.nan, math.nan, math.nan, 1.0, math.nan, math.nan])


@pytest.mark.parametrize(
    "field, inside, outside, usual, unusual",
    [
        ("age", [0.0, 120.0, math.nan], [-5.0, 120.1], 80.0, 80.5),
        ("fare", [0.0, 1000.0], [-0.01, 1000.01], 500.0, 500.5),
        ("sibsp", [0.0, 20.0], [21.0], 8.0, 9.0),
        ("parch", [0.0, 20.0], [21.0], 9.0, 10.0),
    ],
)
def test_bounds(spark, field, inside, outside, usual, unusual):
    assert all(column(spark, inside, "double", numbers.in_bounds, field))
    assert not any(column(spark, outside, "double", numbers.in_bounds, field))
    assert column(spark, [usual, unusual], "double", numbers.is_outlier, field) == [False, True]


def test_age_bands_are_closed_on_the_right(spark):
    ages = [0.0, 0.5, 18.0, 18.1, 35.0, 60.0, 100.0, 101.0, None]
    assert column(spark, ages, "double", age_group) == [None, 0, 0, 1, 1, 2, 3, None, None]
    assert column(spark, ages, "double", age_group_legacy) == [-1, 0, 0, 1, 1, 2, 3, -1, -1]


def test_round_like_python(spark):
    values = [0.0625, 0.1875, 2.675, 0.0005, 0.0015, 0.1235, 0.9995, 1 / 3, -0.0625, 12345.6785]
    assert column(spark, values, "double", scores.round3) == [round(v, 3) for v in values]
    assert column(spark, values, "double", formats.money) == [f"${v:.2f}" for v in values]
    assert column(spark, values, "double", scores.percent_tenth) == [f"{v * 100:.1f}%" for v in values]


def test_thresholds_at_their_edges(spark):
    values = [0.4, 0.5, 0.6, None]
    assert column(spark, values, "double", scores.threshold_label) == [0, 1, 1, None]
    assert column(spark, values, "double", scores.threshold_label, strict=True) == [0, 0, 1, None]
    levels = column(spark, [0.4, 0.41, 0.7, 0.71], "double", scores.confidence_level, scores.MARGIN_LEVELS)
    assert levels == ["low", "medium", "medium", "high"]
    levels = column(spark, [0.6, 0.61, 0.8, 0.81, None], "double", scores.confidence_level, scores.AGREEMENT_LEVELS)
    assert levels == ["low", "medium", "medium", "high", None]


def test_rates_and_durations(spark):
    rates = column(spark, ["50/minute", "100 per hour", "x/minute", "5/week"], "string", formats.parse_rate)
    assert [r and tuple(r) for r in rates] == [(50, "minute", 60), (100, "hour", 3600), None, None]
    texts = ["30m", "45s", "2h", "7d", "5w", "m", ""]
    assert column(spark, texts, "string", formats.parse_duration) == [1800, 45, 7200, 604800, None, None, None]
    with pytest.raises(Exception, match="invalid duration: 5w"):
        column(spark, ["5w"], "string", formats.parse_duration, strict=True)


def test_limit_keys(spark):
    df = spark.createDataFrame([("7", "1.2.3.4"), (None, "1.2.3.4"), ("", "::1")], "u string, a string")
    key = formats.limit_key(F.col("u"), F.col("a"))
    rows = df.select(key.alias("k"), formats.key_kind(key).alias("kind"), formats.key_value(key).alias("v"))
    assert [tuple(r) for r in rows.collect()] == [
        ("user:7", "user", "7"),
        ("ip:1.2.3.4", "ip", "1.2.3.4"),
        ("ip:::1", "ip", "::1"),
    ]
