from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowforge.operators import preparation as prep
from rowforge.operators.preparation import Preparation, encode_lookup, fit_categories
from rowforge.operators import statistics
from rowforge.operators.statistics import (
    exact_medians,
    median_sizes,
    modes,
    value_counts,
)


def frame(spark, **columns):
    rows = list(zip(*columns.values()))
    names = ", ".join(f"{name} double" for name in columns)
    return spark.createDataFrame(rows, names)


def lists(rng, n):
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))
    return {
        "uniform": rng.random(n).tolist(),
        "hot": hot.tolist(),
        "two_values": rng.choice([1.0, 2.0], n).tolist(),
        "wide": (rng.random(n) * 10.0 ** rng.integers(-20, 20, n)).tolist(),
        # the middle lies in a sliver between two very frequent values
        "sliver": np.where(rng.random(n) < 0.5, 0.0, 1.0).tolist(),
    }


@pytest.mark.parametrize("n", [1, 2, 3001])
@pytest.mark.parametrize("max_values, sample", [(1, 1000), (50, 100), (50, 10**6), (200_000, 1)])
def test_exact_median_equals_numpy(spark, monkeypatch, n, max_values, sample):
    monkeypatch.setattr(statistics, "SAMPLE_ROWS", sample)
    values = lists(np.random.default_rng(n), n)
    values["sliver"][: n // 10] = np.linspace(0.2, 0.8, n // 10).tolist()
    found = exact_medians(frame(spark, **values), list(values), max_values)
    assert found == {name: float(np.median(column)) for name, column in values.items()}


def test_median_ignores_null_and_nan(spark):
    df = spark.createDataFrame([(None, 1.0), (3.0, float("nan")), (5.0, None)], "a double, b double")
    assert exact_medians(df, ["a", "b"]) == {"a": 4.0, "b": 1.0}
    assert exact_medians(df.where("false"), ["a"]) == {"a": None}


def test_median_between_infinities(spark, monkeypatch):
    monkeypatch.setattr(statistics, "SAMPLE_ROWS", 20)
    values = [-np.inf] * 40 + [float(i) for i in range(30)] + [np.inf] * 40
    assert exact_medians(frame(spark, a=values), ["a"], 2) == {"a": 14.5}


def test_mode_takes_the_smallest_of_equals(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "x string")
    assert modes(value_counts(df, ["x"])).first()["mode"] == "a"


def test_many_categories_are_coded_without_one_big_window(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_TASK_VALUES", 3)
    df = spark.range(50).select(
        F.format_string("c%02d", F.col("id") % 20).alias("x"), (F.col("id") % 2).alias("y")
    )
    rows = fit_categories(value_counts(df, ["x", "y"])).collect()
    codes = {(r["column"], r["category"]): r["code"] for r in rows}
    assert codes == {
        **{("x", f"c{i:02d}"): i for i in range(20)},
        ("y", "0"): 0,
        ("y", "1"): 1,
    }


def test_long_category_lists_are_joined(spark, monkeypatch):
    df = spark.createDataFrame(
        [("male", "S"), ("female", "C"), ("male", None), ("male", "S")], "sex string, embarked string"
    )
    short = Preparation().fit(df)
    monkeypatch.setattr(prep, "MAX_LITERAL_CATEGORIES", 1)
    long = Preparation().fit(df)
    monkeypatch.setattr(prep, "MAX_SMALL_CATEGORIES", 1)
    longer = Preparation().fit(df)
    assert short.categories is not None and long.categories is None and longer.categories is None
    assert long.small and not longer.small
    assert short.stats == long.stats == longer.stats
    new = spark.createDataFrame([("male", "C"), ("x", "S"), (None, None)], df.schema)
    for fitted in (short, long, longer):
        assert sorted(tuple(r) for r in fitted.transform(new).collect()) == [(0, 1), (0, 1), (1, 0)]


def test_unseen_category_is_null_or_first(spark):
    table = spark.createDataFrame([("x", "a", 0), ("x", "b", 1)], "column string, category string, code int")
    df = spark.createDataFrame([("a",), ("b",), ("z",)], "x string")
    known = encode_lookup(df, table, "x", unseen_to_first=False, small=True)
    first = encode_lookup(df, table, "x", unseen_to_first=True, small=False)
    assert sorted(known.collect(), key=str) == sorted([(0,), (1,), (None,)], key=str)
    assert sorted(r["x"] for r in first.collect()) == [0, 0, 1]


def test_an_empty_category_column_has_one_result(spark, monkeypatch):
    """Whatever the length of another column's code table."""
    df = spark.createDataFrame([(None, "C"), (None, "S")], "sex string, embarked string")
    found = []
    for bound in (200, 0):
        monkeypatch.setattr(prep, "MAX_LITERAL_CATEGORIES", bound)
        fitted = Preparation()
        fitted._fit_categories(df, ["sex", "embarked"])
        coded = fitted.encode(df)
        found.append((coded.schema["sex"].dataType.simpleString(), sorted(map(tuple, coded.collect()))))
    assert found[0] == found[1] == ("int", [(0, 0), (0, 1)])
