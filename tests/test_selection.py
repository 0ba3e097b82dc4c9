"""Positions in an order over several keys: brute force, ties, nulls, plans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowforge.operators import docquery as dq, selection
from rowforge.operators.selection import KeyOrder, select_ranks

KEYS = [("a", True), ("b", False), ("c", False)]


@pytest.fixture(scope="module")
def made_up(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice([None, 1, 2, 2, 2, 3]), rng.choice([None, "x", "y"]), rng.choice([None, 0.5, float("nan"), -1.0, 2.0]))
        for _ in range(3000)
    ]
    return spark.createDataFrame(rows, "a int, b string, c double").repartition(4).cache()


def plain(row):
    return tuple("nan" if v != v else v for v in row)


@pytest.mark.parametrize("task_rows, sample", [(200_000, 20_000), (50, 200), (1, 30)])
def test_ranks_agree_with_a_sort(made_up, monkeypatch, task_rows, sample):
    monkeypatch.setattr(selection, "MAX_TASK_ROWS", task_rows)
    monkeypatch.setattr(selection, "SAMPLE_ROWS", sample)
    order = KeyOrder(made_up, KEYS)
    ordered = [plain(r) for r in made_up.orderBy(*order.sort_keys).collect()]
    ranks = [0, 1, 777, 1500, 2999, 3000]
    found = select_ranks(made_up, order, ranks)
    assert sorted(found) == ranks[:-1]
    for rank, place in found.items():
        assert plain(place.values) == ordered[rank]
        assert place.before == ordered.index(ordered[rank])


def test_many_distinct_keys(spark, monkeypatch):
    monkeypatch.setattr(selection, "MAX_TASK_ROWS", 100)
    monkeypatch.setattr(selection, "SAMPLE_ROWS", 500)
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("a"), (F.col("id") % 7).alias("b"))
    order = KeyOrder(df, [("b", False), ("a", True)])
    ordered = [tuple(r) for r in df.orderBy(*order.sort_keys).select("b", "a").collect()]
    found = select_ranks(df, order, [150_000, 3, 99_999])
    assert {r: tuple(p.values) for r, p in found.items()} == {r: ordered[r] for r in (3, 99_999, 150_000)}


def test_one_key_only_and_an_empty_table(spark):
    df = spark.range(50).select(F.lit(1).alias("a"))
    assert select_ranks(df, KeyOrder(df, [("a", False)]), [0, 49]) == {
        0: selection.Place((1,), 0), 49: selection.Place((1,), 0)
    }
    assert select_ranks(df.limit(0), KeyOrder(df, [("a", False)]), [0]) == {}


@pytest.mark.parametrize("offset, limit", [(2500, 0), (100, 0), (40, 2000), (2990, 50)])
def test_pages_write_and_sort_no_keys(spark, made_up, monkeypatch, offset, limit):
    monkeypatch.setattr(dq, "MAX_TOP_ROWS", 10)
    monkeypatch.setattr(dq, "global_index", None)  # only wholly equal rows may need it
    unique = made_up.withColumn("d", F.monotonically_increasing_id())
    keys = [*KEYS, ("d", False)]
    got = [plain(r) for r in dq.page(unique, keys, offset, limit).collect()]
    ordered = [plain(r) for r in unique.orderBy(*dq._order_columns(unique, keys)).collect()]
    assert got == (ordered[offset : offset + limit] if limit else ordered[offset:])
