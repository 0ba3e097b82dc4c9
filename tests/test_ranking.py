from __future__ import annotations

import random

from pyspark.sql import functions as F

from rowforge.operators.ranking import global_index, group_row_number
from rowforge.operators.requests import rate_limit_decide
from rowforge.operators.split import stratified_split
from rowforge.sources.documents import batch_number


def test_global_index_is_the_position_in_the_order(spark):
    values = random.Random(1).sample(range(10_000), 3000)
    df = spark.createDataFrame([(v, -v) for v in values], "a int, b int").repartition(7)
    rows = global_index(df, [F.col("a").desc()], "i").collect()
    expected = {v: i for i, v in enumerate(sorted(values, reverse=True))}
    assert {r["a"]: r["i"] for r in rows} == expected
    assert all(r["b"] == -r["a"] for r in rows)


def test_hot_groups_are_numbered_like_all_others(spark):
    rng = random.Random(2)
    # one key holds half of the rows, and one group has a null key
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), i, rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, id int, v double").repartition(5)
    order = [F.col("v"), F.col("id")]
    plain = {r["id"]: r["n"] for r in group_row_number(df, ["k"], order, "n").collect()}
    split = {r["id"]: r["n"] for r in group_row_number(df, ["k"], order, "n", 500).collect()}
    assert plain == split and len(plain) == 4000
    by_key: dict = {}
    for key, ident, value in rows:
        by_key.setdefault(key, []).append((value, ident))
    expected = {i: n + 1 for group in by_key.values() for n, (_, i) in enumerate(sorted(group))}
    assert plain == expected


def test_flooded_rate_window(spark, tables):
    requests = tables.requests
    one_key = requests.withColumn("user_id", F.lit(1))
    few = rate_limit_decide(one_key, "user_id", 3, "day")
    split = rate_limit_decide(one_key, "user_id", 3, "day", hot_rows=10)
    pick = ["request_id", "nth", "allowed"]
    assert sorted(few.select(*pick).collect()) == sorted(split.select(*pick).collect())


def test_batches_have_the_fixed_size(spark):
    df = spark.range(1203).repartition(6)
    rows = batch_number(df, [F.col("id")]).collect()
    assert all(r["batch"] == r["id"] // 500 + 1 and r["total_batches"] == 3 for r in rows)


def test_split_is_exact_per_label(spark, monkeypatch):
    from rowforge.operators import split

    rows = [(i, "hot" if i % 3 else None if i % 2 else "rare") for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, label string")
    plain = stratified_split(df, "label", "id")
    wanted = {r["id"]: r["part"] for r in plain.collect()}
    for label in ("hot", "rare", None):
        ids = [i for i, given in rows if given == label]
        assert sum(wanted[i] == "test" for i in ids) == round(0.2 * len(ids))
    # finer slices and tables too long to broadcast give the same parts
    monkeypatch.setattr(split, "SLICE_ROWS", 5)
    monkeypatch.setattr(split, "MAX_SMALL_LABELS", 1)
    again = stratified_split(df, "label", "id")
    assert {r["id"]: r["part"] for r in again.collect()} == wanted


def test_split_of_tiny_labels(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, label int")
    assert {r["part"] for r in stratified_split(df, "label", "id").collect()} == {"train"}
