from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rowforge.llm import embedding_dedup as e


def brute(rows):
    def unit(x):
        if not x or any(v is None or not math.isfinite(v) for v in x) or not any(x):
            return None
        x = np.array(x, float)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(x) for _, x in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None
              and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        named = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(named) if named else None))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as code")
    return e.near_duplicates(df, **options).collect()


def table():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((centre + rng.normal(size=16) * 0.12).tolist())
    rows += [rng.normal(size=16).tolist() for _ in range(60)]
    rows += [rows[0], rows[0], [v * 2.5 for v in rows[0]], [v * 1e300 for v in rows[1]]]
    order = list(range(len(rows)))
    random.Random(1).shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def test_links_and_groups_agree_with_brute_force(spark):
    rows = table()
    got = run(spark, rows, miss=1e-7)
    assert sorted(tuple(r)[:3] for r in got) == sorted(brute(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_blocks_of_a_full_bucket(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    rows = [(i, (centre + rng.normal(size=8) * 0.2).tolist()) for i in range(70)]
    got = run(spark, rows, miss=1e-9)
    assert sorted(tuple(r)[:3] for r in got) == sorted(brute(rows))


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0])],
        [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (None, [2.0, 0.1])],
        [(3, [1e-200, 1e-200]), (2, [1e200, 1e200])],
    ],
)
def test_odd_tables(spark, rows):
    assert sorted(map(repr, (tuple(r)[:3] for r in run(spark, rows)))) == sorted(map(repr, brute(rows)))


def test_tables_follow_bits():
    for bits in (6, 12, 20):
        agree = (1 - math.acos(0.9) / math.pi) ** bits
        tables = e.tables_for(bits, 0.9, 0.003)
        assert (1 - agree) ** tables <= 0.003 < (1 - agree) ** (tables - 1)
