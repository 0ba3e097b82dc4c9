"""Exact trees: node for node as a search over sorted rows finds them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowforge.operators.tree import Node, _between, grow_tree


def brute(rows, max_depth, min_split, node=1, depth=0):
    """``rows`` of (values, label)."""
    n, positives = len(rows), sum(y for _, y in rows)
    here = {node: Node(node, n, positives)}
    if depth == max_depth or n < min_split or positives in (0, n):
        return here
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, above in zip(values, values[1:]):
            left = [y for x, y in rows if x[f] <= low]
            right = [y for x, y in rows if x[f] > low]
            gain = sum((sum(s) ** 2 + (len(s) - sum(s)) ** 2) / len(s) for s in (left, right))
            if best is None or gain > best[0]:
                best = (gain, f, low, above)
    if best is None:
        return here
    _, f, low, above = best
    here[node] = Node(node, n, positives, f, _between(low, above))
    here |= brute([r for r in rows if r[0][f] <= low], max_depth, min_split, 2 * node, depth + 1)
    return here | brute([r for r in rows if r[0][f] > low], max_depth, min_split, 2 * node + 1, depth + 1)


def made_up(rng, n):
    rows = []
    for _ in range(n):
        x = (float(rng.randint(0, 3)), round(rng.gauss(0, 2), 1), float(rng.choice([1, 2, 2, 5])))
        rows.append((x, int(x[1] + 2 * (x[0] == 1) + rng.gauss(0, 1) > 0.5)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, y) for x, y in rows], "a double, b double, c double, y int")


@pytest.mark.parametrize("seed, n, depth, smallest", [(1, 300, 4, 20), (2, 60, 10, 2), (3, 19, 10, 20)])
def test_nodes_agree_with_a_search_over_rows(spark, seed, n, depth, smallest):
    rows = made_up(random.Random(seed), n)
    tree = grow_tree(frame(spark, rows), ["a", "b", "c"], "y", depth, smallest)
    want = brute(rows, depth, smallest)
    # a tie of gains may be broken by the last bit of a sum; nodes must be the same
    assert tree.nodes == want and tree.depth <= depth


def test_every_row_falls_into_its_leaf(spark):
    rows = made_up(random.Random(4), 200)
    tree = grow_tree(frame(spark, rows), ["a", "b", "c"], "y", 3, 20)
    df = frame(spark, rows).withColumn("leaf", tree.leaf())
    found = {r["leaf"]: (r["n"], r["p"]) for r in df.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    assert found == {k: (v.n, v.positives) for k, v in tree.nodes.items() if v.feature is None}
    scored = tree.predict(frame(spark, rows).withColumn("a", F.when(F.col("b") < 3, F.col("a"))))
    assert scored.where("(a is null) != (tree_prob is null)").isEmpty()


def test_equal_rows_are_a_leaf_and_missing_values_an_error(spark):
    same = [((1.0, 2.0, 3.0), i % 2) for i in range(40)]
    assert set(grow_tree(frame(spark, same), ["a", "b", "c"], "y").nodes) == {1}
    with pytest.raises(ValueError, match="missing"):
        grow_tree(frame(spark, same).withColumn("b", F.lit(None)), ["a", "b"], "y")
    with pytest.raises(ValueError, match="no rows"):
        grow_tree(frame(spark, same).limit(0), ["a"], "y")
