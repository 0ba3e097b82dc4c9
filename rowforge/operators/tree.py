"""A classification tree grown by exact splits, level by level.

Every distinct value of every feature is a place to split, as in a search over sorted rows.
A level is one pass: rows are counted by node, feature and value, the counts are summed up in
the order of values, and the best place of each node is read off. The sums run over range
partitions with one offset each, so neither a node nor a feature has to fit in one task. What
comes to the driver is the tree itself, at most two to the power of its depth nodes.

Of equally good splits the first feature wins, then the smallest value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import durable

NODES = "node long, n long, positives long, feature int, threshold double"


@dataclass(frozen=True)
class Node:
    """A node by its number (the children of ``k`` are ``2 k`` and ``2 k + 1``), the rows of
    each class in it, and its split; rows up to the threshold go left."""

    node: int
    n: int
    positives: int
    feature: int | None = None
    threshold: float | None = None


class ExactTree:
    """The nodes of a tree and the names of its features."""

    def __init__(self, nodes: Sequence[Node], features: Sequence[str]):
        self.nodes = {node.node: node for node in nodes}
        self.features = list(features)

    @property
    def depth(self) -> int:
        return max(self.nodes).bit_length() - 1

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k.node, k.n, k.positives, k.feature, k.threshold) for k in self.nodes.values()]
        return spark.createDataFrame(rows, NODES)

    def leaf(self) -> Column:
        """The number of the leaf that a row falls into; null if a feature is missing."""
        values = F.array(*[F.col(f"`{name}`").cast("double") for name in self.features])
        top = max(self.nodes) + 1
        known = [self.nodes.get(k, Node(k, 0, 0)) for k in range(top)]
        feature = F.lit([-1 if k.feature is None else k.feature for k in known])
        threshold = F.lit([0.0 if k.threshold is None else k.threshold for k in known])

        def step(at: Column, _: Column) -> Column:
            right = F.get(values, F.get(feature, at)) > F.get(threshold, at)
            return F.when(F.get(feature, at) < 0, at).otherwise(2 * at + right.cast("int"))

        walked = F.aggregate(F.array_repeat(F.lit(0), self.depth), F.lit(1), step)
        return F.when(F.forall(values, lambda v: v.isNotNull()), walked)

    def probability(self) -> Column:
        """P(class 1): the share of positives in the leaf."""
        share = [0.0] * (max(self.nodes) + 1)
        for k in self.nodes.values():
            share[k.node] = k.positives / k.n if k.n else 0.0
        return F.get(F.lit(share), self.leaf())

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``tree_prob`` and ``tree_label``."""
        scored = df.withColumn("tree_prob", self.probability())
        return scored.withColumn("tree_label", (F.col("tree_prob") >= 0.5).cast("int"))


def _running(counts: DataFrame) -> DataFrame:
    """Rows and positives up to each value, and in all, per node and feature."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["node", "feature", "value"]
    placed = durable(
        counts.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    # a node's feature in one partition: at most a partition's rows
    inside = Window.partitionBy("node", "feature", "part").orderBy("value")
    sums = placed.groupBy("node", "feature", "part").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    group = Window.partitionBy("node", "feature")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "node",
        "feature",
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("positives").over(before), F.lit(0)).alias("positives_before"),
        F.sum("n").over(group).alias("n_all"),
        F.sum("positives").over(group).alias("positives_all"),
    )
    return placed.join(offsets, ["node", "feature", "part"]).select(
        *order,
        (F.sum("n").over(inside) + F.col("n_before")).alias("n"),
        (F.sum("positives").over(inside) + F.col("positives_before")).alias("positives"),
        "n_all",
        "positives_all",
    )


def _purity(n: Column, positives: Column) -> Column:
    """The squares of both classes over the rows: more is purer."""
    ones, zeros = positives.cast("double"), (n - positives).cast("double")
    return (ones * ones + zeros * zeros) / n


def best_splits(counts: DataFrame) -> DataFrame:
    """``node, feature, low, next, n, positives`` of the best split of every node that has one:
    the largest value on the left, the smallest on the right, and the rows on the left."""
    running = durable(_running(counts).where("n < n_all or value is not null"))
    gain = _purity(F.col("n"), F.col("positives")) + _purity(
        F.col("n_all") - F.col("n"), F.col("positives_all") - F.col("positives")
    )
    inside = running.where("n < n_all").withColumn("gain", gain)
    best = inside.groupBy("node").agg(
        F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "value", "n", "positives")).alias("best")
    )
    best = best.select("node", "best.feature", F.col("best.value").alias("low"), F.col("best.n").alias("n"), F.col("best.positives").alias("positives"))
    # one row per node
    above = running.join(F.broadcast(best.select("node", "feature", "low")), ["node", "feature"]).where("value > low")
    return best.join(above.groupBy("node").agg(F.min("value").alias("next")), "node")


def grow_tree(
    df: DataFrame, features: Sequence[str], label: str, max_depth: int = 10, min_split: int = 20
) -> ExactTree:
    """The tree over rows with all features and a label of 0 or 1.

    A node is split while it has ``min_split`` rows or more, both classes, and values that
    differ, and lies above ``max_depth``. A missing feature or label is an error.
    """
    values = F.array(*[F.col(f"`{name}`").cast("double") for name in features])
    rows = df.select(values.alias("x"), F.col(f"`{label}`").cast("long").alias("y"), F.lit(1).cast("long").alias("node"))
    rows = durable(rows)
    sums = rows.agg(
        F.count("*").alias("n"),
        F.sum("y").alias("positives"),
        F.count_if(F.exists("x", lambda v: v.isNull() | F.isnan(v)) | F.col("y").isNull()).alias("missing"),
        F.count_if(~F.col("y").isin(0, 1)).alias("other"),
    ).first()
    if not sums["n"]:
        raise ValueError("no rows to grow a tree from")
    if sums["missing"] or sums["other"]:
        raise ValueError(f"{sums['missing']} rows with missing values, {sums['other']} with other labels")
    nodes = {1: Node(1, sums["n"], sums["positives"])}
    level = [nodes[1]]
    for _ in range(max_depth):
        open_nodes = [k.node for k in level if k.n >= min_split and 0 < k.positives < k.n]
        if not open_nodes:
            break
        rows = rows.where(F.col("node").isin(open_nodes))
        counts = (
            rows.select("node", "y", F.posexplode("x").alias("feature", "value"))
            .groupBy("node", "feature", "value")
            .agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
        )
        level = []
        for r in best_splits(counts).collect():
            parent = nodes[r["node"]]
            nodes[r["node"]] = Node(parent.node, parent.n, parent.positives, r["feature"], _between(r["low"], r["next"]))
            left = Node(2 * parent.node, r["n"], r["positives"])
            right = Node(2 * parent.node + 1, parent.n - r["n"], parent.positives - r["positives"])
            level += [left, right]
        nodes |= {k.node: k for k in level}
        split = [k for k in nodes.values() if k.feature is not None and k.node in open_nodes]
        if not split:
            break
        cuts = rows.sparkSession.createDataFrame(
            [(k.node, k.feature, k.threshold) for k in split], "node long, feature int, threshold double"
        )
        right = F.get("x", "feature") > F.col("threshold")
        rows = durable(
            rows.join(F.broadcast(cuts), "node").select("x", "y", (2 * F.col("node") + right.cast("long")).alias("node"))
        )
    return ExactTree(sorted(nodes.values(), key=lambda k: k.node), features)


def _between(low: float, above: float) -> float:
    """Half way, but below the upper value, also where the two are neighbours."""
    middle = low / 2 + above / 2
    return middle if low <= middle < above else low
