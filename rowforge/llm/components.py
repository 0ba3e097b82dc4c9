"""Connected components of a graph too large for one machine.

Large-star and small-star steps in turn, each a grouped minimum and a join. Hubs are split
by the skew handling of adaptive joins, as the minimum of a vertex is one row; every step
is written to the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import durable_narrow


def _are_stars(edges: DataFrame) -> bool:
    """Whether every vertex is a leaf of one edge ``u, v`` or a root, never both."""
    ends = F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")),
        F.struct(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root")),
    )
    roles = edges.select(F.inline(ends)).groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
    return not roles.agg(F.count_if((F.col("leaf") > 1) | (F.col("leaf") + F.col("root") > 1))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    # larger neighbours point to the smallest one
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``u, component`` for every vertex of the edges ``u, v``: the smallest one reachable.

    Loops and repeated edges do no harm; a vertex with loops only is left out; no edges
    give no rows. Rounds grow with the logarithm of the longest path.
    """

    def tidy(found: DataFrame) -> DataFrame:
        return durable_narrow(found.where("u != v").distinct())

    # larger to smaller from the start: then stars are all that is left to reach
    edges = tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while not _are_stars(edges):
        edges = tidy(_small_star(_large_star(edges)))
    leaves = edges.select("u", F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
    return durable_narrow(leaves.union(roots))
