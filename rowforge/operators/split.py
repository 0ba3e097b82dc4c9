"""Exact stratified split that no stratum can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

#: Rows of one stratum that share a hash prefix, at most roughly.
SLICE_ROWS = 5_000_000

#: Labels whose bounds may be broadcast.
MAX_SMALL_LABELS = 10_000


def split_hash(id_col: str, seed: int) -> Column:
    """Order of the split; the same for any partitioning."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def stratified_split(
    df: DataFrame, label: str, id_col: str, test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part``: 'test' for round(share * n) rows of each label, else 'train'.

    The rows with the smallest hashes of each label are the test rows. Counting rows
    per hash prefix finds the prefix in which the last test row of a label lies; only
    rows with that prefix are sorted, for the hash of that last row. The split itself
    is then a comparison, with no shuffle. ``id_col`` must be unique.
    """
    hashed = df.select(F.col(label).alias("__label"), split_hash(id_col, seed).alias("__hash"))
    total = df.count()
    digits = 1
    while 16**digits * SLICE_ROWS < total:
        digits += 1
    prefix = F.substring("__hash", 1, digits)

    slices = hashed.groupBy("__label", prefix.alias("__slice")).agg(F.count("*").alias("__n"))
    per_label = Window.partitionBy("__label")
    running = per_label.orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        slices.withColumn("__through", F.sum("__n").over(running))
        .withColumn("__want", F.round(F.sum("__n").over(per_label) * test_share).cast("long"))
        .where(
            (F.col("__through") >= F.col("__want"))
            & (F.col("__through") - F.col("__n") < F.col("__want"))
        )
        .select(
            "__label",
            "__slice",
            (F.col("__want") - F.col("__through") + F.col("__n")).alias("__nth"),
        )
    )
    edges, small = _settled(edges)
    side = F.broadcast(edges) if small else edges
    same = F.col("h.__label").eqNullSafe(F.col("e.__label"))
    at_edge = hashed.alias("h").join(side.alias("e"), same & (prefix == F.col("e.__slice")))
    order = Window.partitionBy("h.__label").orderBy("__hash")
    last = (
        at_edge.withColumn("__rn", F.row_number().over(order))
        .where(F.col("__rn") == F.col("__nth"))
        .select(F.col("h.__label").alias("__label"), F.col("__hash").alias("__last"))
    )
    last, small = _settled(last)
    bounds = F.broadcast(last) if small else last
    is_test = F.coalesce(split_hash(id_col, seed) <= F.col("__last"), F.lit(False))
    return (
        df.join(bounds, F.col(label).eqNullSafe(F.col("__label")), "left")
        .withColumn("part", F.when(is_test, "test").otherwise("train"))
        .drop("__label", "__last")
    )


def _settled(per_label: DataFrame) -> tuple[DataFrame, bool]:
    """The table of one row per label as values where it is short, else written out,
    and whether it is short enough to broadcast."""
    rows = per_label.limit(MAX_SMALL_LABELS + 1).collect()
    if len(rows) <= MAX_SMALL_LABELS:
        return per_label.sparkSession.createDataFrame(rows, per_label.schema), True
    return durable(per_label), False
