"""Positions in a global or per-group order, safe for large and skewed inputs.

A window without PARTITION BY, or one whose hottest key holds a third of the rows,
sorts that many rows in one task. Here a range-partitioned sort spreads them, and
only one row per partition is summarised and sent back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

#: Rows of one group that a single task sorts without trouble.
HOT_GROUP_ROWS = 2_000_000

_SERIAL = "__serial"
_PART = "__part"


def global_index(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """0-based position of each row in the total order given by ``order``.

    The order must be total (end it with a unique key). One range shuffle; the
    offsets table has one row per partition of the sorted data, so it is broadcast.
    """
    serial = durable(df.orderBy(*order).withColumn(_SERIAL, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(_SERIAL), 33)
    inside = F.col(_SERIAL).bitwiseAND(F.lit((1 << 33) - 1))
    counts = serial.groupBy(part.alias(_PART)).count()
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        _PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset")
    )
    return (
        serial.withColumn(_PART, part)
        .join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("__offset") + inside)
        .drop(_PART, _SERIAL, "__offset")
    )


def group_row_number(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "row_number",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """1-based position of each row in its group; ``order`` must be total in a group.

    Ordinary groups use a window. Groups above ``hot_rows`` rows are sorted together
    over range partitions instead, so no group has to fit in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    # only the large groups are kept of the count; usually there are none
    hot_groups = durable(df.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys))
    if hot_groups.isEmpty():
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    # null-safe, as a window treats null keys as one group; a short list is broadcast by its
    # size, a long one is joined by shuffle, where adaptive execution splits a hot key
    left, right = df.alias("rows"), hot_groups.alias("hot")
    same = reduce(
        lambda acc, key: acc & F.col(f"rows.{key}").eqNullSafe(F.col(f"hot.{key}")),
        keys,
        F.lit(True),
    )
    cold = left.join(right, same, "left_anti").withColumn(
        name, F.row_number().over(window).cast("long")
    )
    hot = global_index(
        left.join(right, same, "left_semi"), [F.col(k) for k in keys] + order, "__index"
    )
    starts = hot.groupBy(*keys).agg(F.min("__index").alias("__start"))
    aligned = reduce(
        lambda acc, key: acc & F.col(f"hot.{key}").eqNullSafe(F.col(f"start.{key}")),
        keys,
        F.lit(True),
    )
    ranked = (
        hot.alias("hot")
        .join(starts.alias("start"), aligned)
        .select("hot.*", (F.col("__index") - F.col("__start") + 1).alias(name))
        .drop("__index")
    )
    return cold.unionByName(ranked)
