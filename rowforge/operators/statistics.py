"""Exact medians, modes and category lists that hold for any number of values."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce
from math import inf, isnan, sqrt
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

#: Distinct values that one task may sort.
MAX_TASK_VALUES = 1_000_000

#: Rows of a sample that only says where to look next.
SAMPLE_ROWS = 500_000

#: Standard errors of a sample rank on either side of a bracket.
ERRORS = 5


@dataclass
class _Search:
    """One order statistic of a column, and the open interval it can still be in."""

    column: str
    rank: int
    inside: int
    distinct: int
    low: float | None = None
    high: float | None = None
    below: int = 0  # rows at or under ``low``
    widening: float = 1.0
    value: float | None = None

    def candidates(self) -> Column:
        number = _number(self.column)
        if self.low is not None:
            number = F.when(number > self.low, number)
        if self.high is not None:
            number = F.when(number < self.high, number)
        return number

    @property
    def target(self) -> int:
        """0-based rank among the candidates."""
        return self.rank - self.below

    @property
    def bracket(self) -> list[float]:
        """Shares of a sample between which the target almost surely lies."""
        share = (self.target + 0.5) / self.inside
        error = 0.5 / sqrt(min(SAMPLE_ROWS, self.inside))
        margin = ERRORS * error * self.widening
        return [max(0.0, share - margin), min(1.0, share + margin)]


def _number(column: str) -> Column:
    """The column as double; NaN counts as missing."""
    col = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(col), col)


def exact_medians(
    df: DataFrame, columns: list[str], max_values: int = MAX_TASK_VALUES
) -> dict[str, float | None]:
    """Median of each column (mean of the two middle values, nulls ignored).

    Spark's exact percentiles bring every distinct value of every task to one buffer.
    Here the number of distinct values is estimated first. Up to ``max_values`` they
    are counted by a shuffle, and only the counts are sorted. Beyond that, a sample
    brackets the middle, the rows on both sides are counted exactly, and the search
    goes on between; a bracket that missed is seen by the counts and widened. All
    columns share the passes over the data.
    """
    if not columns:
        return {}
    sizes = df.agg(*median_sizes(columns)).first()
    return medians_of(df, columns, sizes, max_values)


def median_sizes(columns: list[str]) -> list[Column]:
    """Rows and estimated distinct values per column: what a median search starts from."""
    return [
        measure
        for i, c in enumerate(columns)
        for measure in (
            F.count(_number(c)).alias(f"rows{i}"),
            F.approx_count_distinct(_number(c)).alias(f"distinct{i}"),
        )
    ]


def medians_of(
    df: DataFrame, columns: list[str], sizes: Row, max_values: int = MAX_TASK_VALUES
) -> dict[str, float | None]:
    searches = []
    for i, column in enumerate(columns):
        rows, distinct = sizes[f"rows{i}"], sizes[f"distinct{i}"]
        if rows:
            ranks = sorted({(rows - 1) // 2, rows // 2})
            searches += [_Search(column, rank, rows, distinct) for rank in ranks]
    while open_searches := [s for s in searches if s.value is None]:
        wide = [s for s in open_searches if s.distinct > max_values]
        if wide:
            _narrow(df, wide)
        else:
            _finish(df, open_searches)

    medians: dict[str, float | None] = dict.fromkeys(columns)
    for column in columns:
        middle = [s.value for s in searches if s.column == column]
        if middle:
            medians[column] = sum(middle) / len(middle)
    return medians


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    """Count the few remaining values, and read the wanted ranks off the counts."""
    groups: dict[tuple, list[_Search]] = defaultdict(list)
    for s in searches:
        groups[s.column, s.low, s.high].append(s)
    same_values = list(groups.values())
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("id"), group[0].candidates().alias("value"))
            for i, group in enumerate(same_values)
        ]
    )
    counts = (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("id", "value")
        .agg(F.count("*").alias("n"))
    )
    through = F.sum("n").over(Window.partitionBy("id").orderBy("value"))
    wanted = [
        (F.col("id") == i) & (F.col("through") > s.target) & (F.col("through") - F.col("n") <= s.target)
        for i, group in enumerate(same_values)
        for s in group
    ]
    rows = counts.withColumn("through", through).where(reduce(or_, wanted)).collect()
    for row in rows:
        for s in same_values[row["id"]]:
            if row["through"] - row["n"] <= s.target < row["through"]:
                s.value = row["value"]


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """Bracket each target with a sample, then count where the rows really are."""
    samples = df.select(
        *[
            F.when(F.rand(i) < SAMPLE_ROWS / s.inside, s.candidates()).alias(f"v{i}")
            for i, s in enumerate(searches)
        ]
    )
    ends = samples.agg(
        *[F.percentile(f"v{i}", s.bracket).alias(f"q{i}") for i, s in enumerate(searches)]
    ).first()
    found = [(s, ends[f"q{i}"]) for i, s in enumerate(searches)]
    brackets = [
        # between infinities of both signs the interpolated end is not a number
        (s, -inf if isnan(ends[0]) else ends[0], inf if isnan(ends[1]) else ends[1])
        for s, ends in found
        if ends is not None  # a sample may be empty
    ]
    counts = []
    for i, (s, low, high) in enumerate(brackets):
        number = s.candidates()
        between = F.when((number > low) & (number < high), number)
        counts += [
            F.count_if(number < low).alias(f"lt_low{i}"),
            F.count_if(number <= low).alias(f"le_low{i}"),
            F.count(between).alias(f"inside{i}"),
            F.count_if(number <= high).alias(f"le_high{i}"),
            F.approx_count_distinct(between).alias(f"distinct{i}"),
        ]
    row = df.agg(*counts).first() if counts else None
    for i, (s, low, high) in enumerate(brackets):
        through_low = row[f"le_low{i}"]
        if row[f"lt_low{i}"] <= s.target < through_low:
            s.value = low
        elif through_low <= s.target < through_low + row[f"inside{i}"]:
            s.low, s.high, s.below, s.widening = low, high, s.below + through_low, 1.0
            s.inside, s.distinct = row[f"inside{i}"], row[f"distinct{i}"]
        elif through_low <= s.target < row[f"le_high{i}"]:
            s.value = high
        else:
            s.widening *= 4


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per column and value, nulls left out, in one pass over all columns."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("category"))
            for c in columns
        ]
    )
    return (
        df.select(F.inline(pairs))
        .where(F.col("category").isNotNull())
        .groupBy("column", "category")
        .agg(F.count("*").alias("n"))
    )


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per column of ``value_counts``, ties to the smallest."""
    best = F.min_by("category", F.struct((-F.col("n")).alias("n"), "category"))
    return counts.groupBy("column").agg(best.alias("mode"))
