"""Rows at given positions of an order over several keys, without sorting the table.

A bounded sample says between which two keys a position must lie. The rows on both sides
are counted exactly, so a bracket that missed is seen and widened, and the search goes on
between the two. What is left in the end is small enough for one task. Each round reads the
keys twice and shuffles counts only; all positions share the rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, sqrt
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

#: Rows whose order one task finds out.
MAX_TASK_ROWS = 200_000

#: Keys of a sample, which the driver takes.
SAMPLE_ROWS = 20_000

#: Standard errors of a sample rank on either side of a bracket.
ERRORS = 5


class KeyOrder:
    """An order by several keys, each with its direction: nulls are the smallest values.

    Positions are tuples of values, one for each key.
    """

    def __init__(self, df: DataFrame, keys: Sequence[tuple[str, bool]]):
        self.down = [down for _, down in keys]
        self.columns = [_column(df, name) for name, _ in keys]

    @property
    def sort_keys(self) -> list[Column]:
        return [
            c.desc_nulls_last() if down else c.asc_nulls_first()
            for c, down in zip(self.columns, self.down)
        ]

    def equals(self, values: Sequence[object]) -> Column:
        return reduce(and_, [c.eqNullSafe(F.lit(v)) for c, v in zip(self.columns, values)])

    def beyond(self, values: Sequence[object], forward: bool) -> Column:
        """Rows that come after a position, or before it; never null."""
        reached = F.lit(False)
        for column, down, value in reversed(list(zip(self.columns, self.down, values))):
            lower = down == forward  # the side on which smaller values are
            if value is None:
                further = F.lit(False) if lower else column.isNotNull()
            elif lower:
                further = (column < F.lit(value)) | column.isNull()
            else:
                further = F.coalesce(column > F.lit(value), F.lit(False))
            reached = F.coalesce(further, F.lit(False)) | (column.eqNullSafe(F.lit(value)) & reached)
        # the leading key alone is implied, and reaches the scan as a pushed filter
        column, down, value = self.columns[0], self.down[0], values[0]
        if value is None:
            return reached
        if down == forward:
            return ((column <= F.lit(value)) | column.isNull()) & reached
        return (column >= F.lit(value)) & reached


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.col(name)


@dataclass
class Place:
    """The row at a position: its keys, and how many rows come before the first like it."""

    values: tuple
    before: int


@dataclass
class _Search:
    rank: int
    inside: int
    low: tuple | None = None  # both ends are outside
    high: tuple | None = None
    below: int = 0  # rows up to ``low``
    widening: float = 1.0

    def candidates(self, order: KeyOrder) -> Column:
        ends = [order.beyond(v, forward) for v, forward in ((self.low, True), (self.high, False)) if v is not None]
        return reduce(and_, ends, F.lit(True))


def select_ranks(df: DataFrame, order: KeyOrder, ranks: Sequence[int]) -> dict[int, Place]:
    """The rows at 0-based positions in the order, of those that there are."""
    fields = [f"k{i}" for i in range(len(order.columns))]
    narrow = df.select(*[c.alias(f) for c, f in zip(order.columns, fields)])
    order = KeyOrder(narrow, list(zip(fields, order.down)))
    total = narrow.count()
    searches = [_Search(rank, total) for rank in sorted(set(ranks)) if rank < total]
    found: dict[int, Place] = {}
    while searches:
        small = [s for s in searches if s.inside <= MAX_TASK_ROWS or s.rank - s.below < MAX_TASK_ROWS]
        for search in small:
            found[search.rank] = _finish(narrow, order, search)
        searches = [s for s in searches if s not in small]
        if searches:
            _narrow(narrow, order, searches, found)
            searches = [s for s in searches if s.rank not in found]
    return found


def _finish(narrow: DataFrame, order: KeyOrder, search: _Search) -> Place:
    inside = narrow.where(search.candidates(order))
    row = tuple(inside.orderBy(*order.sort_keys).offset(search.rank - search.below).limit(1).first())
    return Place(row, search.below + inside.where(order.beyond(row, False)).count())


def _narrow(narrow: DataFrame, order: KeyOrder, searches: list[_Search], found: dict[int, Place]) -> None:
    brackets = []
    for seed, s in enumerate(searches):
        sample = narrow.where(s.candidates(order)).where(F.rand(seed) < SAMPLE_ROWS / s.inside)
        keys = [tuple(r) for r in sample.orderBy(*order.sort_keys).collect()]
        if not keys:
            continue
        share = (s.rank - s.below + 0.5) / s.inside
        margin = ERRORS * 0.5 / sqrt(len(keys)) * s.widening
        low = max(0, floor((share - margin) * len(keys)))
        high = min(len(keys) - 1, ceil((share + margin) * len(keys)))
        brackets.append((s, keys[low], keys[high]))
    if not brackets:
        return
    measures = []
    for i, (s, low, high) in enumerate(brackets):
        inside = s.candidates(order)
        measures += [
            F.count_if(inside & order.beyond(low, False)).alias(f"lt_low{i}"),
            F.count_if(inside & order.equals(low)).alias(f"eq_low{i}"),
            F.count_if(inside & order.beyond(low, True) & order.beyond(high, False)).alias(f"between{i}"),
            F.count_if(inside & order.equals(high)).alias(f"eq_high{i}"),
        ]
    row = narrow.agg(*measures).first()
    for i, (s, low, high) in enumerate(brackets):
        target = s.rank - s.below
        through_low = row[f"lt_low{i}"] + row[f"eq_low{i}"]
        through = through_low + row[f"between{i}"]
        if row[f"lt_low{i}"] <= target < through_low:
            found[s.rank] = Place(low, s.below + row[f"lt_low{i}"])
        elif through_low <= target < through:
            s.low, s.high, s.below, s.inside, s.widening = low, high, s.below + through_low, row[f"between{i}"], 1.0
        elif low != high and through <= target < through + row[f"eq_high{i}"]:
            found[s.rank] = Place(high, s.below + through)
        else:
            s.widening *= 4
