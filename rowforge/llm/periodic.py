"""Periodic runs of words by recursive frequency splitting, then a scan over lags.

A run is a stretch of consecutive words with smallest period ``q`` that no neighbour
extends and that is at least ``max(6, 4 * q)`` words long. So every word of a run stands in
it four times or more. That gives the split: a word seen fewer times within its segment is
in no run of it and cuts the segment there; the pieces are counted anew, and those in which
nothing is left to cut are stable. Only stable segments are scanned.

The scan asks at every lag only for the words at its multiples: a run with that period
holds three neighbouring multiples whose words all equal the next one's. What passes is
extended word by word to its ends. A lag that is a multiple of the period of a run found
before is not tried inside that run again, so a long run costs its length once. With
segments of ``n`` words that are ``n log n`` comparisons.

Each text is a task's work by itself: no shuffle, and no state but the text in hand.

Defined cases: a null or empty text, or one without words, has no runs and collapses to an
empty text; equal rows are found alike, each for itself; other columns are carried unread,
whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A run has so many words at least, and so many periods.
MIN_WORDS = 6
MIN_PERIODS = 4

RUNS = "array<struct<start:long,length:long,period:long>>"
FOUND = f"struct<runs:{RUNS},collapsed:string>"

_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def split_by_frequency(words: np.ndarray) -> list[tuple[int, int]]:
    """Stable segments ``first, end``: every word in one stands there four times or more."""
    stable: list[tuple[int, int]] = []
    places = np.arange(len(words))
    segment = np.zeros(len(words), np.int64)
    many = int(words.max()) + 1 if len(words) else 1
    while len(places):
        key = segment * many + words[places]
        if len(segment) == len(words):  # the whole text: the numbers themselves are small
            keep = np.bincount(key)[key] >= MIN_PERIODS
        else:
            _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
            keep = counts[which] >= MIN_PERIODS
        cut = np.bincount(segment, weights=~keep) > 0
        whole = ~cut[segment]
        if whole.any():
            stable += _stretches(places[whole], segment[whole])
        places, segment = places[keep & ~whole], segment[keep & ~whole]
        if not len(places):
            break
        # a cut word leaves a gap behind, so pieces are what has none
        segment = np.concatenate([[0], np.cumsum((np.diff(places) != 1) | (np.diff(segment) != 0))])
        long_enough = (np.bincount(segment) >= MIN_WORDS)[segment]
        places, segment = places[long_enough], segment[long_enough]
        if len(segment):
            segment = np.concatenate([[0], np.cumsum(np.diff(segment) != 0)])
    return sorted(s for s in stable if s[1] - s[0] >= MIN_WORDS)


def _stretches(places: np.ndarray, segment: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(segment)) + 1
    firsts, lasts = np.concatenate([[0], edges]), np.concatenate([edges, [len(places)]]) - 1
    return [(int(places[a]), int(places[b]) + 1) for a, b in zip(firsts, lasts)]


def _equal_from(w: np.ndarray, i: int, q: int) -> int:
    """The first place from ``i`` on whose word differs from that ``q`` later."""
    end, step = len(w) - q, 64
    while i < end:
        to = min(end, i + step)
        differs = w[i:to] != w[i + q : to + q]
        if differs.any():
            return i + int(differs.argmax())
        i, step = to, step * 2
    return end


def _equal_back_to(w: np.ndarray, i: int, q: int) -> int:
    """The first place of the equal ones that reach up to ``i``."""
    step = 64
    while i > 0:
        to = max(0, i - step)
        differs = (w[to:i] != w[to + q : i + q])[::-1]
        if differs.any():
            return i - int(differs.argmax())
        i, step = to, step * 2
    return 0


def _candidates(w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags ``q`` from ``low`` up to but not including ``high`` and places, multiples of
    ``q``, from which three neighbouring multiples equal the next one each."""
    n, lags, places = len(w), [], []
    if low < 64:  # many multiples of few lags
        for q in range(low, high):
            same = w[:-q:q] == w[q::q]
            at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
            if len(at):
                lags.append(np.full(len(at), q))
                places.append(at * q)
    else:  # few multiples of many lags
        every = np.arange(low, high)
        for k in range((n - 1) // low - 2):
            q = every[: max(0, (n - 1) // (k + 3) - low + 1)]
            a, b, c, d = (w[(k + x) * q] for x in range(4))
            at = q[(a == b) & (b == c) & (c == d)]
            if len(at):
                lags.append(at)
                places.append(at * k)
    if not lags:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, i = np.concatenate(lags), np.concatenate(places)
    for part in (1, 3, 5, 7):  # all words between the multiples must be equal as well
        j = i + q * part // 4
        keep = w[j] == w[j + q]
        q, i = q[keep], i[keep]
    order = np.lexsort((i, q))
    return q[order], i[order]


def scan_lags(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``start, length, period`` of a segment."""
    n, runs = len(w), []
    inside: dict[int, list[tuple[int, int]]] = {}  # by lag: runs of a period that divides it

    def found(start: int, length: int, q: int) -> None:
        runs.append((start, length, q))
        for lag in range(2 * q, length // MIN_PERIODS + 1, q):
            inside.setdefault(lag, []).append((start, start + length - lag))

    same = np.concatenate([[False], w[1:] == w[:-1], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a + 1 >= MIN_WORDS:
            found(a, b - a + 1, 1)
    low, top = 2, n // MIN_PERIODS + 1
    while low < top:
        high = min(top, 2 * low)
        lags, places = _candidates(w, low, high)
        edges = np.flatnonzero(np.diff(lags)) + 1
        for at in np.split(np.arange(len(lags)), edges) if len(lags) else []:
            q, here = int(lags[at[0]]), places[at]
            for a, b in inside.pop(q, ()):
                here = here[(here < a) | (here >= b)]
            done = 0
            for i in here.tolist():
                if i < done:
                    continue
                start, done = _equal_back_to(w, i, q), _equal_from(w, i, q)
                if done - start + q >= max(MIN_WORDS, MIN_PERIODS * q):
                    found(start, done - start + q, q)
        low = high
    return runs


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """All runs ``start, length, period`` of a text's words, by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = [
        (first + start, length, period)
        for first, end in split_by_frequency(ids)
        for start, length, period in scan_lags(ids[first:end])
    ]
    return sorted(runs, key=lambda run: (run[0], run[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those behind the first period of a run, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def find_runs(text: Column) -> Column:
    """``runs`` of a text, by start, then period, and the ``collapsed`` text."""

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        runs, collapsed = [], []
        for value in texts:
            # bytes: split() then knows ASCII white space only
            words = value.as_buffer().to_pybytes().split() if value.is_valid else []
            here = runs_of(words)
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in here])
            collapsed.append(collapse(words, here))
        return pa.StructArray.from_arrays(
            [pa.array(runs, _RUNS_ARROW), pa.array(collapsed, pa.string())], ["runs", "collapsed"]
        )

    return find(text)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the document as it came) and ``p``: its ``runs`` and ``collapsed`` text."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.select("row", find_runs(F.col("row")[text]).alias("p"))
