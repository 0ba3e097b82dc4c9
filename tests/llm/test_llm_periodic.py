from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from rowforge.llm import periodic
from rowforge.llm.common import read
from rowforge.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def brute(words):
    """Every lag over the whole text; a run's period must have no smaller one."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[i + k] == words[i + k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_up(rng):
    words = []
    for _ in range(rng.randint(0, 12)):
        letters = rng.choice("ab abc abcdef".split())
        block = [rng.choice(letters).encode() for _ in range(rng.randint(1, 9))]
        words += (block * rng.randint(1, 8))[: rng.randint(1, 60)]
    return words


def test_runs_agree_with_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        words = made_up(rng)
        assert periodic.runs_of(words) == brute(words), words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70))
def test_runs_of_any_words(words):
    assert periodic.runs_of(words) == brute(words)


@pytest.mark.parametrize(
    "words, runs",
    [
        ([b"a"] * 5, []),
        ([b"a"] * 6, [(0, 6, 1)]),
        ([b"a", b"b"] * 3 + [b"a"], []),
        ([b"a", b"b"] * 4, [(0, 8, 2)]),
        ([b"x"] + [b"a", b"b", b"c"] * 4 + [b"a", b"x"], [(1, 13, 3)]),
        # a run of runs: both periods count
        (([b"a"] * 6 + [b"b"]) * 4, [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]),
    ],
)
def test_bounds_of_a_run(words, runs):
    assert periodic.runs_of(words) == runs


def test_rare_words_split_until_nothing_changes():
    # the cut at the rare word leaves too few of the words on its left
    words = [b"c", b"a", b"b", b"a", b"b", b"a", b"rare"] + [b"a", b"b"] * 5
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    assert periodic.split_by_frequency(__import__("numpy").array([ids[w] for w in words])) == [(7, 17)]


@pytest.mark.parametrize("period", [1, 2, 777, 50_000])
def test_long_texts(period):
    words = [b"start"] + [b"%d" % (i % period) for i in range(200_000)]
    assert periodic.runs_of(words) == [(1, 200_000, period)]


def test_columns_nulls_and_repeated_rows(spark):
    rows = [
        (1, "go go go go go go on", "r", 1),
        (1, "go go go go go go on", "r", 1),
        (2, None, None, None),
        (3, "", "x", 2),
        (None, " \t one\x1ctwo \n", "x", 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, p int")
    got = periodic.periodic_runs(docs)
    found = sorted(got.select("row.*", F_runs(), "p.collapsed").collect(), key=str)
    assert got.select("row.*").columns == docs.columns
    assert [(r.runs, r.collapsed) for r in found if r.doc_id == 1] == [([(0, 6, 1)], "go on")] * 2
    assert [(r.runs, r.collapsed) for r in found if r.doc_id != 1 ] == [([], ""), ([], ""), ([], "one\x1ctwo")]
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def F_runs():
    from pyspark.sql import functions as F

    return F.transform("p.runs", lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs")


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def test_query_agrees_with_brute_force(spark):
    got = QUERIES["op12_periodic_runs"](spark, SMALL)
    docs = read(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect())) == sorted(expected(*d) for d in docs)
    assert sum(r.n_runs for r in got.collect()) >= 10
