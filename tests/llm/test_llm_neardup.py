from __future__ import annotations

import random

import numpy as np
import pytest

from rowforge.llm import neardup, shingles
from rowforge.llm.components import connected_components


def shingle_sets(rows):
    out = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - 4)
        out.append({tuple(words[i : i + 5]) for i in range(n)} if words else set())
    return out


def brute(rows):
    """Smallest id reachable over links of 85 per cent, row by row."""
    sets = shingle_sets(rows)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        if key is not None:
            least[r] = min(least.get(r, key), key)
    return [(key, len(s), least.get(root(i))) for i, ((key, _), s) in enumerate(zip(rows, sets))]


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        rows.append(" ".join(rng.choices(words, k=rng.randint(3, 400))))
    passage = " ".join(rng.choices(words, k=60))
    for _ in range(40):  # a passage that many share
        rows.append(passage + " " + " ".join(rng.choices(words, k=rng.randint(5, 120))))
    base = rng.choices(words, k=200)
    for _ in range(80):  # near copies on both sides of the threshold, chains among them
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(200)] = rng.choice(words)
        rows.append(" ".join(copy))
    chain = rng.choices(words, k=150)
    for _ in range(12):  # each alike the one before only
        chain = chain[4:] + rng.choices(words, k=4)
        rows.append(" ".join(chain))
    rows += [rows[3], rows[3].upper(), rows[70], rows[70] + "  "]
    rows += [None, "", " \n\t", "one two", "One  TWO", "one two three four five", "É é", "é É", "x" * 100_000]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def run(spark, data, **options):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return df, neardup.near_duplicates(df, **options).collect()


def test_groups_agree_with_brute_force(spark):
    rows = corpus()
    _, got = run(spark, rows)
    assert sorted(tuple(r)[:3] for r in got) == sorted(brute(rows))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_open_buckets_are_closed_exactly(spark, monkeypatch):
    """With one row per band buckets are full of strangers; groups must not change."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 3)
    rows = corpus()
    _, got = run(spark, rows, bands=24, rows=2)
    assert sorted(tuple(r)[:3] for r in got) == sorted(brute(rows))


@pytest.mark.parametrize(
    "rows",
    [[], [(1, None)], [(5, "a b c"), (5, "a b c"), (None, "a b c"), (5, "other words here")], [(None, "a b"), (None, "a b"), (None, None)]],
)
def test_odd_tables(spark, rows):
    df, got = run(spark, rows)
    assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(map(repr, brute(rows) if rows else []))


def test_stage_keeps_one_row_of_each_group(spark):
    rows = [(9, "a b c d e f g", 1), (4, "a b c d e f g", 2), (4, "a b c d e f g", 2), (7, "else", 3), (7, "a B c d e f G", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int").selectExpr("*", "1 as row", "2 as __x")
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, (tuple(r)[:3] for r in kept.collect()))) == sorted(
        map(repr, [(4, "a b c d e f g", 2), (7, "else", 3), (None, None, 5)])
    )


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    shared, a, b = (np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (800, 200, 200))
    x, y = (shingles.signature(np.unique(np.concatenate([shared, s])), 240) for s in (a, b))
    assert abs((x == y).mean() - 800 / 1200) < 0.1
    keys = shingles.band_keys(x, 40, 6)
    assert len(keys) == 40 and len(set(keys.tolist())) == 40


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100), (7, 200)]])
def test_components(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in parent)


def test_agrees_with_brute_force_on_given_documents(spark):
    """Sets built from word tuples here, links from an inverted index over all of them."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, holders = {}, defaultdict(list)
    for doc_id, text in docs.collect():
        words = (text or "").encode().lower().split()
        width = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
        for shingle in sets[doc_id]:
            holders[shingle].append(doc_id)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, shingles in sets.items():
        shared = Counter(other for x in shingles for other in holders[x] if other < d)
        for other, n in shared.items():
            if 100 * n >= 85 * (len(shingles) + len(sets[other]) - n):
                a, b = sorted((find(d), find(other)))
                root[b] = a
    want = sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())
    got = neardup.near_duplicates(docs).drop("digest")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_bounds_keep_every_pair_at_the_threshold():
    from rowforge.llm.shingles import parity_sketch

    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 2**64, rng.integers(1, 400), dtype=np.uint64)
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**64, rng.integers(0, 80), dtype=np.uint64)]))
        a = np.unique(a)
        differ = sum(int(x).bit_count() for x in (parity_sketch(a) ^ parity_sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_copies_just_below_the_threshold_share_no_pairs_but_keep_their_links(spark, monkeypatch):
    """Many copies of one text, each with some words changed: most are below the threshold."""
    import random

    monkeypatch.setattr(neardup, "SMALL_BUCKET", 0)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4])):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
