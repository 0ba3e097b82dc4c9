from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from rowforge.llm import prefix_trie
from rowforge.llm.common import read
from rowforge.llm.prefix_trie import Forest, Item
from rowforge.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def brute(conversations):
    """Node by node: ``{id: [(turn, words), ...]}`` to figures and the ids that end there."""
    members, words = {}, {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            at = tuple(t for t, _ in turns[:d])
            members.setdefault(at, []).append(conv)
            words[at] = turns[d - 1][1] if d else 0
    children = {}
    for at in members:
        if at:
            children.setdefault(at[:-1], []).append(at)
    leaves, saved = {}, {}
    for at in sorted(members, key=len, reverse=True):
        below = children.get(at, [])
        leaves[at] = sum(leaves[c] for c in below) if below else 1
        saved[at] = (len(members[at]) - 1) * words[at] + sum(saved[c] for c in below)
    rows = []
    for at, inside in members.items():
        ends = sorted(c for c in inside if len(conversations[c]) == len(at))
        parent = min(members[at[:-1]]) if at else None
        rows.append(
            (min(inside), len(at), parent, len(inside), len(children.get(at, [])), leaves[at], saved[at], ",".join(map(str, ends)))
        )
    return sorted(rows, key=str)


def joined_by_hand(conversations, size, fan):
    """The forests of partitions of ``size`` sorted conversations, joined ``fan`` at a time."""
    rows = sorted(([t for t, _ in turns], conv, [w for _, w in turns]) for conv, turns in conversations.items())

    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    nodes, aliases, most = [], {}, 0

    def collect(forest):
        nodes.extend(zip(*(forest.nodes[k] for k in ("low", "depth", "parent", "size", "kids", "leaves", "saved", "ref"))))
        aliases.update(forest.aliases)

    units = []
    for u in range(0, len(rows), size):
        part = rows[u : u + size]
        items = [Item(len(p), 1, c, 0, 0, 0, str(p), len(p), w, path=p) for p, c, w in part]
        edges = [-1] + [shared(a[0], b[0]) for a, b in zip(part, part[1:])]
        forest = Forest(items, edges)
        units.append(forest.contract(prefix_trie._reference_base(0, len(units))))
        collect(forest)
    level = 0
    while level == 0 or len(units) > 1:
        level, last = level + 1, len(units) <= fan
        joined = []
        for u in range(0, len(units), fan):
            items, edges, before = [], [], None
            for some, borders in units[u : u + fan]:
                most = max(most, len(some))
                borders = [-1 if before is None else shared(before, some[0].path), *borders[1:]]
                items, edges, before = items + some, edges + borders, some[-1].path
            for item in items:
                item.waiting = []
            forest = Forest(items, edges)
            joined.append(forest.close() if last else forest.contract(prefix_trie._reference_base(level, len(joined))))
            collect(forest)
        units = joined
    found = [(low, d, aliases[ref] if ref is not None else parent, *rest) for low, d, parent, *rest, ref in nodes]
    return sorted(found, key=str), most


def made_up(rng, n, turns="abc", longest=8):
    return {
        conv: [(t, ord(t) % 7) for t in (rng.choice(turns) for _ in range(rng.randint(0, longest)))]
        for conv in rng.sample(range(10 * n), n)
    }


@pytest.mark.parametrize("size, fan", [(1, 2), (2, 2), (3, 2), (4, 3), (7, 5), (1000, 2)])
def test_forests_joined_across_borders_are_the_whole_trie(size, fan):
    rng = random.Random(size)
    for _ in range(150):
        conversations = made_up(rng, rng.randint(1, 60), rng.choice(["a", "ab", "abcd"]), rng.randint(0, 9))
        found, _ = joined_by_hand(conversations, size, fan)
        assert found == sorted((row[:7] for row in brute(conversations)), key=str), conversations


def test_contracted_forests_have_two_items_per_depth_at_most():
    rng = random.Random(1)
    conversations = made_up(rng, 3000, "ab", 6)
    found, most = joined_by_hand(conversations, 500, 2)
    assert found == sorted((row[:7] for row in brute(conversations)), key=str)
    assert most <= 2 * 7 + 2


def with_ends(nodes, ends):
    by_key = {}
    for r in sorted(ends.collect(), key=lambda r: r.first_id):
        by_key.setdefault(r.end_key, []).append(r.ids)
    return sorted(
        ((*(r[n] for n in NAMES), ",".join(by_key[r.end_key]) if r.end_key else "") for r in nodes.collect()), key=str
    )


def frame(spark, conversations):
    rows = [(c, i, t[0], " ".join("x" * t[1])) for c, turns in conversations.items() for i, t in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_trie_of_random_turns(spark, seed):
    rng = random.Random(seed)
    conversations = {c: t for c, t in made_up(rng, 40, "abc", 6).items() if t}
    nodes, ends = prefix_trie.prefix_trie(frame(spark, conversations))
    assert with_ends(nodes, ends) == brute(conversations)


def test_several_levels_long_shared_beginnings_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN", 2)
    monkeypatch.setattr(prefix_trie, "DEPTHS", (3, 5))
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rng = random.Random(8)
    conversations = {c: t for c, t in made_up(rng, 60, "ab", 12).items() if t}
    a, b, c, d = ((t, ord(t) % 7) for t in "abcd")
    conversations |= {1000 + i: [a, b] * 5 for i in range(30)}
    conversations |= {2000: [a, b] * 5 + [c] * 20, 3000: [d] * 3, 3001: [d] * 9}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    nodes, ends = prefix_trie.prefix_trie(frame(spark, conversations))
    assert with_ends(nodes, ends) == brute(conversations)
    assert ends.groupBy("end_key").count().where("count > 1").count() > 0
    hashes = {r.end_key: r.ends_sha256 for r in prefix_trie.hashed_ends(ends).collect()}
    keys = {r.conv_id: r.end_key for r in nodes.where("depth = 10").collect()}
    equal = sorted(c for c, t in conversations.items() if t == conversations[1000])
    assert hashes[keys[min(equal)]] == hashlib.sha256(",".join(map(str, equal)).encode()).hexdigest()


def test_nulls_ties_and_other_columns(spark):
    rows = [
        (1, None, "user", None, "x"),
        (1, 0, None, "hello there", "x"),
        (2, 0, None, "hello there", "y"),
        (2, None, "user", "", "y"),
        (None, 0, "user", "nobody's", "z"),
        (3, 5, "user", "", None),
        (3, 5, "user", "", None),
        (4, 1, "user\x00", "a", None),
        (5, 1, "user", "\x00a", None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    nodes, ends = prefix_trie.prefix_trie(turns)
    a, b = (("user", ""), 0), (("", "hello there"), 2)
    want = {1: [a, b], 2: [a, b], 3: [a, a], 4: [(("user\x00", "a"), 1)], 5: [(("user", "\x00a"), 1)]}
    assert with_ends(nodes, ends) == brute(want)
    nodes, ends = prefix_trie.prefix_trie(turns.limit(0))
    assert nodes.collect() == [] and ends.collect() == []


def expected(rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    plain = {c: [((r, t), len(t.encode().split())) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = plain.get(c - c % 20, [])[:h] + own[h:]
    return [(*row[:7], hashlib.sha256(row[7].encode()).hexdigest()) for row in brute(rebuilt)]


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_query_agrees_with_brute_force(spark, folder):
    got = QUERIES["op13_prefix_trie"](spark, folder).select(*NAMES, "ends_sha256")
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def test_heads_that_are_short_or_absent(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        (c, i, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", None]))
        for c in [*range(0, 60), *range(81, 100)]
        if c != 20
        for i in range(rng.randint(1, 2) if c % 20 == 0 else rng.randint(1, 5))
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, str(tmp_path)).select(*NAMES, "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)
