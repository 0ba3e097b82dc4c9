"""The prefix trie of conversations, from union-find over sorted neighbours.

Every distinct sequence of first turns is a node. Conversations are sorted by their turns
over range partitions; the number of turns that a conversation shares with the one before it
is an edge between the two. Edges are taken from the deepest up, and each unites the two
components it touches: where they meet, a node branches, and what a component had below is
settled for good and goes out. So a partition's trie comes from one pass over its edges.

Only what reaches over the borders of a partition stays open: the edges that are a minimum
from one of the borders on. They leave one item per depth at each border, the contracted
forest. The contracted forests of ``FAN`` neighbouring partitions are joined by the edges
across their borders and go through the same union-find, until one is left. An item has
figures and no members, so no task ever sees more of a forest than two items per depth.

Turns are compared by 128-bit digests. A conversation is sorted by no more turns than it
takes to be alone: beyond 64 (then 4,096) turns only those that share so many with another
one are compared further. What follows is a chain of nodes with one member.

Defined cases: rows without a conversation id belong to no conversation and are left out; a
null role or text is an empty one; a null turn comes first, equal turns are ordered by their
digests; repeated rows are repeated turns; other columns are not read; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import group_row_number
from ..session import durable
from .common import count_words, shuffle_partitions

#: Neighbouring forests joined in one task.
FAN = 64

#: Turns by which conversations are sorted, unless they share so many with another one.
DEPTHS = (64, 4096)

#: Ids of one row of ``ends``.
CHUNK = 8192

#: Characters of a turn's digest.
_DIGEST = 32

_OUT = pa.schema(
    [
        ("kind", pa.string()),  # node, alias, chunk or item
        ("depth", pa.int32()),
        ("low", pa.int64()),
        ("parent", pa.int64()),
        ("ref", pa.int64()),
        ("size", pa.int64()),
        ("kids", pa.int64()),
        ("leaves", pa.int64()),
        ("saved", pa.int64()),
        ("end_key", pa.string()),
        ("ids", pa.string()),
        ("unit", pa.int64()),
        ("place", pa.int32()),
        ("edge", pa.int32()),
        ("end_depth", pa.int32()),
        ("words", pa.list_(pa.int64())),
        ("refs", pa.list_(pa.int64())),
        ("path", pa.string()),
    ]
)
_OUT_DDL = (
    "kind string, depth int, low long, parent long, ref long, size long, kids long, leaves long, saved long, "
    "end_key string, ids string, unit long, place int, edge int, end_depth int, words array<long>, "
    "refs array<long>, path string"
)


class Item:
    """A component: the node it reaches up to at ``depth``, and figures of all below it."""

    __slots__ = ("depth", "size", "low", "kids", "leaves", "saved", "end_key", "end_depth", "words", "refs", "waiting", "path")

    def __init__(self, depth, size, low, kids, leaves, saved, end_key, end_depth, words, refs=(), path=None):
        self.depth, self.size, self.low, self.kids, self.saved = depth, size, low, kids, saved
        self.leaves = leaves  # below the node; the node itself is one if it has no child
        self.end_key, self.end_depth = end_key, end_depth  # of the first member
        self.words = words  # per turn up to the node, None if a neighbour has them
        self.refs = list(refs)  # under which settled children wait for the node's first member
        self.waiting: list[int] = []  # settled children of this task
        self.path = path


class Forest:
    """Union-find over neighbouring items; settled nodes collect in columns."""

    def __init__(self, items: list[Item], edges: list[int]):
        self.items = items
        self.edges = edges  # edges[j] is shared by items j - 1 and j
        self.leader = list(range(len(items)))
        self.nodes: dict[str, list] = {
            name: [] for name in ("depth", "low", "parent", "ref", "size", "kids", "leaves", "saved", "end_key")
        }
        self.aliases: list[tuple[int, int]] = []

    def _find(self, i: int) -> int:
        leader = self.leader
        while leader[i] != i:
            leader[i] = leader[leader[i]]
            i = leader[i]
        return i

    def settle(self, item: Item, above: int) -> None:
        """Puts out the chain of nodes from the item's own up to below ``above``; the item
        becomes the node at ``above`` with this one child."""
        nodes, depth, low = self.nodes, item.depth, item.low
        for row in item.waiting:
            nodes["parent"][row] = low
        self.aliases += [(ref, low) for ref in item.refs]
        leaves, saved, kids = item.leaves if item.kids else 1, item.saved, item.kids
        end_key = item.end_key if item.end_depth == depth else None
        for d in range(depth, above, -1):
            if d:
                saved += (item.size - 1) * item.words[d - 1]
            nodes["depth"].append(d)
            nodes["low"].append(low)
            nodes["parent"].append(low if d > above + 1 else None)
            nodes["ref"].append(None)
            nodes["size"].append(item.size)
            nodes["kids"].append(kids)
            nodes["leaves"].append(leaves)
            nodes["saved"].append(saved)
            nodes["end_key"].append(end_key)
            kids, end_key = 1, None
        item.depth, item.kids, item.leaves, item.saved = above, 1, leaves, saved
        item.refs, item.waiting = [], [len(nodes["depth"]) - 1]

    def unite(self, j: int) -> None:
        """The two components at edge ``j`` meet in the node at its depth."""
        a, b = self._find(j - 1), self._find(j)
        left, right, depth = self.items[a], self.items[b], self.edges[j]
        for item in (left, right):
            if item.depth > depth:
                self.settle(item, depth)
        big, small = (a, b) if left.size >= right.size else (b, a)
        self.leader[small] = big
        waiting, more = sorted((left.waiting, right.waiting), key=len, reverse=True)
        waiting += more
        left.refs += right.refs
        left.size += right.size
        left.low = min(left.low, right.low)
        left.kids += right.kids
        left.leaves += right.leaves
        left.saved += right.saved
        left.words = right.words if left.words is None else left.words
        left.waiting = waiting
        self.items[big] = left

    def _open_edges(self) -> np.ndarray:
        """Edges that are a minimum from the first or the last item on."""
        edges = np.array(self.edges[1:], np.int64)
        from_left = edges <= np.minimum.accumulate(edges)
        from_right = edges <= np.minimum.accumulate(edges[::-1])[::-1]
        return np.concatenate([[False], from_left | from_right])

    def contract(self, base: int) -> tuple[list[Item], list[int]]:
        """Unites what no neighbour can reach; what is left, one item per depth and border,
        and its edges. New references count from ``base``."""
        if len(self.items) == 1:
            return self.items, [-1]
        is_open = self._open_edges()
        order = np.argsort(-np.array(self.edges), kind="stable")
        for j in order[~is_open[order]].tolist():
            if j:
                self.unite(j)
        at = [0, *np.flatnonzero(is_open).tolist()]
        parts = [self.items[self._find(j)] for j in at]
        between = [self.edges[j] for j in at[1:]]
        out, edges = [parts[0]], [-1]
        for k in range(1, len(parts) - 1):
            item, depth = parts[k], max(between[k - 1], between[k])
            if item.depth > depth:
                self.settle(item, depth)
            last = out[-1]
            if len(out) > 1 and last.depth == depth == between[k - 1]:
                # another part of the same node
                last.size += item.size
                last.low = min(last.low, item.low)
                last.kids += item.kids
                last.leaves += item.leaves
                last.saved += item.saved
                last.refs += item.refs
                last.waiting += item.waiting
            else:
                out.append(item)
                edges.append(between[k - 1])
        out.append(parts[-1])
        edges.append(between[-1])
        for k, item in enumerate(out):
            if item.waiting:
                for row in item.waiting:
                    self.nodes["ref"][row] = base + k
                item.refs.append(base + k)
            if 0 < k < len(out) - 1:
                item.words = item.path = None  # those of the first or the last item begin with them
        return out, edges

    def close(self) -> None:
        """Unites all, down to the root."""
        for j in np.argsort(-np.array(self.edges[1:], np.int64), kind="stable").tolist():
            self.unite(j + 1)
        self.settle(self.items[self._find(0)], -1)


def _batch(kind: str, columns: dict[str, list]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns = {"kind": [kind] * n, **columns}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT],
        schema=_OUT,
    )


def _put_out(forest: Forest, unit: int, left: tuple[list[Item], list[int]] | None) -> Iterator[pa.RecordBatch]:
    yield _batch("node", forest.nodes)
    yield _batch("alias", {"ref": [r for r, _ in forest.aliases], "low": [x for _, x in forest.aliases]})
    if left:
        items, edges = left
        names = ("depth", "size", "low", "kids", "leaves", "saved", "end_key", "end_depth", "words", "refs", "path")
        columns = {name: [getattr(item, name) for item in items] for name in names}
        yield _batch("item", {**columns, "edge": edges, "unit": [unit] * len(items), "place": list(range(len(items)))})


def _shared(a: str, b: str) -> int:
    """How many digests two paths begin with alike."""
    if a == b:
        return len(a) // _DIGEST
    low, high = 0, min(len(a), len(b)) // _DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * _DIGEST] == b[: middle * _DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


def _reference_base(level: int, unit: int) -> int:
    return (level << 58) | (unit << 30)


def _partition_forest(chunk_ids: int):
    """Nodes, ends and the contracted forest of one sorted partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = TaskContext.get().partitionId()
        items: list[Item] = []
        edges: list[int] = []
        before, end_key, ids = None, None, []
        for batch in batches:
            chunks = {"end_key": [], "low": [], "ids": []}

            def put_chunk() -> None:
                if ids:
                    chunks["end_key"].append(end_key)
                    chunks["low"].append(ids[0])
                    chunks["ids"].append(",".join(map(str, ids)))
                    ids.clear()

            rows = zip(*(batch.column(name).to_pylist() for name in ("conv", "turns", "path", "words")))
            for conv, turns, path, words in rows:
                depth, same = len(path) // _DIGEST, path == before
                ended = depth == turns
                if not same or not ended or len(ids) == chunk_ids:
                    put_chunk()
                if not same:
                    end_key = hashlib.md5(path.encode()).hexdigest()
                if ended:
                    ids.append(conv)
                edges.append(-1 if before is None else _shared(before, path))
                if len(items) > 1:
                    items[-1].path = None  # only the first and the last one's are asked for
                # one that goes on is alone from here on: a chain hangs below it
                going_on = 0 if ended else 1
                items.append(Item(depth, 1, conv, going_on, going_on, 0, end_key, depth if ended else -1, words, path=path))
                before = path
            yield _batch("chunk", chunks)
        if ids:
            yield _batch("chunk", {"end_key": [end_key], "low": [ids[0]], "ids": [",".join(map(str, ids))]})
        if items:
            forest = Forest(items, edges)
            left = forest.contract(_reference_base(0, unit))
            yield from _put_out(forest, unit, left)

    return build


def _joined_forest(level: int, last: bool, fan: int):
    """Joins the contracted forests of neighbouring units."""

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["unit"], r["place"]))
        items, edges, before = [], [], None
        for r in rows:
            edges.append(r["edge"] if r["place"] else -1 if before is None else _shared(before, r["path"]))
            items.append(
                Item(
                    r["depth"], r["size"], r["low"], r["kids"], r["leaves"], r["saved"], r["end_key"], r["end_depth"],
                    r["words"], r["refs"], r["path"],
                )
            )
            before = before if r["path"] is None else r["path"]
        forest, unit = Forest(items, edges), rows[0]["unit"] // fan
        left = forest.close() if last else forest.contract(_reference_base(level, unit))
        return pa.Table.from_batches(_put_out(forest, unit, left), schema=_OUT)

    return join


def turn_keys(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv, place, key, words`` of every turn: its place from 0, its digest, its length."""
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    narrow = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv"),
        F.col(turn).alias("turn"),
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said)).alias("key"),
        count_words(said).alias("words"),
    )
    ranked = group_row_number(narrow, ["conv"], [F.asc_nulls_first("turn"), F.col("key")], "place")
    return ranked.select("conv", (F.col("place") - 1).alias("place"), "key", "words")


def _paths(keys: DataFrame, conversations: DataFrame) -> DataFrame:
    """``conv, turns, path, words``: the digests that a conversation is sorted by."""
    first = DEPTHS[0]
    at = F.struct("place", "key", "words")
    prints = [
        # digests of turns and places; their combination does not hang on the order of rows
        F.bit_xor(F.when(F.col("place") < depth, of)).alias(f"print{k}_{depth}")
        for depth in DEPTHS
        for k, of in enumerate((F.xxhash64("place", "key"), F.xxhash64("key", "place")))
    ]
    heads = durable(
        keys.groupBy("conv").agg(
            F.count("*").alias("turns"), *prints, F.collect_list(F.when(F.col("place") < first, at)).alias("head")
        )
    )
    alone = None  # conversations, and the depth from which each is alone
    for depth in DEPTHS:
        single = (
            heads.where(F.col("turns") >= depth)
            .groupBy(f"print0_{depth}", f"print1_{depth}")
            .agg(F.count("*").alias("n"), F.min("conv").alias("conv"))
            .where("n = 1")
            .select("conv", F.lit(depth).cast("long").alias("alone"))
        )
        alone = single if alone is None else alone.union(single)
    alone = alone.groupBy("conv").agg(F.min("alone").alias("alone"))
    needed = heads.join(alone, "conv", "left").withColumn("needed", F.least("turns", F.coalesce("alone", "turns")))
    rest = (
        keys.where(F.col("place") >= first)
        .join(needed.where(F.col("needed") > first).select("conv", "needed"), "conv")
        .where("place < needed")
        .groupBy("conv")
        .agg(F.collect_list(at).alias("rest"))
    )
    empty = F.array().cast(heads.schema["head"].dataType)
    whole = conversations.join(needed.join(rest, "conv", "left"), "conv", "left").withColumn(
        "turn", F.sort_array(F.concat(F.coalesce("head", empty), F.coalesce("rest", empty)))
    )
    return whole.select(
        "conv",
        F.coalesce("turns", F.lit(0)).alias("turns"),
        F.array_join("turn.key", "").alias("path"),
        F.col("turn.words").alias("words"),
    )


def _tails(keys: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes below the turns that a conversation is sorted by; it is alone in them."""
    beyond = paths.select("conv", "turns", (F.length("path") / _DIGEST).cast("long").alias("needed")).where("turns > needed")
    is_end = F.col("place") + 1 == F.col("turns")
    return keys.where(F.col("place") >= DEPTHS[0]).join(beyond, "conv").where("place >= needed").select(
        (F.col("place") + 1).cast("int").alias("depth"),
        F.col("conv").alias("low"),
        F.col("conv").alias("parent"),
        F.lit(None).cast("long").alias("ref"),
        F.lit(1).cast("long").alias("size"),
        F.when(is_end, 0).otherwise(1).cast("long").alias("kids"),
        F.lit(1).cast("long").alias("leaves"),
        F.lit(0).cast("long").alias("saved"),
        F.when(is_end, F.concat(F.lit("alone:"), F.col("conv").cast("string"))).alias("end_key"),
    )


def trie_of_keys(keys: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``prefix_trie`` of turns given as ``conv, place, key, words`` (places from 0, without
    gaps) and of all ``conversations`` (``conv``, distinct), those without turns included."""
    spark = keys.sparkSession
    paths = durable(_paths(keys, conversations))
    units = shuffle_partitions(spark)
    # a fixed number of partitions: their numbers are those of the ranges
    ordered = paths.repartitionByRange(units, "path", "conv").sortWithinPartitions("path", "conv")
    found = [durable(ordered.mapInArrow(_partition_forest(CHUNK), _OUT_DDL))]
    level = 0
    while level == 0 or units > 1:
        level, units = level + 1, -(-units // FAN)
        items = found[-1].where("kind = 'item'")
        neighbours = items.groupBy(F.floor(F.col("unit") / FAN).alias("together"))
        found.append(durable(neighbours.applyInArrow(_joined_forest(level, units == 1, FAN), _OUT_DDL)))

    def every(kind: str, *names: str) -> DataFrame:
        out = None
        for part in found:
            rows = part.where(F.col("kind") == kind).select(*names)
            out = rows if out is None else out.unionByName(rows)
        return out

    figures = ["depth", "low", "size", "kids", "leaves", "saved", "end_key"]
    tails = _tails(keys, paths)
    nodes = every("node", *figures, "parent", "ref").unionByName(tails)
    # children that were settled before their parent's first member was known
    aliases = every("alias", "ref", "low").select("ref", F.col("low").alias("parent"))
    late = nodes.where("ref is not null").drop("parent").join(aliases, "ref").select(*figures, "parent")
    nodes = nodes.where("ref is null").select(*figures, "parent").unionByName(late)
    ends = every("chunk", "end_key", "low", "ids").unionByName(
        tails.where("end_key is not null").select("end_key", "low", F.col("low").cast("string").alias("ids"))
    )
    return (
        nodes.select(
            F.col("low").alias("conv_id"),
            F.col("depth").cast("long").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            F.col("size").alias("n_convs"),
            F.col("kids").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            "end_key",
        ),
        ends.select("end_key", F.col("low").alias("first_id"), "ids"),
    )


def prefix_trie(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The nodes, and the conversations that end in them.

    Nodes: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (words that members need not
    repeat, over the subtree) and ``end_key`` (null if no conversation ends there). Ends:
    ``end_key, first_id, ids``; the ids that end in a node, ascending, in rows of at most
    ``CHUNK``, to be read in the order of ``first_id``.
    """
    keys = durable(turn_keys(turns, conversation, turn, role, text))
    return trie_of_keys(keys, keys.select("conv").distinct())


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``end_key, ends_sha256`` of all ids of a node, comma-joined; rows of ids are read one
    after the other, so a long list is never held."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, digests = [], []
            for key, ids in zip(batch.column("end_key").to_pylist(), batch.column("ids").to_pylist()):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        digests.append(state.hexdigest())
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["end_key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["end_key", "ends_sha256"])

    ordered = ends.repartition("end_key").sortWithinPartitions("end_key", "first_id")
    return ordered.mapInArrow(read, "end_key string, ends_sha256 string")
