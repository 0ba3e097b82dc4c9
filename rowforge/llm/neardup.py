"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

1. Every text becomes a set of shingles and a signature from two permutations (see
   ``shingles``). Texts with equal sets form a class, so copies are never compared.
2. Classes meet in buckets, one per band. A bucket is a star: its members are compared
   with its smallest member.
3. What a star leaves open is closed exactly: where members of a bucket are still in
   different components, every member outside the bucket's largest component is compared
   with all members of other components. Where that would be many pairs, as among copies
   just below the threshold, members first have to share one of their rarest shingles,
   which no pair above the threshold can do without.
4. Comparisons read the full sets; only links confirmed there count. Components of the
   links, taken over classes, are the groups.

So no group's pairs are written out: pairs within a component need no comparison. A pair
at the threshold is missed by all bands with probability ``(1 - t^rows)^bands``, below
1e-8 with the defaults and 6e-6 at a threshold of 80.

Sets hold 64-bit hashes of shingles; two shingles of a pair of texts coincide with a
probability below 1e-10.

Defined cases: a null or empty text, or one without words, has no shingles and links with
nothing; a text of fewer words than a shingle is one shingle; equal rows, also with equal
ids, are one class; a null id links like any other, and the component is the smallest id
that is not null, or null; other columns are carried unread; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable, durable_narrow
from .components import connected_components
from .shingles import SKETCH_WORDS, band_keys, parity_sketch, set_key, shingle_set, signature

WIDTH = 5
#: Per cent of the union that the intersection must reach.
THRESHOLD = 85
BANDS = 40
ROWS = 6

#: Pairs of different components up to which a bucket is compared as it is.
SMALL_BUCKET = 16

_SIGNED = "id long, digest string, n_shingles long, k1 long, k2 long, bands array<long>"


def _digest(text):
    return F.md5(F.coalesce(text, F.lit("")))


def _signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Size of the set, its key and its band keys for every row of ``id, digest, text``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, keys, found = [], [], []
                for text in part.column(2).to_pylist():
                    shingles = shingle_set(text, width)
                    sizes.append(len(shingles))
                    keys.append(set_key(shingles))
                    found.append(band_keys(signature(shingles, bands * rows), bands, rows) if len(shingles) else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(sizes, pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.array(found, pa.list_(pa.int64())),
                    ],
                    ["id", "digest", "n_shingles", "k1", "k2", "bands"],
                )

    return docs.mapInArrow(sign, _SIGNED)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``v, shingles`` of the wanted classes (``v, id, digest, k1, k2``), from one text of each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pylist()
                sets = [shingle_set(row["text"], width) for row in rows]
                keep = [
                    (row["v"], s.tobytes())
                    for row, s in zip(rows, sets)
                    if set_key(s) == (row["k1"], row["k2"])
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keep], pa.int64()), pa.array([k[1] for k in keep], pa.binary())],
                    ["v", "shingles"],
                )

    # rows of one id are told apart by their texts
    texts = docs.alias("d").join(wanted.alias("w"), F.expr("d.digest = w.digest and d.id <=> w.id"))
    texts = texts.select("v", "k1", "k2", "text")
    return texts.mapInArrow(build, "v long, shingles binary")


def _alike(threshold: int):
    """Whether the exact Jaccard similarity of two sets reaches the threshold."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        found = []
        for a, b in zip(left, right):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            found.append(100 * shared >= threshold * (len(x) + len(y) - shared))
        return pd.Series(found, dtype=bool)

    return alike


def _near_sizes(a: str, b: str, threshold: int) -> str:
    """The similarity cannot exceed the quotient of the sizes."""
    return f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})"


class _Links:
    """Confirmed links between classes, and the components they make."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, threshold: int):
        self.docs, self.classes, self.width, self.threshold = docs, classes, width, threshold
        self.tested: DataFrame | None = None
        self.components: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> None:
        """Compares the distinct pairs ``u, v`` and takes the confirmed ones in."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        pairs = durable_narrow(pairs)
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("v"))
        wanted = self.classes.join(wanted, "v", "left_semi").select("v", "id", "digest", "k1", "k2")
        sets = durable(_sets(self.docs, wanted, self.width).dropDuplicates(["v"]))
        compared = (
            pairs.join(sets.select("v", F.col("shingles").alias("right")), "v")
            .join(sets.select(F.col("v").alias("u"), F.col("shingles").alias("left")), "u")
            .where(_alike(self.threshold)("left", "right"))
        )
        edges = durable(compared.select("u", "v"))
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        if edges.isEmpty():
            return
        if self.components is not None:  # what is linked already, as stars
            edges = edges.union(self.components.select("u", F.col("component").alias("v")))
        self.components = connected_components(edges)

    def labelled(self, rows: DataFrame, key: str = "v", name: str = "component") -> DataFrame:
        """Adds the component of a class; a class without links is its own."""
        if self.components is None:
            return rows.withColumn(name, F.col(key))
        of = self.components.select(F.col("u").alias(key), F.col("component").alias("__c"))
        return rows.join(of, key, "left").withColumn(name, F.coalesce("__c", key)).drop("__c")


def _cross_pairs(
    rows: DataFrame, threshold: int, most: int | None = None, far: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pairs ``u, v`` of different components that share a key (``key, v, n, component``):
    members outside the key's largest component with all others. ``far`` is a condition on
    ``a`` and ``b``, the rows of a pair, under which it cannot reach the threshold. With
    ``most``, only of keys with so many pairs at most; the second frame holds the other
    keys."""
    per_component = rows.groupBy("key", "component").agg(F.count("*").alias("many"))
    keys = durable_narrow(
        per_component.groupBy("key")
        .agg(
            F.sum("many").alias("all"),
            F.max(F.struct("many", "component")).alias("top"),
            F.count("*").alias("components"),
        )
        .where("components > 1")
        .select("key", F.col("top.component").alias("largest"), ((F.col("all") - F.col("top.many")) * F.col("all")).alias("pairs"))
    )
    few = F.col("pairs") <= most if most is not None else F.lit(True)
    here = rows.join(keys.where(few), "key")
    near = F.expr("a.key = b.key and a.component != b.component") & F.expr(_near_sizes("a.n", "b.n", threshold))
    if far:
        near = near & ~F.expr(far)
    pairs = here.where("component != largest").alias("a").join(here.alias("b"), near)
    pairs = pairs.select(F.expr("least(a.v, b.v)").alias("u"), F.expr("greatest(a.v, b.v)").alias("v"))
    return pairs, keys.where(~few).select("key")


_CELLS = [f"s{i}" for i in range(SKETCH_WORDS)]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``v, key`` for every shingle of a set."""
    for batch in batches:
        for v, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), v)), pa.array(keys)], ["v", "key"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``v`` and the parity sketch of a set."""
    for batch in batches:
        found = [parity_sketch(np.frombuffer(raw, np.uint64)) for raw in batch.column(1).to_pylist()]
        cells = np.array(found, np.int64).reshape(len(found), SKETCH_WORDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in cells.T]], ["v", *_CELLS])


def _prefix_pairs(members: DataFrame, links: _Links, threshold: int) -> DataFrame:
    """Pairs of different components among ``v, n, component`` that can reach the threshold.

    Two such sets share one of the rarest ``n - threshold * n + 1`` shingles of either, so
    classes meet in these alone, and one that has nearly all of them for itself meets none.

    Of those that meet, two bounds leave out nearly all below the threshold, and none above
    it. Rare shingles come first, so all before the first shared one are in one set only; and
    parity sketches differ in no more cells than there are such shingles.
    """
    wanted = links.classes.join(members.select("v"), "v").select("v", "id", "digest", "k1", "k2")
    sets = durable(_sets(links.docs, wanted, links.width).dropDuplicates(["v"]))
    single = durable(sets.mapInArrow(_prefixes, "v long, key long"))
    sketches = sets.mapInArrow(_sketches, "v long, " + ", ".join(f"{c} long" for c in _CELLS))
    known = single.groupBy("key").agg(F.count("*").alias("df"))
    ranked = single.join(known, "key").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("ranked"))
    rarest = F.slice("ranked", 1, (F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1).cast("int"))
    rarest = F.transform(rarest, lambda x, at: F.struct(x["df"].alias("df"), x["key"].alias("key"), at.alias("at")))
    rows = ranked.join(members, "v").select("v", "n", "component", F.inline(rarest)).where("df > 1").drop("df")
    rows = durable(rows.join(sketches, "v"))
    # in one set only: at least so many; at the threshold: at most that share of all
    cells = " + ".join(f"bit_count(a.{c} ^ b.{c})" for c in _CELLS)
    alone = f"greatest(a.n - b.n, b.n - a.n, a.at + b.at, {cells})"
    left = "least(a.n - a.at, b.n - b.at)"
    far = f"""(100 + {threshold}) * {alone} > (100 - {threshold}) * (a.n + b.n)
        or {threshold} * (a.at + b.at) > (100 - {threshold}) * {left}"""
    return _cross_pairs(rows, threshold, far=far)[0]


def _open_pairs(members: DataFrame, links: _Links, threshold: int) -> DataFrame:
    """Pairs of different components that still meet in a bucket (``key, v, n``)."""
    members = durable_narrow(links.labelled(members))
    pairs, wide = _cross_pairs(members, threshold, SMALL_BUCKET)
    if wide.isEmpty():
        return pairs.distinct()
    met = members.join(wide, "key", "left_semi").select("v", "n", "component").distinct()
    return pairs.union(_prefix_pairs(durable_narrow(met), links, threshold)).distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
    threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` and the digest of the text for every row."""
    docs = docs.select(
        F.col(key).cast("long").alias("id"), _digest(F.col(text)).alias("digest"), F.col(text).alias("text")
    )
    signed = durable(_signed(docs, width, bands, rows))
    classes = durable(
        signed.where("n_shingles > 0")
        .groupBy("k1", "k2")
        .agg(
            F.min("id").alias("id"),
            F.min(F.struct(F.col("id").isNull(), "id", "digest"))["digest"].alias("digest"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        )
        .withColumn("v", F.monotonically_increasing_id())
    )
    placed = classes.select("v", "n", F.explode("bands").alias("key"))
    pivot = F.min(F.struct("v", "n"))
    buckets = placed.groupBy("key").agg(pivot.alias("pivot"), F.count("*").alias("many")).where("many > 1")
    members = durable_narrow(placed.join(buckets.select("key", "pivot"), "key"))
    # every member with the smallest one of its bucket, once for all buckets they share
    stars = members.where("v != pivot.v").where(_near_sizes("n", "pivot.n", threshold))
    stars = stars.select(F.col("pivot.v").alias("u"), "v").distinct()
    links = _Links(docs, classes, width, threshold)
    links.confirm(stars)
    links.confirm(_open_pairs(members.select("key", "v", "n"), links, threshold))

    named = links.labelled(classes.select("v", "id", "k1", "k2"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select("k1", "k2", "component_id")
    return (
        signed.drop("bands").join(named, ["k1", "k2"], "left")
        .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
        .select(
            F.col("id").alias(key),
            "n_shingles",
            "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
            "digest",
        )
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, that with the smallest id, with its columns."""
    found = near_duplicates(docs, key, text, threshold=threshold)
    # rows that share an id are told apart by their texts; equal rows are one document.
    # Keys without nulls: texts that meet their verdict by them lie as duplicates need them,
    # so they are moved and sorted once
    def keys(digest):
        return F.coalesce(F.col(key).cast("long").cast("string"), F.lit("")).alias("__id"), digest.alias("__digest")

    kept = found.where("kept").select(*keys(F.col("digest"))).distinct()
    rows = docs.select(*keys(_digest(F.col(text))), F.struct("*").alias("row"))
    return rows.join(kept, ["__id", "__digest"], "left_semi").dropDuplicates(["__id", "__digest"]).select("row.*")
