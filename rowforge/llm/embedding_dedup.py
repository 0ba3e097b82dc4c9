"""Near duplicates of embeddings by random hyperplanes in several tables.

Equal vectors form a class, so copies are never compared. In every table a class falls into
the bucket given by the signs of its products with some random hyperplanes; two vectors at
the threshold share a bucket of one table with probability ``(1 - angle / pi) ** bits``.
The number of bits follows the number of classes, so that buckets stay small, and the
number of tables follows the bits, so that a pair at the threshold is missed with
probability ``MISS`` at most.

Buckets are compared in blocks: one of more than ``BLOCK`` classes is cut into chunks, and
every pair of chunks is a block of its own. A block computes exact cosines as one product
of matrices in double precision and returns sums per class and a spanning forest, never
pairs. A pair that meets in several tables counts in the first one only.

Defined cases: a vector that is null, empty or zero, or holds a null or a component that is
not finite, links with nothing; vectors of different lengths do not link; equal rows, also
with equal ids, are separate vectors with cosine 1; a null id links like any other but names
no component unless all are null; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import shuffle_partitions
from .components import connected_components

THRESHOLD = 0.9
#: Probability of missing a pair exactly at the threshold, at most.
MISS = 0.003
#: Classes per bucket that the number of bits aims at, and per chunk at most.
BUCKET = 64
BLOCK = 1024
MAX_BITS = 30


def tables_for(bits: int, threshold: float, miss: float = MISS) -> int:
    """Tables of so many bits that keep the probability of a miss below the bound."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-agree))


@lru_cache(maxsize=4)
def _hyperplanes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, tables * bits))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, whatever their size."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(tables: int, bits: int, seed: int):
    """Adds the code of every table to ``v, many, dims, vector`` (a double array)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = batch.column(3).to_numpy(zero_copy_only=False)
            raw, codes = [], np.zeros((len(vectors), tables), np.int64)
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                unit = units(np.stack([vectors[i] for i in rows]))
                signs = unit @ _hyperplanes(int(d), tables, bits, seed) > 0
                codes[rows] = signs.reshape(len(rows), tables, bits) @ weights
            for vector in vectors:
                raw.append(np.ascontiguousarray(vector).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(raw, pa.binary()),
                 pa.array(list(codes), pa.list_(pa.int64()))],
                ["v", "many", "dims", "vector", "codes"],
            )

    return code


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        if last is not None and (key[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
        for a, b in zip(starts[:-1], starts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For every one of ``n`` places the smallest place reachable over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_block(
    vectors: np.ndarray, many: np.ndarray, codes: np.ndarray, chunk: np.ndarray, table: int, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Per row the vectors linked to it that no earlier table has counted, and the first
    row of its tree. Rows of one chunk meet each other; of two, rows of different chunks."""
    n = len(vectors)
    unit = units(vectors)
    links, trees = np.zeros(n, np.int64), np.arange(n)
    one = np.flatnonzero(chunk == chunk[0])
    other = np.flatnonzero(chunk != chunk[0]) if (chunk != chunk[0]).any() else one
    close = unit[one] @ unit[other].T >= threshold
    if one is other:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    if not len(i):
        return links, trees
    i, j = one[i], other[j]
    trees = _forest(i, j, n)
    for at in range(0, len(i), 65536):  # bounds the memory of a dense block
        x, y = i[at : at + 65536], j[at : at + 65536]
        fresh = ~(codes[x, :table] == codes[y, :table]).any(axis=1)
        np.add.at(links, x[fresh], many[y[fresh]])
        np.add.at(links, y[fresh], many[x[fresh]])
    return links, trees


def _compare(tables: int, threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 5):
            if rows.num_rows < 2:
                continue
            v, many, chunk = (rows.column(k).to_numpy() for k in ("v", "many", "chunk"))
            if rows.column("first")[0] != rows.column("second")[0] and (chunk == chunk[0]).all():
                continue  # the other chunk is empty
            vectors = np.stack([np.frombuffer(x, np.float64) for x in rows.column("vector").to_pylist()])
            codes = np.array(rows.column("codes").to_pylist(), np.int64).reshape(len(v), tables)
            table = int(rows.column("table")[0].as_py())
            links, trees = compare_block(vectors, many, codes, chunk, table, threshold)
            hit = (links > 0) | (trees != np.arange(len(v)))
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[hit]), pa.array(links[hit]), pa.array(v[trees[hit]])], ["v", "links", "root"]
                )

    return compare


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding",
    threshold: float = THRESHOLD, miss: float = MISS, seed: int = 3,
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row."""
    spark = vectors.sparkSession
    vector = F.col(embedding).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    zero = F.forall(vector, lambda x: x == 0)
    rows = vectors.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(finite & ~zero & (F.size(vector) > 0), F.lit(False)).alias("valid"),
        vector.alias("vector"),
    ).select(
        "id",
        "valid",
        F.when(F.col("valid"), F.col("vector")).alias("vector"),
        # 128 bits stand for a vector; rows that link with nothing have keys of their own
        F.when(F.col("valid"), F.xxhash64("vector")).alias("k1"),
        F.when(F.col("valid"), F.xxhash64(F.lit(1), "vector")).alias("k2"),
    )
    classes = durable(
        rows.where("valid")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("id"), F.count("*").alias("many"), F.first("vector").alias("vector"))
        .withColumn("v", F.monotonically_increasing_id())
    )
    n = classes.count()
    bits = min(MAX_BITS, max(6, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 6))
    tables = tables_for(bits, threshold, miss)
    coded = durable(
        classes.select("v", "many", F.size("vector").alias("dims"), "vector")
        .repartition(shuffle_partitions(spark))
        .mapInArrow(_codes(tables, bits, seed), "v long, many long, dims int, vector binary, codes array<long>")
    )
    sizes = (
        coded.select("dims", F.posexplode("codes").alias("table", "code"))
        .groupBy("dims", "table", "code").agg(F.count("*").alias("n")).where("n > 1")
        .select("dims", "table", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks"))
    )
    dealt = coded.select("*", F.posexplode("codes").alias("table", "code")).join(sizes, ["dims", "table", "code"])
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = ["dims", "table", "code", "first", "second"]
    blocks = (
        dealt.select(
            "dims", "table", "code",
            F.least("chunk", "with").alias("first"), F.greatest("chunk", "with").alias("second"),
            "chunk", "v", "many", "vector", "codes",
        )
        .repartition(shuffle_partitions(spark), *block)
        .sortWithinPartitions(*block)
    )
    found = durable(blocks.mapInArrow(_compare(tables, threshold), "v long, links long, root long"))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("v != root").select(F.col("v").alias("u"), F.col("root").alias("v")))

    named = (
        classes.select("v", "id", "k1", "k2", "many")
        .join(links, "v", "left")
        .join(components.withColumnRenamed("u", "v"), "v", "left")
        .withColumn("component", F.coalesce("component", "v"))
    )
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").select(
        "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links")
    )
    return (
        rows.drop("vector").join(named, ["k1", "k2"], "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
    )
