"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, sent round up to ``max_repeats``
times. A document's virtual finish time is the number of words its queue has handed out,
this document included, divided by the queue's target. All queues are merged in the order
of finish times, over range partitions, and the merged sequence is cut where the budget is
used up. Documents are taken whole.

The running sum of a source never needs the source in one task: its documents fall into
buckets by their shuffle key, the buckets' sums are added up first, and only one bucket is
ordered at a time. The shuffle key is a digest of the document's id, so runs agree.

Defined cases: a null text has size 0; a null source is a queue of its own, last in order;
documents of size 0 and sources without words are taken 0 times; equal rows are separate
documents; a null id has a place of its own in the shuffle; other columns are carried; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.ranking import global_index
from ..session import durable
from .common import count_words, shuffle_partitions

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The budget as a share of all words.
BUDGET = 1.5
#: Most times a document may be taken.
MAX_REPEATS = 2
#: Documents of a source that one task orders, about.
BUCKET_ROWS = 20_000


def fair_targets(sizes: DataFrame, budget: float, weights: Sequence[int], repeats: int) -> DataFrame:
    """``source, source_size, rank, target`` from ``no_source, source, source_size``.

    Shares go by weight; a source whose share exceeds ``repeats`` times its size gets just
    that, and the rest is shared again by weight until no share is too large.
    """
    ranked = durable(
        global_index(sizes, [F.col("no_source"), F.col("source")], "rank").withColumn(
            "weight",
            F.element_at(
                F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
            ),
        )
    )
    cap = repeats * F.col("source_size")
    level = 0.0
    while True:
        # a level only rises, so a source that is full stays full
        full = cap < F.lit(level) * F.col("weight") if level else F.lit(False)
        used, open_weight, n_full = ranked.agg(
            F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)
        ).first()
        if not open_weight:
            break
        rest = (budget - (used or 0)) / open_weight
        if rest == level or n_full == 0 and level:
            break
        level = rest
    share = F.lit(float(level)) * F.col("weight")
    return ranked.withColumn("target", F.least(share, cap.cast("double")))


def _queues(docs: DataFrame, key: str, source: str, text: str, carry: bool) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"))
    row = F.col("row")
    key_text = row[key].cast("string")
    return rows.select(
        *([row] if carry else []),
        row[key].alias("key"),
        row[source].isNull().alias("no_source"),
        F.coalesce(row[source].cast("string"), F.lit("")).alias("source"),
        count_words(row[text]).alias("size"),
        F.md5(F.coalesce(key_text, F.lit(""))).alias("turn"),
    )


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS,
    carry: bool = False,
) -> DataFrame:
    """``key, size, source_size, target, copies, taken`` per document, and the document
    itself as ``row`` with ``carry``. ``copies`` says how often the mix holds it."""
    spark = docs.sparkSession
    queues = _queues(docs, key, source, text, carry)
    digits = max(2, math.ceil(math.log(max(docs.count() / BUCKET_ROWS, 1), 16)))
    queues = queues.withColumn("bucket", F.substring("turn", 1, digits))
    queue = ["no_source", "source"]

    # sums of buckets, sources and everything, each from the one before
    buckets = durable(queues.groupBy(*queue, "bucket").agg(F.sum("size").alias("bucket_size")))
    sizes = buckets.groupBy(*queue).agg(F.sum("bucket_size").alias("source_size"))
    total = buckets.agg(F.sum("bucket_size")).first()[0] or 0
    targets = fair_targets(sizes, budget * total, weights, max_repeats)
    earlier = Window.partitionBy(*queue).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    starts = starts.join(targets.select(*queue, "source_size", "rank", "target"), queue).drop("bucket_size")

    inside = Window.partitionBy(*queue, "bucket").orderBy("turn", "key", "size")
    handed = durable(
        queues.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, [*queue, "bucket"])
        .withColumn("handed", F.col("start") + F.col("inside"))
        .drop("start", "inside", "turn", "bucket", *queue)
    )
    cut = _cut(handed, budget * total, max_repeats, shuffle_partitions(spark))
    # the same comparison as in the merged order, so no row has to be moved back
    last = F.struct(F.lit(cut[0]).alias("finish"), F.lit(cut[1]).cast("long").alias("rank"))
    copies = sum(
        (
            F.when((F.col("size") > 0) & (F.struct(_finish(turn).alias("finish"), "rank") <= last), 1).otherwise(0)
            for turn in range(max_repeats)
        ),
        F.lit(0),
    )
    return handed.withColumn("copies", copies).select(
        *(["row"] if carry else []),
        F.col("key").alias(key),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def _finish(repeat):
    return (F.col("source_size") * repeat + F.col("handed")) / F.col("target")


def _cut(handed: DataFrame, budget: float, max_repeats: int, least: int) -> tuple[float, int]:
    """Finish time and queue of the last document that the budget covers."""
    turns = handed.where("size > 0").select(
        "size", "rank", F.explode(F.array(*[_finish(r) for r in range(max_repeats)])).alias("finish")
    )
    merged = durable(
        turns.repartitionByRange(least, "finish", "rank").withColumn("part", F.spark_partition_id())
    )
    # one row per range partition
    parts = merged.groupBy("part").agg(F.sum("size").alias("part_size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("part").orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0)
    covered = (
        merged.withColumn("inside", F.sum("size").over(order))
        .join(F.broadcast(parts), "part")
        .where(F.col("start") + F.col("inside") <= budget)
    )
    last = covered.agg(F.max(F.struct("finish", "rank")).alias("last")).first()["last"]
    return (last["finish"], last["rank"]) if last else (-1.0, 0)


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents of the mix, each as many times as it is taken."""
    taken = mix(docs, key, source, text, carry=True)
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
