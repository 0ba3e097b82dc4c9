"""An inverted index: for every word the ids of the documents that have it.

Ids of a word are numbered in their order and cut into lists of bounded length, so the most
frequent word is many rows and no task or row ever holds all its ids. The lists are a store
in the order of words: a search opens the files whose words are asked for, and no text.
New documents add lists in files of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import durable
from .store import ROWS_PER_FILE, Store

#: Ids of one list.
LIST_IDS = 65_536


def _sliced(docs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``id, words`` with the ``slice`` of each row, and the number of slices: ranges of ids
    of about ``rows`` rows, so that a slice of a list is bounded. Only ids are read for them."""
    ids = docs.select("id")
    n = -(-ids.count() // rows)
    if n < 2:
        return docs.withColumn("slice", F.lit(0)), 1
    ranged = ids.repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("first"))
    # one row per slice
    firsts = ranged.agg(F.sort_array(F.collect_list("first")).alias("firsts"))
    slice_of = F.size(F.filter("firsts", lambda first: first <= F.col("id"))) - 1
    return docs.crossJoin(F.broadcast(durable(firsts))).withColumn("slice", slice_of).drop("firsts"), n


def posting_lists(docs: DataFrame, id_col: str, words: Column, list_ids: int = LIST_IDS) -> DataFrame:
    """``word, first_id, n, ids`` of an array of words; ids ascend and occur once.

    A document without an id or without words is in no list. Ids are gathered per word and
    slice of the ids, which splits the most frequent word as any other, and what is shuffled
    after that are lists: those of a word are put together and cut anew where they are long.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_distinct(words).alias("words"))
    rows, slices = _sliced(rows, list_ids)
    # not explode: Spark would split the words once more, to leave out empty arrays before
    pairs = rows.select("id", "slice", F.explode_outer("words").alias("word")).where("word is not null")
    lists = durable(pairs.groupBy("word", "slice").agg(F.sort_array(F.collect_set("id")).alias("ids")))
    if slices > 1:
        lists = durable(_cut(lists, list_ids))
    return lists.select("word", F.get("ids", F.lit(0)).alias("first_id"), F.size("ids").cast("long").alias("n"), "ids")


def _cut(lists: DataFrame, list_ids: int) -> DataFrame:
    """The lists of the slices of a word in a row, in lists of ``list_ids`` ids."""
    sizes = lists.select("word", "slice", F.size("ids").alias("n"))
    # a word with fewer ids has one list; the others are few
    long_words = sizes.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") > list_ids).select("word")
    before = Window.partitionBy("word").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(long_words, "word", "left_semi").select(
        "word", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    placed = lists.join(durable(starts), ["word", "slice"], "left")
    first, last = (F.floor((F.col("start") + x) / list_ids) for x in (F.lit(0), F.size("ids") - 1))
    numbers = F.when(F.col("start").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))
    parts = placed.select("word", "start", "ids", F.explode(numbers).alias("list"))
    at = F.col("list") * list_ids - F.col("start")
    begin = F.greatest(at, F.lit(0)).cast("int")
    part = F.when(F.col("start").isNull(), F.col("ids")).otherwise(
        F.slice("ids", begin + 1, (at + list_ids).cast("int") - begin)
    )
    return parts.select("word", "list", part.alias("ids")).groupBy("word", "list").agg(
        F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids")
    )


class Postings:
    """Posting lists in a store, in the order of words."""

    def __init__(self, store: Store):
        self.store = store

    @classmethod
    def create(
        cls, docs: DataFrame, root: str, id_col: str, words: Column,
        list_ids: int = LIST_IDS, rows_per_file: int = ROWS_PER_FILE,
    ) -> Postings:
        lists = posting_lists(docs, id_col, words, list_ids)
        return cls(Store.create(lists, root, "first_id", [[("word", "asc")]], rows_per_file))

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Postings:
        return cls(Store.open(spark, root))

    def append(self, docs: DataFrame, id_col: str, words: Column, list_ids: int = LIST_IDS) -> Postings:
        """With new documents, whose ids are not in the lists yet."""
        return Postings(self.store.append(posting_lists(docs, id_col, words, list_ids)))

    def lists(self, terms: Sequence[str]) -> DataFrame:
        """The lists of some words, whatever their case."""
        wanted = sorted({term.lower() for term in terms})
        return self.store.query(where=[("word", "in", wanted)])

    def search(self, terms: Sequence[str], every: bool = False) -> DataFrame:
        """``id`` of the documents with any of the words, or with ``every`` one of them."""
        hits = self.lists(terms).select("word", F.explode("ids").alias("id"))
        if not every:
            return hits.select("id").distinct()
        needed = len({term.lower() for term in terms})
        return hits.distinct().groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == needed).select("id")

    def frequency(self, terms: Sequence[str]) -> DataFrame:
        """``word, n``: in how many documents the words are; no list is read for it."""
        return self.lists(terms).groupBy("word").agg(F.sum("n").alias("n"))
