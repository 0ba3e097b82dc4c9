"""Collections in stores: look-ups, pages, changes by file, imports, inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import words
from ..session import scratch_path
from ..sources.postings import Postings
from ..sources.store import Store, declared_indexes, import_report
from ..sources.tables import Tables
from . import sources  # noqa: F401  (its SQL is used again)
from .registry import ORACLES, WORDS, query

#: An index as it is declared: available documents first, the best rated in front.
DECLARED = """{"indexes": [{"collectionGroup": "parts", "queryScope": "COLLECTION", "fields": [
  {"fieldPath": "available", "order": "ASCENDING"}, {"fieldPath": "rating", "order": "DESCENDING"}]}]}"""


def _rated_store(t: Tables) -> Store:
    rated = t["part"].select(
        "p_partkey", (F.col("p_size") > 10).alias("available"), F.col("p_retailprice").alias("rating")
    )
    indexes = [(), *declared_indexes(DECLARED)["parts"]]
    return Store.create(rated, scratch_path(t.spark, "rated"), "p_partkey", indexes)


@query(
    "indexed_top",
    """select p_size > 10 as available, p_retailprice as rating, p_partkey from part
       order by available, rating desc, p_partkey limit 30""",
)
def indexed_top_plan(t: Tables) -> DataFrame:
    """The first rows of a declared index."""
    found = _rated_store(t).query(order=[("available", "asc"), ("rating", "desc")], limit=30)
    return found.select("available", "rating", "p_partkey")


@query(
    "indexed_equal_then_order",
    """select p_partkey, p_retailprice as rating from part
       where p_size > 10 and p_retailprice <= 1500
       order by rating desc, p_partkey limit 40 offset 15""",
)
def indexed_equal_then_order_plan(t: Tables) -> DataFrame:
    """An equal leading value, then the order of the next key from a cursor on."""
    return _rated_store(t).query(
        where=[("available", "==", True)],
        order=[("rating", "desc")],
        start_at=[1500.0],
        offset=15,
        limit=40,
        select=["rating"],
    )


@query(
    "indexed_cursor",
    """select o_orderkey, o_totalprice from orders
       where o_totalprice > 100000 and o_totalprice < 110000
       order by o_totalprice, o_orderkey""",
)
def indexed_cursor_plan(t: Tables) -> DataFrame:
    orders = t["orders"].select("o_orderkey", "o_totalprice")
    store = Store.create(orders, scratch_path(t.spark, "priced"), "o_orderkey", [[("o_totalprice", "asc")]])
    return store.query(order=[("o_totalprice", "asc")], start_after=[100000.0], end_before=[110000.0])


@query("indexed_lookup", "select * from customer where c_custkey = 77")
def indexed_lookup_plan(t: Tables) -> DataFrame:
    return Store.create(t["customer"], scratch_path(t.spark, "customers"), "c_custkey").lookup(77)


@query("merge_by_file", ORACLES["doc_merge"])
def merge_by_file_plan(t: Tables) -> DataFrame:
    """Updates of a store: files without a changed document stay."""
    price, size = F.lit("p_retailprice"), F.lit("p_size")
    returned = t["lineitem"].where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey"))
    updates = returned.agg(F.max("l_extendedprice").alias("p_retailprice"), F.count("*").alias("n")).select(
        "p_partkey",
        "p_retailprice",
        F.lit(None).cast("int").alias("p_size"),
        F.when(F.col("n") > 8, F.array(price, size)).otherwise(F.array(price)).alias("given"),
    )
    store = Store.create(t["part"], scratch_path(t.spark, "parts"), "p_partkey")
    return store.merge(updates, supplied="given").rows()


@query("delete_by_file", ORACLES["doc_delete"])
def delete_by_file_plan(t: Tables) -> DataFrame:
    keys = t["lineitem"].where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return Store.create(t["part"], scratch_path(t.spark, "parts"), "p_partkey").delete(keys).rows()


_BATCHED = """
with batched as (
  select o_orderkey, o_totalprice, o_totalprice >= 499500 as bad,
    cast(floor((row_number() over (order by o_orderkey) - 1) / 500) as bigint) + 1 as batch
  from orders),
verdicts as (
  select batch, count(*) as n, min(o_orderkey) filter (bad) as first_bad from batched group by batch)"""


def _imported(t: Tables) -> Store:
    """Orders imported batch by batch, and once more after that."""
    orders = t["orders"].select("o_orderkey", "o_totalprice")
    error = F.when(
        F.col("o_totalprice") >= 499500, F.concat(F.lit("too high: "), F.col("o_orderkey").cast("string"))
    )
    empty = orders.limit(0).select(
        F.lit("").alias("id"), "o_orderkey", "o_totalprice", F.current_timestamp().alias("importedAt")
    )
    store = Store.create(empty, scratch_path(t.spark, "imported"))
    for _ in range(2):
        store = store.import_batches(orders, [F.col("o_orderkey")], "orders", error)
    return store


@query(
    "import_in_batches",
    _BATCHED
    + """select batch, case when first_bad is null then n else 0 end as imported,
       case when first_bad is null then 0 else n end as failed,
       'too high: ' || first_bad as error,
       cast(case when first_bad is null then 1 else 2 end as bigint) as attempts from verdicts""",
)
def import_in_batches_plan(t: Tables) -> DataFrame:
    """What became of every batch; the second run tries those that failed, and adds none."""
    return import_report(_imported(t).ledger(), "orders")


@query(
    "imported_rows",
    _BATCHED
    + """select o_orderkey, o_totalprice, true as has_id, true as has_import_time
       from batched join verdicts using (batch) where first_bad is null""",
)
def imported_rows_plan(t: Tables) -> DataFrame:
    return _imported(t).rows().select(
        "o_orderkey",
        "o_totalprice",
        F.col("id").rlike("^[0-9a-f]{32}$").alias("has_id"),
        F.col("importedAt").isNotNull().alias("has_import_time"),
    )


def _postings(t: Tables) -> Postings:
    """The index of one half of the documents, with the other half added later."""
    docs = t.spread["documents"].select("doc_id", words(F.col("text")).alias("words"))
    path = scratch_path(t.spark, "postings")
    first = Postings.create(docs.where("doc_id % 2 = 0"), path, "doc_id", F.col("words"))
    return first.append(docs.where("doc_id % 2 = 1"), "doc_id", F.col("words"))


@query("posting_search", f"select doc_id from documents where list_has_any({WORDS}, ['that', 'ein'])")
def posting_search_plan(t: Tables) -> DataFrame:
    return _postings(t).search(["that", "EIN"]).select(F.col("id").alias("doc_id"))


@query("posting_search_every", f"select doc_id from documents where list_has_all({WORDS}, ['the', 'of', 'that'])")
def posting_search_every_plan(t: Tables) -> DataFrame:
    return _postings(t).search(["The", "of", "that"], every=True).select(F.col("id").alias("doc_id"))


@query(
    "posting_frequency",
    f"""select word, count(*) as n from (
         select doc_id, unnest(list_distinct({WORDS})) as word from documents)
       where word in ('the', 'que', 'der') group by word""",
)
def posting_frequency_plan(t: Tables) -> DataFrame:
    return _postings(t).frequency(["the", "que", "der"]).select("word", F.col("n").cast("long").alias("n"))
