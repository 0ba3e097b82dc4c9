"""Stores: the files a query opens, changes by file, versions, imports."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowforge.operators.docquery import doc_query
from rowforge.sources.documents import ImportFailed
from rowforge.sources.files import create_text
from rowforge.sources.store import Conflict, Store, declared_indexes, import_report

ORDER = [("available", "asc"), ("rating", "desc")]


@pytest.fixture(scope="module")
def books(spark):
    """2,000 documents, some without a rating, many with the same one."""
    i = F.col("id")
    return spark.range(2000).select(
        F.col("id"),
        (i % 3 == 0).alias("available"),
        F.when(i % 11 != 0, (i * 7919 % 50).cast("double")).alias("rating"),
        F.concat(F.lit("t"), i.cast("string")).alias("title"),
    )


@pytest.fixture(scope="module")
def store(spark, books, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    return Store.create(books, root, indexes=[(), ORDER, [("rating", "asc")]], rows_per_file=100)


def rows(df):
    return [tuple(r) for r in df.collect()]


def opened(store, **options):
    copy, files = store.touched(**options)
    return copy, files.count(), store.files(copy).count()


def test_declared_indexes():
    text = """{"indexes": [{"collectionGroup": "books", "queryScope": "COLLECTION", "fields": [
      {"fieldPath": "available", "order": "ASCENDING"}, {"fieldPath": "rating", "order": "DESCENDING"}]}],
      "fieldOverrides": []}"""
    assert declared_indexes(text) == {"books": [ORDER]}


def test_all_rows_are_in_every_copy(store, books):
    assert sorted(rows(store.rows()), key=str) == sorted(rows(books), key=str)
    for copy in range(3):
        assert store.files(copy).agg(F.sum("rows")).first()[0] == 2000
        assert store.files(copy).count() > 10


QUERIES = [
    (dict(order=ORDER, limit=30), 1),
    (dict(order=ORDER, limit=30, offset=250), 1),
    (dict(where=[("available", "==", True)], order=[("rating", "desc")], limit=20), 1),
    (dict(where=[("available", "==", True)], order=[("rating", "desc")], start_after=[30.0], limit=20), 1),
    (dict(order=[("rating", "asc")], limit=25), 2),
    (dict(order=[("rating", "desc")], limit=25), 2),
    (dict(order=[("rating", "asc")], start_at=[20.0], end_before=[23.0]), 2),
    (dict(order=[("rating", "desc")], start_after=[20.0, 500], limit=10), 2),
    (dict(where=[("rating", ">=", 45.0)], order=[("rating", "asc")]), 2),
    (dict(where=[("rating", "<", 3.0)], order=[("rating", "desc")], limit=5), 2),
    (dict(where=[("rating", "in", [3.0, 44.0])], order=[("rating", "asc")]), 2),
    (dict(where=[("id", "==", 1234)]), 0),
    (dict(where=[("id", "in", [5, 1999])]), 0),
    (dict(limit=7), 0),
    (dict(limit=7, offset=150), 0),
]


@pytest.mark.parametrize("options, copy", QUERIES, ids=[str(i) for i in range(len(QUERIES))])
def test_queries_open_few_files_and_give_the_same_rows(store, books, options, copy):
    by = None if options.get("order") or options.get("limit") else str
    found, wanted = rows(store.query(**options)), rows(doc_query(books, **options))
    assert found == wanted if by is None else sorted(found, key=by) == sorted(wanted, key=by)
    used, few, all_files = opened(store, **options)
    assert used == copy and few <= all_files // 3


@pytest.mark.parametrize(
    "options",
    [
        dict(where=[("title", "==", "t77")], order=[("rating", "asc")], limit=3),
        dict(where=[("available", "==", True), ("title", ">", "t5")], order=[("rating", "desc")], limit=40),
        dict(where=[("rating", "==", "x")], order=[("rating", "asc")], limit=3),
        dict(where=[("rating", "==", None)]),
        dict(order=[("title", "asc")], limit=3),
        dict(composite=("OR", [("rating", "==", 3.0), ("title", "==", "t9")]), order=[("rating", "asc")], limit=50),
        dict(unary=("rating", "IS_NULL"), limit=9),
        dict(order=[("rating", "asc"), ("title", "desc")], start_at=[10.0, "t5"], limit=30),
        dict(order=[("rating", "asc")], offset=1900, limit=10),
        dict(order=[("available", "desc"), ("rating", "asc")], limit=12),
        dict(where=[("available", "==", False)], order=[("rating", "asc")], end_at=[4.0]),
        dict(where=[("id", "==", 99999)]),
        dict(),
    ],
    ids=str,
)
def test_queries_that_fit_less_well_are_still_right(store, books, options):
    found, wanted = rows(store.query(**options)), rows(doc_query(books, **options))
    if not options.get("order"):
        found, wanted = sorted(found, key=str), sorted(wanted, key=str)
    assert found == wanted


def test_lookup_reads_one_file(store):
    found = store.lookup(1500)
    assert rows(found.select("id", "title")) == [(1500, "t1500")] and len(found.inputFiles()) == 1
    assert rows(store.lookup(-1)) == []


def names(store, copy=0):
    return {r["file"] for r in store.files(copy).select("file").collect()}


@pytest.fixture
def small(spark, books, tmp_path):
    return Store.create(books.where("id < 600"), str(tmp_path / "s"), indexes=[(), ORDER], rows_per_file=50)


def test_merge_rewrites_the_files_of_its_ids_only(spark, small, books):
    updates = spark.createDataFrame([(7, 99.0), (8, 98.0)], "id long, rating double")
    after = small.merge(updates)
    assert len(names(small) - names(after)) == 1 and len(names(small)) > 8
    assert len(names(small, 1) - names(after, 1)) <= 2
    want = books.where("id < 600").join(updates.withColumnRenamed("rating", "r"), "id", "left")
    want = want.withColumn("rating", F.coalesce("r", "rating")).drop("r")
    assert sorted(rows(after.rows()), key=str) == sorted(rows(want), key=str)
    assert [r["id"] for r in after.query(order=[("rating", "desc")], limit=2).collect()] == [7, 8]
    # each copy has every row once, with the new values
    top = after.query(where=[("available", "==", False)], order=[("rating", "desc")], limit=3)
    assert rows(top) == rows(doc_query(want, where=[("available", "==", False)], order=[("rating", "desc")], limit=3))
    assert [after.files(c).agg(F.sum("rows")).first()[0] for c in (0, 1)] == [600, 600]
    # the version before is still there
    assert rows(Store.open(spark, small.root, 0).lookup(7)) == rows(books.where("id = 7"))
    assert rows(Store.open(spark, small.root).lookup(7).select("rating")) == [(99.0,)]


def test_supplied_nulls_upserts_and_new_fields(spark, small):
    updates = spark.createDataFrame(
        [(3, None, "n", ["rating", "note"]), (9000, 1.5, "new", ["rating", "note"])],
        "id long, rating double, note string, given array<string>",
    )
    after = small.merge(updates, supplied="given", upsert=True)
    assert rows(after.lookup(3).select("rating", "title", "note")) == [(None, "t3", "n")]
    assert rows(after.lookup(9000).select("rating", "title", "note")) == [(1.5, None, "new")]
    assert rows(after.lookup(4).select("title", "note")) == [("t4", None)]
    assert after.rows().count() == 601
    only_known = small.merge(updates.where("id = 9000").drop("given"))
    assert only_known is not None and Store.open(spark, small.root).rows().count() == 601


def test_delete_keeps_the_other_files(spark, small):
    gone = spark.createDataFrame([(i,) for i in [*range(100, 130), 100, 77777]], "id long")
    after = small.delete(gone)
    assert after.rows().count() == 570 and after.rows().where("id between 100 and 129").isEmpty()
    assert len(names(small) & names(after)) >= len(names(small)) - 2
    assert small.delete(gone.where("id = 77777")).state.version == 0
    everything = after.delete(after.rows().select("id"))
    assert everything.rows().collect() == [] and everything.query(order=ORDER, limit=3).collect() == []
    assert rows(everything.append(spark.createDataFrame([(1, "x")], "id long, title string")).lookup(1).select("title")) == [("x",)]


def test_append_adds_files(spark, small, books):
    after = small.append(books.where("id >= 1990"))
    assert names(small) < names(after)
    assert rows(after.query(order=ORDER, limit=700)) == rows(doc_query(books.where("id < 600 or id >= 1990"), order=ORDER, limit=700))


def test_a_failed_job_leaves_the_last_version(spark, small):
    broken = spark.createDataFrame([(5,), (6,)], "id long").withColumn(
        "rating", F.when(F.col("id") == 6, F.raise_error(F.lit("lost"))).cast("double")
    )
    with pytest.raises(Exception, match="lost"):
        small.merge(broken)
    again = Store.open(spark, small.root)
    assert again.state.version == 0 and again.rows().count() == 600


def test_one_of_two_writers_is_refused(spark, small):
    first = small.delete(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(Conflict):
        small.delete(spark.createDataFrame([(2,)], "id long"))
    assert Store.open(spark, small.root).state == first.state
    # a version whose writer was lost half way is none, and its number is not used again
    create_text(spark, f"{small.root}/versions/{2:012d}", '{"version": 2, "fol')
    assert Store.open(spark, small.root).state.version == 1


def test_clean_removes_what_no_version_needs(spark, small):
    after = small.merge(spark.createDataFrame([(1, 2.0)], "id long, rating double"))
    before = rows(after.rows().orderBy("id"))
    gone = after.clean()
    assert any("/data/" in g for g in gone) and any("/versions/" in g for g in gone)
    assert rows(Store.open(spark, small.root).rows().orderBy("id")) == before


def _incoming(spark, bad):
    return spark.range(1, 24).select(
        F.col("id").alias("n"), F.when(F.col("id").isin(bad), F.lit(None)).otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("title")
    )


def _import(store, frame, import_id="i1"):
    error = F.when(F.col("title").isNull(), F.concat(F.lit("no title: "), F.col("n").cast("string")))
    return store.import_batches(frame, [F.col("n")], import_id, error, size=5)


@pytest.fixture
def empty(spark, tmp_path):
    frame = spark.createDataFrame([], "id string, n long, title string, importedAt timestamp")
    return Store.create(frame, str(tmp_path / "imports"))


def test_a_failing_batch_leaves_the_others_in(spark, empty):
    after = _import(empty, _incoming(spark, [7, 8, 23]))
    assert sorted(r["n"] for r in after.rows().collect()) == [*range(1, 6), *range(11, 21)]
    assert after.rows().where("importedAt is null or id is null").isEmpty()
    report = {r["batch"]: tuple(r)[1:] for r in import_report(after.ledger(), "i1").collect()}
    assert report == {
        1: (5, 0, None, 1), 2: (0, 5, "no title: 7", 1), 3: (5, 0, None, 1), 4: (5, 0, None, 1), 5: (0, 3, "no title: 23", 1)
    }


def test_an_import_run_again_adds_only_what_is_not_in(spark, empty):
    once = _import(empty, _incoming(spark, [7, 8, 23]))
    same = _import(once, _incoming(spark, [7, 8, 23]))
    assert same.rows().count() == 15
    mended = _import(Store.open(spark, empty.root), _incoming(spark, [23]))
    assert sorted(r["n"] for r in mended.rows().collect()) == [*range(1, 21)]
    assert mended.rows().select("id").distinct().count() == 20
    report = {r["batch"]: tuple(r)[1:] for r in import_report(mended.ledger(), "i1").collect()}
    assert report[2] == (5, 0, None, 3) and report[5] == (0, 3, "no title: 23", 3) and report[1] == (5, 0, None, 1)
    other = _import(mended, _incoming(spark, []), "i2")
    assert other.rows().count() == 43


def test_an_import_of_nothing_is_an_error(spark, empty):
    with pytest.raises(ImportFailed):
        _import(empty, _incoming(spark, [1, 6, 11, 16, 21]))
    assert Store.open(spark, empty.root).state.version == 0
