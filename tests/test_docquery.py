from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowforge.operators import docquery as dq


@pytest.fixture(scope="module")
def books(spark):
    rows = [
        ("a", "fiction", 2001, 4.0, ["x", "y"], True),
        ("b", "mystery", 1999, None, ["y"], False),
        ("c", None, 2020, 3.5, [], True),
        ("d", "fiction", None, 4.0, None, None),
        ("e", "poetry", 2001, 5.0, ["z", None], False),
    ]
    return spark.createDataFrame(
        rows, "id string, category string, year int, rating double, words array<string>, free boolean"
    )


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    "clause, expected",
    [
        (("year", "==", 2001), "ae"),
        (("year", "!=", 2001), "bc"),
        (("year", ">=", 2001), "ace"),
        (("year", "==", None), "d"),
        (("year", "!=", None), "abce"),
        (("year", "<", None), ""),
        (("year", "==", "2001"), ""),
        (("year", "!=", "2001"), "abce"),
        (("free", "==", True), "ac"),
        (("free", "==", 1), ""),
        (("category", "in", ["fiction", None]), "ad"),
        (("category", "in", []), ""),
        (("category", "not-in", ["fiction"]), "be"),
        (("category", "not-in", [1]), "abde"),
        (("words", "array-contains", "y"), "ab"),
        (("words", "array-contains", 1), ""),
        (("category", "array-contains", "x"), ""),
        (("words", "array-contains-any", ["z", "y"]), "abe"),
        (("words", "array-contains-any", []), ""),
    ],
)
def test_clauses(books, clause, expected):
    assert sorted(ids(dq.doc_query(books, where=[clause]))) == list(expected)


def test_unknown_names(books):
    with pytest.raises(ValueError, match="unknown operator"):
        dq.doc_query(books, where=[("year", "~", 1)])
    with pytest.raises(ValueError, match="unknown composite"):
        dq.doc_query(books, composite=("XOR", [("year", "==", 1)]))
    with pytest.raises(ValueError, match="unknown unary"):
        dq.doc_query(books, unary=("year", "IS_NAN"))
    with pytest.raises(ValueError, match="unknown direction"):
        dq.doc_query(books, order=[("year", "up")])
    with pytest.raises(ValueError, match="field,op,value"):
        dq.where_cli_string(books, "year")


def test_composites_and_precedence(books):
    either = ("OR", [("year", "==", 1999), ("category", "==", "poetry")])
    both = ("AND", [("year", "==", 2001), ("category", "==", "poetry")])
    assert sorted(ids(dq.doc_query(books, composite=either))) == ["b", "e"]
    assert ids(dq.doc_query(books, composite=both)) == ["e"]
    every = dict(where=[("id", "==", "a")], composite=both)
    assert ids(dq.doc_query(books, **every)) == ["e"]
    assert ids(dq.doc_query(books, unary=("rating", "IS_NULL"), **every)) == ["b"]


def test_order_drops_rows_without_the_field(books):
    assert ids(dq.doc_query(books, order=[("rating", "desc")])) == ["e", "a", "d", "c"]
    assert ids(dq.doc_query(books, order=[("year", "asc"), ("rating", "DESC")])) == ["e", "a", "c"]


def test_limit_and_offset_of_zero_mean_all(books):
    assert len(ids(dq.doc_query(books, limit=0, offset=0))) == 5
    assert ids(dq.doc_query(books, limit=2, offset=1)) == ["b", "c"]


@pytest.mark.parametrize("bound", [10_000, 0])
@pytest.mark.parametrize("offset, limit", [(0, 3), (2, 0), (2, 2), (4, 9), (5, 0), (9, 1), (0, 5)])
def test_long_pages_equal_short_ones(books, monkeypatch, bound, offset, limit):
    monkeypatch.setattr(dq, "MAX_TOP_ROWS", bound)
    everything = ids(dq.doc_query(books, order=[("id", "desc")]))
    expected = everything[offset : offset + limit if limit else None]
    assert ids(dq.doc_query(books, order=[("id", "desc")], offset=offset, limit=limit)) == expected


@pytest.mark.parametrize(
    "cursor, expected",
    [
        (dict(start_at=[2001]), ["a", "e", "c"]),
        (dict(start_after=[2001]), ["c"]),
        (dict(end_at=[2001]), ["b", "a", "e"]),
        (dict(end_before=[2001]), ["b"]),
        (dict(start_after=[2001, "a"]), ["e", "c"]),
        (dict(start_at=[1999], end_before=[2020]), ["b", "a", "e"]),
    ],
)
def test_cursors(books, cursor, expected):
    assert ids(dq.doc_query(books, order=[("year", "asc")], **cursor)) == expected


def test_cursor_of_a_descending_order(books):
    order = [("year", "desc"), ("id", "asc")]
    assert ids(dq.doc_query(books, order=order, start_at=[2001, "b"])) == ["e", "b"]


def test_select_and_nested_fields(books, spark):
    nested = books.select("id", F.struct("year", "rating").alias("info"))
    found = dq.doc_query(nested, where=[("info.year", "==", 1999)], select=["info.year"])
    assert found.columns == ["id", "info.year"] and found.first()[1] == 1999


def test_command_line_filters_stay_text(books):
    assert ids(books.where(dq.where_cli_string(books, "year,==,2001"))) == []
    assert ids(books.where(dq.where_cli_string(books, "year,==,2001", coerce=True))) == ["a", "e"]
    assert ids(books.where(dq.where_cli_string(books, " category , == , poetry "))) == ["e"]


def test_preview(books):
    rows = dq.preview(books, ["id"], 2).collect()
    assert [(r["id"], r["more"]) for r in rows] == [("a", 3), ("b", 3)]
    assert dq.preview(books, ["id"], None).count() == 5
    assert dq.preview(books, ["id"], 9).first()["more"] == 0


def test_filters_and_columns_reach_the_scan(tables):
    query = dq.doc_query(
        tables["part"],
        where=[("p_size", ">=", 10), ("p_brand", "==", "Brand#2")],
        select=["p_size"],
        id_col="p_partkey",
    )
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "EqualTo(p_brand,Brand#2)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_size:int>" in plan


def test_list_operators_refuse_a_text(books):
    for operator in ("in", "not-in", "array-contains-any"):
        with pytest.raises(ValueError):
            dq.clause(books, "id", operator, "15")
        with pytest.raises(ValueError):
            dq.where_cli_string(books, f"id,{operator},15")


def test_pages_over_equal_keys_and_ids(spark, monkeypatch):
    """A long page holds the rows of a short one, also where keys and ids are equal."""
    rows = [(i % 3 if i % 4 else None, f"d{i % 5}", i // 10) for i in range(60)] + [(1, "d1", 7)] * 9
    df = spark.createDataFrame(rows, "k int, id string, v int").repartition(5)
    for keys in ([("k", False), ("id", False)], [("k", True), ("id", True)]):
        for offset, limit in [(0, 7), (1, 5), (13, 1), (30, 30), (40, 8), (60, 20), (5, 64), (69, 3), (200, 5)]:
            monkeypatch.setattr(dq, "MAX_TOP_ROWS", 10_000)
            short = dq.page(df, keys, offset, limit)
            monkeypatch.setattr(dq, "MAX_TOP_ROWS", 0)
            long = dq.page(df, keys, offset, limit)
            assert long.columns == df.columns
            assert list(map(tuple, short.collect())) == list(map(tuple, long.collect())), (keys, offset, limit)
        monkeypatch.setattr(dq, "MAX_TOP_ROWS", 0)
        for offset in (1, 20, 41):
            assert dq.page(df, keys, offset).count() == 69 - offset


def test_lookups_and_cursors_reach_the_scan(spark):
    from rowforge.plans import QUERIES

    def plan(name):
        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()

    shown = "spark.sql.maxMetadataStringLength"
    spark.conf.set(shown, "10000")
    try:
        assert "EqualTo(p_partkey,42)" in plan("point_lookup")
        pushed = plan("cursor_page")
    finally:
        spark.conf.unset(shown)
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThanOrEqual(l_shipdate" in pushed
