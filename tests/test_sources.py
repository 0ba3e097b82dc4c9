from __future__ import annotations

import json

import pytest
from pyspark.sql import Row, functions as F

from rowforge.functions.redaction import redact_keys
from rowforge.operators.features import UNUSED_COLUMNS, drop_columns
from rowforge.sources import documents as docs
from rowforge.sources.files import (
    PASSENGER_CSV,
    artifact_inventory,
    missing_artifacts,
    scan_csv,
    scan_json_array,
    scan_log,
)


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(
        tmp_path / "p.csv",
        'pclass,survived,name,sex,age,fare,home.dest\n1,1,"A, b",male,,7.25,x\n3,0,C,female,2,,\n',
    )
    df = scan_csv(spark, path, PASSENGER_CSV)
    assert df.dtypes[4] == ("age", "double") and "`home.dest`" not in df.columns
    kept = drop_columns(df, UNUSED_COLUMNS)
    assert kept.columns == ["pclass", "survived", "sex", "age", "fare"]
    assert [tuple(r) for r in kept.collect()] == [(1, 1, "male", None, 7.25), (3, 0, "female", 2.0, None)]
    assert dict(scan_csv(spark, path).dtypes)["fare"] == "double"
    with pytest.raises(FileNotFoundError):
        scan_csv(spark, str(tmp_path / "none.csv"))


USERS = [
    {"name": "Ann", "age": 30, "active": True, "skills": ["a", "b"], "joinedAt": "2024-01-15T10:30:00Z"},
    {"name": "Bob", "age": 28, "active": False, "skills": [], "joinedAt": "2024-02-20T14:15:00Z"},
]


@pytest.mark.parametrize("indent, multi_line", [(2, True), (None, True), (None, False)])
def test_json_array(spark, tmp_path, indent, multi_line):
    path = write(tmp_path / "u.json", "\n " + json.dumps(USERS, indent=indent) if multi_line else json.dumps(USERS))
    df = scan_json_array(spark, path, multi_line=multi_line)
    assert sorted(r["name"] for r in df.collect()) == ["Ann", "Bob"]
    assert dict(df.dtypes)["skills"] == "array<string>"


@pytest.mark.parametrize(
    "text, message",
    [
        ('{"a": 1}', "not a JSON array"),
        ("[]", "empty array"),
        ('[{"a": 1}, 5]', "not valid objects"),
        ('[{"a": 1}, [2]]', "not valid objects"),
        ('[{"a": 1}, null]', "not valid objects"),
        ('[{"a": 1}', "not valid objects"),
    ],
)
def test_bad_json_arrays(spark, tmp_path, text, message):
    path = write(tmp_path / "bad.json", text)
    from pyspark.sql.types import _parse_datatype_string as parse

    with pytest.raises(ValueError, match=message):
        scan_json_array(spark, path, parse("a int"))


def test_missing_json(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_json_array(spark, str(tmp_path / "none.json"))


LARGE = [
    {"id": i, "name": f'a, "b" [{{\\ ,]}} {i}', "tags": ["x,y", "]", "{"], "in": {"k": [i, {"z": "\\"}]}}
    for i in range(400)
]


@pytest.mark.parametrize("indent", [None, 1, 4])
def test_large_json_arrays_are_read_by_many_tasks(spark, tmp_path, indent):
    from rowforge.sources.files import json_array_records, scan_large_json_array

    write(tmp_path / "a.json", " \n" + json.dumps(LARGE, indent=indent, ensure_ascii=False) + "\n ")
    write(tmp_path / "b.json", json.dumps(LARGE[:1], indent=indent))
    schema = "id long, name string, tags array<string>, in struct<k:array<string>>"
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        splits = spark.read.option("lineSep", ",").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
        from pyspark.sql.types import _parse_datatype_string as parse

        rows = scan_large_json_array(spark, str(tmp_path), parse(schema)).collect()
        items = json_array_records(spark, str(tmp_path / "a.json")).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert splits > 8 and items == 400
    want = sorted([*LARGE, LARGE[0]], key=lambda r: r["id"])
    got = sorted(rows, key=lambda r: r["id"])
    assert [(r["id"], r["name"], r["tags"]) for r in got] == [(w["id"], w["name"], w["tags"]) for w in want]
    assert [json.loads(r["in"]["k"][1]) for r in got] == [w["in"]["k"][1] for w in want]


@pytest.mark.parametrize(
    "text, message",
    [
        ('{"a": 1}', "not a JSON array"),
        ("[]", "empty array"),
        (" [ ] ", "empty array"),
        ('[{"a": 1}, 5]', "not valid objects"),
        ('[{"a": 1}, [2]]', "not valid objects"),
        ('[{"a": 1}, null]', "not valid objects"),
        ('[{"a": 1}', "not a JSON array"),
        ('[{"a": 1},]', "not valid objects"),
    ],
)
def test_bad_large_json_arrays(spark, tmp_path, text, message):
    from pyspark.sql.types import _parse_datatype_string as parse
    from rowforge.sources.files import scan_large_json_array

    with pytest.raises(ValueError, match=message):
        scan_large_json_array(spark, write(tmp_path / "bad.json", text), parse("a int"))


def test_log_lines(spark, tmp_path):
    path = write(tmp_path / "log.jsonl", '{"event":"x","duration_ms":1.5,"new":1}\n{"event":"y"}\n')
    assert [(r["event"], r["duration_ms"]) for r in scan_log(spark, path).collect()] == [("x", 1.5), ("y", None)]


def test_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "users")
    df = spark.createDataFrame([Row(name="a"), Row(name="b")])
    docs.bulk_append(df, path)
    docs.bulk_append(df, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 4 and stored.select("id").distinct().count() == 4
    assert stored.where("importedAt is null").count() == 0
    docs.bulk_replace(df, path)
    assert spark.read.parquet(path).count() == 2


def test_import_summary(spark):
    df = spark.range(1001).withColumn("ok", F.col("id") != 700)
    summary = docs.import_summary(docs.batch_number(df, [F.col("id")]), F.col("ok"))
    assert sorted(tuple(r) for r in summary.collect()) == [(1, 500, 0), (2, 0, 500), (3, 1, 0)]
    assert docs.require_imported(summary) == 501
    with pytest.raises(docs.ImportFailed):
        docs.require_imported(summary.where("imported = 0"))


def test_lookup(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    assert docs.get_document(df, "b")["n"] == 2
    assert docs.get_document(df, "z", strict=False) is None
    with pytest.raises(docs.DocumentNotFound):
        docs.get_document(df, "z")


@pytest.fixture()
def stored(spark):
    return spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_merge_keeps_what_is_not_supplied(spark, stored):
    updates = spark.createDataFrame([("b", 9, None), ("z", 5, None)], "id string, n int, s string")
    assert rows(docs.doc_merge(stored, updates), "id", "n", "s") == [("a", 1, "x"), ("b", 9, "y")]
    added = docs.doc_merge(stored, updates, upsert=True)
    assert rows(added, "id", "n", "s") == [("a", 1, "x"), ("b", 9, "y"), ("z", 5, None)]


def test_merge_with_supplied_null_and_replace(spark, stored):
    updates = spark.createDataFrame(
        [("b", 9, None, 1.5, ["s", "extra"])],
        "id string, n int, s string, extra double, given array<string>",
    )
    merged = docs.doc_merge(stored, updates, supplied="given")
    assert rows(merged, "id", "n", "s", "extra") == [("a", 1, "x", None), ("b", 2, None, 1.5)]
    replaced = docs.doc_merge(stored, updates.drop("given", "s", "extra"), replace=True)
    assert rows(replaced, "id", "n", "s") == [("a", 1, "x"), ("b", 9, None)]


def test_latest_update_wins(spark, stored):
    updates = spark.createDataFrame(
        [("b", 5, None, 1), ("b", 7, "q", 3), ("b", 6, None, 2)], "id string, n int, s string, seq int"
    )
    last = docs.latest_update(updates, "id", "seq")
    assert rows(docs.doc_merge(stored, last), "id", "n", "s") == [("a", 1, "x"), ("b", 7, "q")]


def test_insert_delete_group(spark, stored, tmp_path):
    new = spark.createDataFrame([("c", True)], "id string, flag boolean")
    both = docs.doc_insert(stored, new)
    assert rows(both, "id", "n", "flag") == [("a", 1, None), ("b", 2, None), ("c", None, True)]
    keys = spark.createDataFrame([("a",), ("a",), ("q",)], "id string")
    assert rows(docs.doc_delete(stored, keys), "id") == [("b",)]
    root = str(tmp_path / "store")
    stored.write.parquet(f"{root}/users/u1/items")
    new.write.parquet(f"{root}/items")
    stored.write.parquet(f"{root}/items2")
    stored.write.parquet(f"{root}/a/b/c/d/items")
    assert docs.scan_collection_group(spark, root, "items").count() == 5


def test_inventory(spark, tmp_path):
    (tmp_path / "logistic").mkdir()
    (tmp_path / "logistic" / "part-0").write_bytes(b"x" * 2_000_000)
    (tmp_path / "logistic" / "part-1").write_bytes(b"x" * 97_152)
    (tmp_path / "results.json").write_text("{}")
    found = artifact_inventory(spark, str(tmp_path), ["logistic", "results.json", "tree"])
    by_name = {r["name"]: r for r in found.collect()}
    assert (by_name["logistic"]["files"], by_name["logistic"]["size_bytes"]) == (2, 2_097_152)
    assert by_name["logistic"]["size_mb"] == 2.0 and by_name["results.json"]["size_mb"] == 0.0
    assert not by_name["tree"]["present"] and by_name["tree"]["modified"] is None
    assert [r[0] for r in missing_artifacts(found).collect()] == ["tree"]
    assert missing_artifacts(artifact_inventory(spark, str(tmp_path), ["q"])).count() == 1


def test_redaction_at_depth(spark):
    df = spark.createDataFrame(
        [(1, {"auth_token": 5, "n": 6}, [Row(Password="p", inner=Row(secret="s", ok="o"))])],
        "id int, m map<string,int>, a array<struct<Password:string,inner:struct<secret:string,ok:string>>>",
    )
    row = redact_keys(df).first()
    assert row["m"] == {"auth_token": None, "n": 6}  # a map keeps its type
    assert row["a"][0]["Password"] == "[REDACTED]" and row["a"][0]["inner"]["secret"] == "[REDACTED]"
    assert row["a"][0]["inner"]["ok"] == "o"


def test_redaction_of_variant(spark):
    texts = [
        '{"password":"x","a":[{"Api_Key":{"k":[1,{"z":2}]},"n":1.50}],"tokenish":[1,2]}',
        '{"a":"password","b":{"c":"secret: x"}}',
        '{"x\\"password":1,"pass\\u0077ord":"y"}',
        "[1,2]",
        '"secret"',
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    df = df.selectExpr("id", "parse_json(t) as v", "named_struct('inner', parse_json(t)) as s")
    rows = redact_keys(df).selectExpr("id", "to_json(v) as v", "to_json(s.inner) as s").collect()
    got = {r["id"]: r["v"] for r in rows}
    assert all(r["v"] == r["s"] for r in rows)
    assert got[0] == '{"a":[{"Api_Key":"[REDACTED]","n":1.5}],"password":"[REDACTED]","tokenish":"[REDACTED]"}'
    assert got[1] == texts[1] and got[3] == "[1,2]" and got[4] == '"secret"' and got[5] is None
    assert "y" not in got[2] and got[2].count("[REDACTED]") == 2
    assert "Python" not in redact_keys(df)._jdf.queryExecution().executedPlan().toString()


def test_masked_variant_keeps_the_types_of_its_leaves(spark):
    df = spark.sql(
        """select to_variant_object(named_struct('at', timestamp'2024-01-02 03:04:05', 'n', 1.50BD, 'raw', X'0102',
             'token', 5, 'in', array(named_struct('secret', 'x', 'day', date'2024-01-02', 'none', cast(null as int))),
             'e', cast(array() as array<int>), 'text', 'a secret word')) as v"""
    )
    row = redact_keys(df).selectExpr("to_json(v) as j", "schema_of_variant(v) as s").first()
    assert row["s"] == (
        "OBJECT<at: TIMESTAMP, e: ARRAY<VOID>, in: ARRAY<OBJECT<day: DATE, none: VOID, secret: STRING>>, "
        "n: DECIMAL(2,1), raw: BINARY, text: STRING, token: STRING>"
    )
    assert '"secret":"[REDACTED]"' in row["j"] and '"token":"[REDACTED]"' in row["j"] and "a secret word" in row["j"]


def test_variant_inside_arrays_and_maps_is_masked(spark):
    df = spark.sql(
        """select array(parse_json('{"password":1,"n":2}'), parse_json('[1]')) as a,
             map('k', parse_json('{"b":[{"Api_Key":{"z":1}}]}'), 'token', parse_json('7')) as m,
             array(named_struct('s', parse_json('{"x":{"private_key":[1]}}'))) as d"""
    )
    row = redact_keys(df).selectExpr(
        "to_json(a[0]) a0", "to_json(a[1]) a1", "to_json(m['k']) mk", "to_json(m['token']) mt", "to_json(d[0].s) d"
    ).first()
    assert list(row) == [
        '{"n":2,"password":"[REDACTED]"}', "[1]", '{"b":[{"Api_Key":"[REDACTED]"}]}', '"[REDACTED]"',
        '{"x":{"private_key":"[REDACTED]"}}',
    ]


def test_variant_nested_deeper_than_it_is_walked_lets_nothing_through(spark):
    from rowforge.functions import redaction

    def nested(depth, inner):
        return '{"a":' * depth + inner + "}" * depth

    deep = redaction.VARIANT_LEVELS + 5
    texts = [nested(deep, '{"token":"s3"}'), nested(deep, '"token"'), nested(3, '[[{"token":"s3"}]]')]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").selectExpr("id", "parse_json(t) as v")
    got = {r["id"]: r["j"] for r in redact_keys(df).selectExpr("id", "to_json(v) as j").collect()}
    assert got[0] == nested(redaction.VARIANT_LEVELS, '"[REDACTED]"')
    assert got[1] == texts[1] and got[2] == nested(3, '[[{"token":"[REDACTED]"}]]')


def test_collection_groups_at_any_depth(spark, tmp_path):
    from rowforge.sources import documents as docs

    root = str(tmp_path / "store")
    for depth in (0, 1, 5, 6, 9):
        below = "".join(f"/c{i}/d{i}" for i in range(depth))
        spark.createDataFrame([(depth,)], "depth int").write.parquet(f"{root}{below}/wanted")
    spark.createDataFrame([(99,)], "depth int").write.parquet(f"{root}/c0/d0/other")
    found = docs.scan_collection_group(spark, root, "wanted")
    assert sorted(r["depth"] for r in found.collect()) == [0, 1, 5, 6, 9]
    typed = docs.scan_collection_group(spark, root, "wanted", found.schema)
    assert typed.count() == 5
    assert docs.scan_query(spark, root, "wanted", {"collectionGroup": True}).count() == 5
    assert docs.scan_query(spark, root, "wanted", {}).count() == 1
    assert docs.scan_collection_group(spark, root, "absent", found.schema).count() == 0


def test_catalogued_groups_need_no_listing_of_folders(spark, tmp_path, monkeypatch):
    from rowforge.sources import documents as docs

    root = str(tmp_path / "store")
    docs.write_collection(spark.createDataFrame([(1, "a")], "n int, t string"), root, "wanted")
    docs.write_collection(spark.createDataFrame([(2, 0.5)], "n int, d double"), root, "c/d/e/f/wanted")
    docs.write_collection(spark.createDataFrame([(3, 1.5)], "n int, d double"), root, "c/d/e/f/wanted")
    docs.write_collection(spark.createDataFrame([(9,)], "n int"), root, "c/d/other")
    monkeypatch.setattr(docs, "list_folders", None)
    found = docs.scan_catalogued_group(spark, root, "wanted")
    assert found.columns == ["d", "n", "t"]
    assert sorted(tuple(r) for r in found.select("n", "t", "d").collect()) == [(1, "a", None), (2, None, 0.5), (3, None, 1.5)]
    with pytest.raises(FileNotFoundError):
        docs.scan_catalogued_group(spark, root, "unknown")
    docs.register_collection(spark, root, "x/y/other", spark.createDataFrame([("s",)], "n string").schema)
    with pytest.raises(ValueError, match="n is"):
        docs.scan_catalogued_group(spark, root, "other")
