from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F, types as T

from rowforge.functions import typed
from rowforge.sources import documents as docs

UTC = datetime.timezone.utc


def encoded(spark, value, kind):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    text = df.select(typed.encode_fields(df)).first()[0]
    return json.loads(text)["v"]


NESTED = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType())])


@pytest.mark.parametrize(
    "value, kind, expected",
    [
        ("x", T.StringType(), {"stringValue": "x"}),
        ("", T.StringType(), {"stringValue": ""}),
        ('q"\\\n', T.StringType(), {"stringValue": 'q"\\\n'}),
        (25, T.LongType(), {"integerValue": "25"}),
        (0, T.IntegerType(), {"integerValue": "0"}),
        (9007199254740991, T.LongType(), {"integerValue": "9007199254740991"}),
        (19.99, T.DoubleType(), {"doubleValue": 19.99}),
        (25.0, T.DoubleType(), {"integerValue": "25"}),
        (-3.0, T.DoubleType(), {"integerValue": "-3"}),
        (1e15, T.DoubleType(), {"integerValue": "1000000000000000"}),
        (1e20, T.DoubleType(), {"integerValue": "100000000000000000000"}),
        (2.0**69, T.DoubleType(), {"integerValue": "590295810358705700000"}),
        (-1e21, T.DoubleType(), {"integerValue": "-1e+21"}),
        (1.7976931348623157e308, T.DoubleType(), {"integerValue": "1.7976931348623157e+308"}),
        (float("nan"), T.DoubleType(), {"doubleValue": None}),
        (True, T.BooleanType(), {"booleanValue": True}),
        (False, T.BooleanType(), {"booleanValue": False}),
        (None, T.StringType(), {"nullValue": None}),
        (None, NESTED, {"nullValue": None}),
        (
            datetime.datetime(2023, 1, 1, tzinfo=UTC),
            T.TimestampType(),
            {"timestampValue": "2023-01-01T00:00:00.000Z"},
        ),
        (
            ["a", "b"],
            T.ArrayType(T.StringType()),
            {"arrayValue": {"values": [{"stringValue": "a"}, {"stringValue": "b"}]}},
        ),
        ([], T.ArrayType(T.LongType()), {"arrayValue": {"values": []}}),
        ([None], T.ArrayType(T.LongType()), {"arrayValue": {"values": [{"nullValue": None}]}}),
        ({}, T.MapType(T.StringType(), T.LongType()), {"mapValue": {"fields": {}}}),
        (
            {'k"': 1},
            T.MapType(T.StringType(), T.LongType()),
            {"mapValue": {"fields": {'k"': {"integerValue": "1"}}}},
        ),
        (
            ("x", None),
            NESTED,
            {"mapValue": {"fields": {"a": {"stringValue": "x"}, "n": {"nullValue": None}}}},
        ),
    ],
)
def test_encoding(spark, value, kind, expected):
    assert encoded(spark, value, kind) == expected


def test_mixed_values_through_variant(spark):
    text = '{"m":[1,"a",true,null,2.5,3.0,{"x":[]}],"e":{},"big":1e21,"s":"ﬁ"}'
    df = spark.createDataFrame([("1", text)], "id string, t string").select(
        "id", F.parse_json("t").alias("v")
    )
    out = json.loads(typed.encode_typed(df, "id", "c").first()["value"])
    mixed = out["fields"]["v"]["mapValue"]["fields"]["m"]["arrayValue"]["values"]
    assert mixed == [
        {"integerValue": "1"},
        {"stringValue": "a"},
        {"booleanValue": True},
        {"nullValue": None},
        {"doubleValue": 2.5},
        {"integerValue": "3"},
        {"mapValue": {"fields": {"x": {"arrayValue": {"values": []}}}}},
    ]
    schema = T._parse_datatype_string("v variant")
    lines = typed.encode_typed(df, "id", "c")
    parsed = lines.select(F.from_json("value", typed.document_type(schema)).alias("d")).select("d.*")
    back = typed.unwrap_documents(parsed, schema).select(F.to_json("v").alias("v")).first()["v"]
    assert json.loads(back) == json.loads(text)
    assert typed.unwrap_value(typed.wrap_value(json.loads(text))) == json.loads(text)


@pytest.mark.parametrize("kind", [T.DateType(), T.BinaryType(), T.DayTimeIntervalType()])
def test_unsupported_types(kind):
    with pytest.raises(TypeError, match="unsupported type"):
        typed.check_encodable(T.StructType([T.StructField("a", T.ArrayType(kind))]))


def test_round_trip(spark, tmp_path):
    schema = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("s", T.StringType()),
            T.StructField("i", T.LongType()),
            T.StructField("d", T.DoubleType()),
            T.StructField("b", T.BooleanType()),
            T.StructField("t", T.TimestampType()),
            T.StructField("a", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("m", T.MapType(T.StringType(), NESTED)),
            T.StructField("n", NESTED),
        ]
    )
    when = datetime.datetime(2024, 2, 3, 4, 5, 6, 789000)
    rows = [
        ("1", "x", 5, 2.5, True, when, [[1], [], None], {"k": ("a", 1), "z": None}, ("b", None)),
        ("2", None, None, None, None, None, None, None, None),
        ("3", "", 0, 1e300, False, when, [], {}, (None, None)),
    ]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "docs")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    docs.write_typed(typed.encode_typed(df, "id", "c", stamp), path)
    raw = docs.scan_collection_raw(spark, path)
    assert raw.first()["createTime"] == "2024-01-01T00:00:00.000Z"
    assert docs.get_document_raw(raw, "c/2").count() == 1
    target = T.StructType(schema.fields[1:])
    assert sorted(typed.decode_typed(raw, target).collect()) == sorted(df.collect())
    again = docs.scan_collection_typed(spark, path, target)
    assert again.dtypes == df.dtypes and sorted(again.collect()) == sorted(df.collect())


def test_decoding_of_absent_members(spark):
    lines = [
        '{"name":"c/1","fields":{"a":{"arrayValue":{}},"m":{"mapValue":{}},"i":{"integerValue":"12x"}}}',
        '{"name":"c/2"}',
    ]
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    raw = df.select(F.from_json("value", typed.DOCUMENT).alias("d")).select("d.*")
    target = "a array<string>, m struct<x:string>, i bigint"
    rows = typed.decode_typed(raw, T._parse_datatype_string(target)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", None, None, 12), ("2", None, None, None)]
    schema = T._parse_datatype_string(target)
    parsed = df.select(F.from_json("value", typed.document_type(schema)).alias("d")).select("d.*")
    assert sorted(typed.unwrap_documents(parsed, schema).collect()) == sorted(rows)


def test_typed_rows_pass_through(spark):
    df = spark.createDataFrame(
        [("1", '{"x":{"stringValue":"y"}}', 1), ("2", None, 2)], "id string, fields string, n int"
    )
    found = [r[0] for r in df.select(typed.ensure_typed(df, exclude=["id"])).collect()]
    assert found == ['{"x":{"stringValue":"y"}}', '{"n":{"integerValue":"2"}}']
