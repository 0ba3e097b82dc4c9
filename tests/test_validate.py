from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rowforge.operators import validate as vd

TEXT = "pclass string, sex string, age string, sibsp string, parch string, fare string, embarked string"
TYPED = "pclass int, sex string, age double, sibsp int, parch int, fare double, embarked string"
GOOD = ("1", "female", "25.0", "0", "0", "100.0", "S")


def change(**fields):
    names = [part.split()[0] for part in TEXT.split(", ")]
    return tuple(fields.get(n, v) for n, v in zip(names, GOOD))


@pytest.mark.parametrize(
    "row, issue",
    [
        (GOOD, None),
        (change(pclass="4"), "pclass:invalid_value"),
        (change(sex="other"), "sex:invalid_value"),
        (change(age="-5.0"), "age:out_of_range"),
        (change(sex="male'; DROP TABLE users; --"), "sex:invalid_characters"),
        (change(embarked="<script>"), "embarked:invalid_characters"),
        (change(sex=" female "), None),
        (change(pclass="abc"), "pclass:not_integer"),
        (change(fare="dear"), "fare:not_numeric"),
        (change(fare="1000"), None),
        (change(fare="1000.01"), "fare:out_of_range"),
        (change(age="120"), None),
        (change(sex=None), "sex:invalid_value"),
        (change(age=None), "age:not_numeric"),
        # texts before numbers before categories
        (change(age="old", sex="x;"), "sex:invalid_characters"),
        (change(age="old", sex="other"), "age:not_numeric"),
        (change(sex="ｍａｌｅ"), None),
    ],
)
def test_first_issue(spark, row, issue):
    found = vd.validate_rows(spark.createDataFrame([row], TEXT)).first()
    assert (found["first_issue"], found["is_valid"]) == (issue, issue is None)


def test_text_numbers_are_coerced_and_absent_fields_skipped(spark):
    df = spark.createDataFrame(
        [("2", "male", "25.5", 1.0, 50, "C")],
        "pclass string, sex string, age string, sibsp double, fare int, embarked string",
    )
    row = vd.validate_rows(df).first()
    assert row["is_valid"] and row["issues"] == []
    assert (row["clean_pclass"], row["clean_age"], row["clean_sibsp"], row["clean_fare"]) == (2, 25.5, 1, 50.0)
    assert "clean_parch" not in row


def test_all_issues_are_kept(spark):
    df = spark.createDataFrame([change(sex="other", age="x", fare="-1", pclass="9")], TEXT)
    checked = vd.validate_rows(df)
    assert [tuple(i) for i in checked.first()["issues"]] == [
        ("age", "not_numeric"),
        ("fare", "out_of_range"),
        ("sex", "invalid_value"),
        ("pclass", "invalid_value"),
    ]
    good, bad = vd.split_valid(checked)
    assert (good.count(), bad.count()) == (0, 1)
    assert {(r["field"], r["n"]) for r in vd.issue_counts(checked).collect()} == {
        ("age", 1),
        ("fare", 1),
        ("sex", 1),
        ("pclass", 1),
    }


@pytest.mark.parametrize(
    "fields, expected",
    [
        (dict(pclass=2, age=30.0, fare=50.0, sibsp=1, parch=0), []),
        (dict(pclass=1, age=8.0, fare=200.0, sibsp=0, parch=2), ["child_high_fare"]),
        (dict(pclass=3, age=35.0, fare=30.0, sibsp=6, parch=5), ["large_family_size"]),
        (dict(pclass=2, age=35.0, fare=30.0, sibsp=5, parch=4), []),
        (dict(pclass=1, age=25.0, fare=5.0, sibsp=0, parch=0), ["first_class_low_fare"]),
        (dict(pclass=3, age=40.0, fare=150.0, sibsp=0, parch=0), ["third_class_high_fare"]),
        (dict(pclass=3, age=4.0, fare=150.0), ["child_high_fare", "third_class_high_fare"]),
        (dict(fare=150.0), ["child_high_fare", "third_class_high_fare"]),
        (dict(pclass=3, age=40.0, fare=math.nan), []),
    ],
)
def test_anomalies(spark, fields, expected):
    df = spark.createDataFrame([tuple(fields.values())], list(fields))
    assert df.select(vd.detect_anomalies(df)).first()[0] == expected


@pytest.mark.parametrize(
    "fields, missing, issue",
    [
        ({}, [], None),
        (dict(sex="", embarked=None), ["sex", "embarked"], None),
        (dict(pclass=0), [], "Passenger class must be 1, 2, or 3"),
        (dict(age=100.5), [], "Age must be between 0 and 100"),
        (dict(age=math.nan), [], None),
        (dict(fare=-1.0, sex="x"), [], "Fare must be non-negative"),
        (dict(sex="x", embarked="Z"), [], 'Sex must be "male" or "female"'),
        (dict(embarked="Z"), [], 'Embarked must be "C", "Q", or "S"'),
    ],
)
def test_web_rules(spark, fields, missing, issue):
    base = dict(pclass=1, sex="male", age=30.0, sibsp=0, parch=0, fare=10.0, embarked="S")
    row = vd.web_validate(spark.createDataFrame([tuple({**base, **fields}.values())], TYPED)).first()
    assert (row["missing_fields"], row["web_issue"]) == (missing, issue)


def test_request_schema(spark):
    rows = [
        (1, "male", 30.0, 0, 0, 10.0, "S"),
        (4, "man", 121.0, -1, None, math.nan, "X"),
    ]
    df = spark.createDataFrame(rows, TYPED)
    found = [r[0] for r in df.select(vd.schema_constraints(df)).collect()]
    assert found == [[], ["pclass", "sex", "age", "sibsp", "parch", "fare", "embarked"]]


def test_parameters(spark):
    df = spark.createDataFrame([({"a": " x ", "b": "1;2", "c": "ﬁn", "d": None},)], "p map<string,string>")
    row = df.select(vd.validate_params(F.col("p")).alias("p")).first()["p"]
    assert {k: tuple(v) for k, v in row.items()} == {
        "a": ("x", None),
        "b": (None, "invalid_characters"),
        "c": ("fin", None),
        "d": (None, "type"),
    }


def test_numbers_beyond_64_bits_are_out_of_range_and_no_type_error(spark):
    from rowforge.operators.validate import validate_rows

    rows = [("1e30", "1e30"), ("inf", "nan"), ("2.9", "1"), ("-9e25", "7")]
    df = spark.createDataFrame(rows, "pclass string, sibsp string")
    got = [r["first_issue"] for r in validate_rows(df).collect()]
    by_field = [{(i["field"], i["issue"]) for i in r["issues"]} for r in validate_rows(df).collect()]
    assert by_field[0] == {("pclass", "invalid_value"), ("sibsp", "out_of_range")}
    assert by_field[1] == {("pclass", "not_integer"), ("sibsp", "not_integer")}
    assert got[2] is None and by_field[3] == {("pclass", "invalid_value")}
