from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from rowforge.functions import names, tokens


def token(payload, parts=3):
    def part(value):
        return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")

    return ".".join([part({"alg": "RS256"}), part(payload), "sig", "more"][:parts])


NOW = 1_700_000_000
GOOD = {"user_id": "7", "username": "ünï", "exp": NOW + 1, "iat": NOW, "aud": "svc", "iss": "me"}


def found(spark, texts, build):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", build(F.col("t")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def claims_of(spark, texts, build=lambda c: c):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = tokens.decode_tokens(df, "t", "c").select("i", build(F.col("c")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_claims(spark):
    texts = [
        token(GOOD),
        token(GOOD, 2),
        token(GOOD, 4),
        "a.@@@.c",
        "a." + base64.b64encode(b"not json").decode() + ".c",
        token(5),
        token([1]),
        "",
        None,
        token({"exp": 1, "new": True}),
    ]
    claims = claims_of(spark, texts)
    assert tuple(claims[0]) == ("7", "ünï", NOW + 1, NOW, "svc", "me")
    assert claims[1:9] == [None] * 8
    assert claims[9]["exp"] == 1 and claims[9]["user_id"] is None


def test_expiry(spark):
    texts = [token({**GOOD, "exp": e}) for e in (NOW - 1, NOW, NOW + 1, 0, None)] + ["bad", None]
    expired = claims_of(spark, texts, lambda c: tokens.token_expired(c["exp"], F.lit(NOW)))
    assert expired == [True, False, False, True, True, True, True]


@pytest.mark.parametrize(
    "change, issue",
    [
        ({}, None),
        ({"exp": NOW - 1}, "expired"),
        ({"aud": "x"}, "wrong_audience"),
        ({"iss": None}, "wrong_issuer"),
        ({"user_id": None}, "missing_user_id"),
    ],
)
def test_claims_check(spark, change, issue):
    check = lambda c: tokens.claims_issue(c, "svc", "me", F.lit(NOW))
    assert claims_of(spark, [token({**GOOD, **change}), "x"], check) == [issue, "malformed"]


def test_collection_names(spark):
    texts = ["books", "  books ", "", "  ", None, "a/b", "a..b", "a?b", "a#", "a&b", "a\x1fb", "ä"]
    assert found(spark, texts, names.collection_name_issue) == [
        None,
        None,
        "empty",
        "empty",
        "empty",
        "separator",
        "traversal",
        "url_characters",
        "url_characters",
        "url_characters",
        "control_characters",
        None,
    ]


def test_document_paths(spark):
    texts = ["books/b1", "books", "a/b/c", "a/b/c/d", "a//c/d", "/b", "a/b/", "a/../b/c", "a/b?x", "", "a/ "]
    assert found(spark, texts, names.document_path_issue) == [
        None,
        "odd_segments",
        "odd_segments",
        None,
        "empty_segment",
        "empty_segment",
        "odd_segments",
        "traversal",
        "url_characters",
        "empty",
        "empty_segment",
    ]
    assert found(spark, ["x/y/z/id1", "id"], names.doc_id_from_path) == ["id1", "id"]
