from __future__ import annotations

import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from rowforge.functions import text as tx


def values(spark, texts, check):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", check(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


SQL = ["'; DROP TABLE users; --", "1 UNION SELECT * FROM users", "admin'--", "x OR 1=1; DELETE FROM y"]
XSS = [
    "<script>alert(1)</script>",
    "<iframe src=x>",
    "javascript:alert(1)",
    "<img src=x onerror=alert(1)>",
    "<object data=x>",
]


@pytest.mark.parametrize("texts", [SQL, XSS, ["male\x00", "fe\x1fmale", "x\x7f", "y\x85"]])
def test_bad_content_is_refused(spark, texts):
    assert all(r["issue"] for r in values(spark, texts, tx.sanitize_text))


def test_order_of_issues(spark):
    texts = ["a\x00'; drop", "union x", "", "   ", "x" * 101, "x" * 100, None, "male", "  female  "]
    found = values(spark, texts, tx.sanitize_text)
    assert [r["issue"] for r in found] == [
        "control_characters",
        "invalid_characters",
        "empty_after_sanitization",
        "empty_after_sanitization",
        "too_long",
        None,
        "type",
        None,
        None,
    ]
    assert [r["value"] for r in found[-2:]] == ["male", "female"]


def test_columns_and_struct_agree(spark):
    texts = ["a & b", "ﬁve", "x" * 101, "drop it", "", None, "ｍａｌｅ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    wide = tx.sanitize_columns(df, {"t": F.col("t")}).orderBy("i").collect()
    struct = values(spark, texts, tx.sanitize_text)
    assert [(r["t_value"], r["t_issue"]) for r in wide] == [tuple(s) for s in struct]


def test_wrong_type(spark):
    assert values(spark, ["1"], lambda t: tx.sanitize_text(t, is_text=False))[0]["issue"] == "type"


def test_nfkc_is_the_one_of_unicodedata(spark):
    texts = ["ascii", "ﬁ", "ｆｕｌｌ", "é", "①²", "é", "", None, "ẛ̣", "ℌ한　x"]
    assert values(spark, texts, tx.nfkc) == [
        None if t is None else unicodedata.normalize("NFKC", t) for t in texts
    ]
    packed = values(spark, texts, lambda t: tx.nfkc_all(F.array(t, F.lit("ﬂ"), F.lit(None).cast("string"))))
    assert packed[1] == ["fi", "fl", None]


def test_escape_is_the_one_of_html(spark):
    texts = ["<a href='x'>&amp; \"q\"</a>", "plain", "&&<<"]
    assert values(spark, texts, tx.html_escape) == [html.escape(t) for t in texts]


def test_squeeze_like_regular_expressions(spark):
    spaces = [" ", "\t", "\n", " ", " ", "\x1c", "　"]
    texts = ["a" + s * n + "b" + s for s in spaces for n in (5, 9, 10, 11)]
    texts += [" \n x \t", "a" + "".join(spaces) * 2 + "b"]
    expected = [re.sub(r"\s{10,}", " ", t).strip() for t in texts]
    assert values(spark, texts, tx.squeeze_whitespace) == expected


def test_patterns_like_regular_expressions(spark):
    texts = ["selection", "éselect", "select", "SeLeCt!", "conquest=", "on é=", "oné =1", "onclick =", "a*b", "x-y", "x--y"]
    sql = re.compile(tx.SQL_PATTERN, re.IGNORECASE)
    xss = re.compile(tx.XSS_PATTERN, re.IGNORECASE)
    assert values(spark, texts, tx.has_sql_injection) == [bool(sql.search(t)) for t in texts]
    assert values(spark, texts, tx.has_xss) == [bool(xss.search(t)) for t in texts]
