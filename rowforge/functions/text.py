"""Text checks and cleaning as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The patterns, the escapes and the length limit of the text rules.
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
SQL_PATTERN = (
    r"(\b(union|select|insert|update|delete|drop|create|alter|exec|execute)\b"
    r"|['\";]|--|\*|/\*|\*/)"
)
XSS_PATTERN = (
    r"(<script|<iframe|<object|<embed|javascript:|vbscript:|on\w+\s*=)"
)
WHITESPACE_RUN = 10
MAX_TEXT_LENGTH = 100
HTML_ESCAPES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
]
EMPTY_ISSUE = "empty_after_sanitization"

#: Unicode white space, with the four separators that count as space in text code.
_SPACE = r"[\s\x1c-\x1f]"


def has_control_chars(text: Column) -> Column:
    return text.rlike(CONTROL_PATTERN)


def has_sql_injection(text: Column) -> Column:
    return text.rlike("(?iU)" + SQL_PATTERN)


def has_xss(text: Column) -> Column:
    return text.rlike("(?iU)" + XSS_PATTERN)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Pure ASCII is unchanged by it, so only other text goes to Python."""
    foreign = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.coalesce(_nfkc(foreign), text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_all(texts: pd.Series) -> pd.Series:
    def normalize(items):
        return [s if s is None else unicodedata.normalize("NFKC", s) for s in items]

    return texts.map(normalize, na_action="ignore")


def nfkc_all(texts: Column) -> Column:
    """``nfkc`` of every item of an array."""
    foreign = F.when(F.exists(texts, lambda s: s.rlike(r"[^\x00-\x7f]")), texts)
    return F.coalesce(_nfkc_all(foreign), texts)


def html_escape(text: Column) -> Column:
    for char, entity in HTML_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends (``trim`` knows blanks only)."""
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def squeeze_whitespace(text: Column) -> Column:
    """Runs of ten or more white space characters become one blank; then strip."""
    runs = rf"(?U){_SPACE}{{{WHITESPACE_RUN},}}"
    return strip(F.regexp_replace(text, runs, " "))


def length_issue(text: Column) -> Column:
    """Why a cleaned text has a bad length, or null."""
    return F.when(F.length(text) == 0, EMPTY_ISSUE).when(
        F.length(text) > MAX_TEXT_LENGTH, "too_long"
    )


def content_issue(text: Column) -> Column:
    """The first pattern a raw text trips over, or null."""
    return F.when(has_control_chars(text), "control_characters").when(
        has_sql_injection(text) | has_xss(text), "invalid_characters"
    )


def normalize_case(text: Column, upper: bool = False) -> Column:
    """Trimmed text in lower or upper case."""
    trimmed = F.trim(text)
    return F.upper(trimmed) if upper else F.lower(trimmed)


def clean_text(text: Column) -> Column:
    """Normalise, escape and squeeze, without any check."""
    return squeeze_whitespace(html_escape(nfkc(text)))


def sanitize_text(text: Column, is_text: bool = True, normalized: Column | None = None) -> Column:
    """Struct of the cleaned value and of the first issue; one of the two is null.

    ``is_text=False`` marks a column that is not of string type: every value fails.
    ``normalized`` is the NFKC form, where it is at hand already.
    """
    if not is_text:
        return F.struct(F.lit(None).cast("string").alias("value"), F.lit("type").alias("issue"))
    cleaned = clean_text(text) if normalized is None else squeeze_whitespace(html_escape(normalized))
    issue = text_issue(text, cleaned)
    return F.struct(F.when(issue.isNull(), cleaned).alias("value"), issue.alias("issue"))


def text_issue(raw: Column, cleaned: Column) -> Column:
    """The first issue of a text, given its cleaned form; each check runs once."""
    return F.coalesce(F.when(raw.isNull(), "type"), content_issue(raw), length_issue(cleaned))


def sanitize_columns(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add ``<name>_value`` and ``<name>_issue`` per text.

    As ``sanitize_text``, but in steps of their own columns: each check runs once, and
    only texts with acceptable content are cleaned at all.
    """
    issue, value = "{}_issue".format, "{}_value".format
    checked = df.withColumns({issue(name): content_issue(raw) for name, raw in texts.items()})
    cleaned = checked.withColumns(
        {
            value(name): clean_text(F.when(F.col(issue(name)).isNull(), raw))
            for name, raw in texts.items()
        }
    )
    judged = cleaned.withColumns(
        {
            issue(name): F.coalesce(
                F.when(raw.isNull(), "type"), F.col(issue(name)), length_issue(F.col(value(name)))
            )
            for name, raw in texts.items()
        }
    )
    return judged.withColumns(
        {value(name): F.when(F.col(issue(name)).isNull(), F.col(value(name))) for name in texts}
    )


def words(text: Column) -> Column:
    """Lower-case words of a text, as an array."""
    return F.array_remove(F.split(F.lower(text), "[^a-z]+"), "")


def word_search(text: Column, terms: list[str]) -> Column:
    """True when any of the search words is a word of the text."""
    return F.arrays_overlap(words(text), F.array(*[F.lit(t.lower()) for t in terms]))
