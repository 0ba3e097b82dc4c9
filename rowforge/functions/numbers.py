"""Coercion and range checks of numeric input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Hard bounds, typical maxima and valid categories of the input fields.
BOUNDS = {
    "age": (0, 120),
    "fare": (0, 1000),
    "sibsp": (0, 20),
    "parch": (0, 20),
}
TYPICAL_MAX = {"age": 80, "fare": 500, "sibsp": 8, "parch": 9}
CATEGORIES = {
    "sex": ["male", "female"],
    "embarked": ["C", "Q", "S"],
    "pclass": [1, 2, 3],
}

_DIGITS = r"\d+(?:_\d+)*"
_FLOAT = (
    rf"^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf|infinity|nan))\s*$"
)


def coerce_float(value: Column, kind: T.DataType | None = None) -> Column:
    """The number a text spells out in full, or null (``2.0f`` is not a number).

    ``kind`` is the type of the column where it is known: numbers need no reading.
    """
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return value.cast("double")
    text = value.cast("string")
    return F.when(text.rlike(_FLOAT), F.replace(text, F.lit("_")).try_cast("double"))


def coerce_int(value: Column, kind: T.DataType | None = None) -> Column:
    """As ``coerce_float``, then truncated; NaN and infinity have no integer."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint")
    return coerce_float(value, kind).try_cast("bigint")


def truncate_number(value: Column, kind: T.DataType | None = None) -> Column:
    """As ``coerce_int``, but as a double, so that whole numbers beyond 64 bits have a
    value to test bounds on; null where there is no integer."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value.cast("double")
    number = coerce_float(value, kind)
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    # floor returns 64-bit numbers; a remainder keeps large ones
    return F.when(finite, number - number % 1.0)


def parse_form_float(text: Column) -> Column:
    """The leading decimal number of a form entry, NaN when there is none."""
    found = F.regexp_extract(
        text, r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))", 1
    )
    return F.coalesce(found.try_cast("double"), F.lit(float("nan")))


def parse_form_int(text: Column) -> Column:
    """The leading whole number of a form entry (also 0x hex), NaN when there is none."""
    sign = F.when(text.rlike(r"^\s*-"), -1.0).otherwise(1.0)
    hexadecimal = F.regexp_extract(text, r"^\s*[+-]?0[xX]([0-9a-fA-F]+)", 1)
    decimal = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    number = F.when(
        hexadecimal != "", sign * F.conv(hexadecimal, 16, 10).try_cast("double")
    ).otherwise(decimal.try_cast("double"))
    return F.coalesce(number, F.lit(float("nan")))


def below(value: Column, bound: float) -> Column:
    return value < bound


def above(value: Column, bound: float) -> Column:
    """``value > bound``, false for NaN (which Spark sorts above every number)."""
    return (value > bound) & ~F.isnan(value.cast("double"))


def in_bounds(value: Column, field: str) -> Column:
    """Inside the hard bounds; fields without bounds always are, and so is NaN."""
    if field not in BOUNDS:
        return F.lit(True)
    low, high = BOUNDS[field]
    return ~(below(value, low) | above(value, high))


def is_outlier(value: Column, field: str) -> Column:
    """Allowed, but above the typical maximum."""
    return in_bounds(value, field) & above(value, TYPICAL_MAX[field])


def in_category(value: Column, field: str) -> Column:
    """One of the known categories; fields without any always pass."""
    if field not in CATEGORIES:
        return F.lit(True)
    return F.coalesce(value.isin(CATEGORIES[field]), F.lit(False))
