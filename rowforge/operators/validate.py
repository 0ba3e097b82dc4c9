"""Row validation: all rules of a row in one projection, nothing is thrown away."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numbers import (
    BOUNDS,
    CATEGORIES,
    above,
    coerce_float,
    truncate_number,
    in_bounds,
    in_category,
)
from ..functions.text import nfkc_all, sanitize_columns, sanitize_text

# Field lists, anomaly limits and the messages of the web rules.
TEXT_FIELDS = ["sex", "embarked"]
INTEGER_FIELDS = ["pclass", "sibsp", "parch"]
NUMERIC_FIELDS = ["pclass", "age", "sibsp", "parch", "fare"]
REQUIRED_FIELDS = ["pclass", "sex", "age", "sibsp", "parch", "fare", "embarked"]
DEFAULTS = {"age": 0, "fare": 0, "sibsp": 0, "parch": 0, "pclass": 3}
CHILD_AGE, HIGH_FARE, LOW_FARE, LARGE_FAMILY = 12, 100, 20, 10
WEB_MAX_AGE = 100
WEB_MESSAGES = {
    "pclass": "Passenger class must be 1, 2, or 3",
    "age": "Age must be between 0 and 100",
    "fare": "Fare must be non-negative",
    "sex": 'Sex must be "male" or "female"',
    "embarked": 'Embarked must be "C", "Q", or "S"',
}
SCHEMA_RANGES = {
    "pclass": (1, 3),
    "age": (0, 120),
    "sibsp": (0, None),
    "parch": (0, None),
    "fare": (0, None),
}
SCHEMA_ENUMS = {"sex": ["male", "female"], "embarked": ["C", "Q", "S"]}

ISSUES = "array<struct<field:string,issue:string>>"


def _given(df: DataFrame, name: str, prefix: str) -> Column:
    """The column, or its default where the column or the value is absent."""
    default = F.lit(DEFAULTS[name])
    column = prefix + name
    return F.coalesce(F.col(column), default) if column in df.columns else default


def required_fields(df: DataFrame, names: list[str] = REQUIRED_FIELDS) -> Column:
    """Names of the required fields that are null or empty in a row."""
    marks = []
    for name in names:
        if name not in df.columns:
            marks.append(F.lit(name))
            continue
        missing = F.col(name).isNull()
        if isinstance(df.schema[name].dataType, T.StringType):
            missing = missing | (F.col(name) == "")
        marks.append(F.when(missing, name))
    return F.array_compact(F.array(*marks))


def schema_constraints(df: DataFrame) -> Column:
    """Fields of a row that break the request schema, in schema order."""
    broken = []
    for name in REQUIRED_FIELDS:
        value = F.col(name)
        if name in SCHEMA_ENUMS:
            ok = value.isin(SCHEMA_ENUMS[name])
        else:
            low, high = SCHEMA_RANGES[name]
            ok = ~F.isnan(value.cast("double")) & (value >= low)
            ok = ok if high is None else ok & (value <= high)
        broken.append(F.when(~F.coalesce(ok, F.lit(False)), name))
    return F.array_compact(F.array(*broken))


def web_issue(df: DataFrame) -> Column:
    """Message of the first web rule a row breaks, or null; NaN breaks no range."""
    pclass, age, fare = F.col("pclass"), F.col("age"), F.col("fare")
    rules = [
        ("pclass", (pclass < 1) | above(pclass, 3)),
        ("age", (age < 0) | above(age, WEB_MAX_AGE)),
        ("fare", fare < 0),
        ("sex", ~F.col("sex").isin(CATEGORIES["sex"])),
        ("embarked", ~F.col("embarked").isin(CATEGORIES["embarked"])),
    ]
    return F.coalesce(*[F.when(broken, WEB_MESSAGES[name]) for name, broken in rules])


def web_validate(df: DataFrame) -> DataFrame:
    """Missing required fields first; the other rules only for complete rows."""
    missing = required_fields(df)
    return df.withColumn("missing_fields", missing).withColumn(
        "web_issue", F.when(F.size("missing_fields") == 0, web_issue(df))
    )


def detect_anomalies(df: DataFrame, prefix: str = "") -> Column:
    """Names of the unusual combinations in a row."""
    age, fare, pclass, sibsp, parch = (
        _given(df, name, prefix) for name in ("age", "fare", "pclass", "sibsp", "parch")
    )
    child = (age < CHILD_AGE) & above(fare, HIGH_FARE)
    large = sibsp + parch + 1 > LARGE_FAMILY
    cheap = (pclass == 1) & (fare < LOW_FARE)
    dear = (pclass == 3) & above(fare, HIGH_FARE)
    return _named(
        {
            "child_high_fare": child,
            "large_family_size": large,
            "first_class_low_fare": cheap,
            "third_class_high_fare": dear,
        }
    )


def _named(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that hold. Most rows have none, and skip the array work."""
    names = F.array(*[F.when(holds, name) for name, holds in conditions.items()])
    return F.when(reduce(or_, conditions.values()), F.array_compact(names)).otherwise(
        F.array().cast("array<string>")
    )


def _as_text(value: Column) -> Column:
    """A missing text is the word the request layer spells for it, never a category."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def validate_rows(df: DataFrame) -> DataFrame:
    """Clean columns plus ``issues``, ``first_issue``, ``is_valid``, ``anomalies``.

    Texts are checked first, then numbers, then categories; the first issue in this
    order is the one a single request would be refused for. A null counts as a value
    of the wrong type. Only the fields the table has are checked.
    """
    texts = [f for f in TEXT_FIELDS if f in df.columns]
    numbers = [f for f in NUMERIC_FIELDS if f in df.columns]
    read = {
        f: (truncate_number if f in INTEGER_FIELDS else coerce_float)(F.col(f), df.schema[f].dataType)
        for f in numbers
    }
    cleaned = sanitize_columns(df, {f"__{f}": _as_text(F.col(f)) for f in texts}).withColumns(
        {f"__{f}": value for f, value in read.items()}
    )

    refused: list[tuple[str, Column, Column]] = []  # field, condition, code
    for f in texts:
        issue = F.col(f"__{f}_issue")
        refused.append((f, issue.isNotNull(), issue))
    for f in numbers:
        value = F.col(f"__{f}")
        code = "not_integer" if f in INTEGER_FIELDS else "not_numeric"
        refused.append((f, value.isNull(), F.lit(code)))
        if f in BOUNDS:
            outside = value.isNotNull() & ~in_bounds(value, f)
            refused.append((f, outside, F.lit("out_of_range")))
    for f in [*texts, *(f for f in numbers if f in CATEGORIES)]:
        value = F.col(f"__{f}_value" if f in texts else f"__{f}")
        unknown = value.isNotNull() & ~in_category(value, f)
        refused.append((f, unknown, F.lit("invalid_value")))

    invalid = reduce(or_, [condition for _, condition, _ in refused])
    issues = F.array_compact(
        F.array(
            *[
                F.when(condition, F.struct(F.lit(f).alias("field"), code.alias("issue")))
                for f, condition, code in refused
            ]
        )
    )
    first = F.coalesce(
        *[F.when(condition, F.concat(F.lit(f + ":"), code)) for f, condition, code in refused]
    )
    clean = {f"clean_{f}": F.col(f"__{f}_value") for f in texts}
    clean.update(
        {
            f"clean_{f}": F.col(f"__{f}").try_cast("int" if f in INTEGER_FIELDS else "double")
            for f in numbers
        }
    )
    result = cleaned.withColumns({**clean, "is_valid": ~invalid})
    good = F.col("is_valid")
    helpers = [f"__{f}" for f in numbers]
    helpers += [f"__{f}_{part}" for f in texts for part in ("value", "issue")]
    return result.withColumns(
        {
            "issues": F.when(good, F.array().cast(ISSUES)).otherwise(issues),
            "first_issue": F.when(~good, first),
            "anomalies": F.when(good, detect_anomalies(result, "clean_")),
        }
    ).drop(*helpers)


def validate_params(params: Column) -> Column:
    """Sanitise every text of a parameter map; value and issue per key."""
    texts = F.map_values(params)
    pairs = F.arrays_zip(texts.alias("raw"), nfkc_all(texts).alias("nfkc"))
    checked = F.transform(pairs, lambda p: sanitize_text(p["raw"], normalized=p["nfkc"]))
    return F.map_from_arrays(F.map_keys(params), checked)


def anomaly_counts(df: DataFrame, anomalies: Column) -> DataFrame:
    """Rows per anomaly."""
    return (
        df.select(F.explode(anomalies).alias("anomaly"))
        .groupBy("anomaly")
        .agg(F.count("*").alias("n"))
    )


def issue_counts(validated: DataFrame, issues: str = "issues") -> DataFrame:
    """Issues per field and code."""
    return (
        validated.select(F.inline(issues))
        .groupBy("field", "issue")
        .agg(F.count("*").alias("n"))
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows."""
    return (
        validated.where(F.col("is_valid")),
        validated.where(~F.col("is_valid")),
    )
