"""Shape, types and missing values of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns))
    )


def label_rate(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Mean of the label, over everything or per group."""
    groups = [by] if by else []
    return df.groupBy(*groups).agg(F.avg(label).alias("label_rate"), F.count("*").alias("n"))


def _per_column(df: DataFrame, columns: list[str], measure, name: str) -> DataFrame:
    """One aggregate per column in one pass, as a long table."""
    one = df.agg(*[measure(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)])
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias(name))
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*pairs)))


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column."""
    return _per_column(df, columns or df.columns, lambda c: F.count_if(c.isNull()), "nulls")


def profile_columns(df: DataFrame) -> DataFrame:
    """Type and number of present values per column."""
    types = dict(df.dtypes)
    counted = _per_column(df, df.columns, F.count, "non_null")
    pairs = [F.lit(x) for c in df.columns for x in (c, types[c])]
    return counted.withColumn("dtype", F.try_element_at(F.create_map(*pairs), F.col("column")))
