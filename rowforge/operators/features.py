"""Row-level feature columns of the passenger table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Columns without predictive use, age bands.
UNUSED_COLUMNS = ["name", "ticket", "cabin", "boat", "body", "home.dest"]
AGE_EDGES = [0, 18, 35, 60, 100]


def drop_columns(df: DataFrame, names: list[str] = UNUSED_COLUMNS) -> DataFrame:
    """Drop the named columns; absent ones are no error."""
    return df.drop(*names)


def family_size() -> Column:
    return F.col("sibsp") + F.col("parch") + 1


def is_alone(size: Column) -> Column:
    return (size == 1).cast("int")


def age_group(age: Column) -> Column:
    """Band number of right-closed bands, null outside all of them."""
    bands = F.when(age <= AGE_EDGES[0], F.lit(None).cast("int"))
    for code, edge in enumerate(AGE_EDGES[1:]):
        bands = bands.when(age <= edge, code)
    return bands


def age_group_legacy(age: Column) -> Column:
    """As ``age_group``, with -1 outside all bands and for a missing age."""
    return F.coalesce(age_group(age), F.lit(-1))


def derive_features(df: DataFrame) -> DataFrame:
    """Add family size, alone flag and age band, as far as their inputs exist."""
    if {"sibsp", "parch"} <= set(df.columns):
        df = df.withColumn("family_size", family_size())
    if "family_size" in df.columns:
        df = df.withColumn("is_alone", is_alone(F.col("family_size")))
    if "age" in df.columns:
        df = df.withColumn("age_group", age_group(F.col("age")))
    return df


def make_passenger_rows(
    df: DataFrame,
    pclass: Column,
    sex: Column,
    age: Column,
    sibsp: Column,
    parch: Column,
    fare: Column,
    embarked: Column,
    keep: list[str] = (),
) -> DataFrame:
    """Seven columns of any table as the input schema of the models."""
    return df.select(
        *keep,
        pclass.cast("int").alias("pclass"),
        sex.cast("string").alias("sex"),
        age.cast("double").alias("age"),
        sibsp.cast("int").alias("sibsp"),
        parch.cast("int").alias("parch"),
        fare.cast("double").alias("fare"),
        embarked.cast("string").alias("embarked"),
    )
