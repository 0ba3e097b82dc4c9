"""Fitted feature preparation: fit once, apply to any batch or stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F, types as T

from ..session import durable
from .features import derive_features, drop_columns
from .ranking import global_index
from .statistics import (
    MAX_TASK_VALUES,
    median_sizes,
    medians_of,
    modes,
    value_counts,
)

# Which columns get which statistic, and the names of the statistics.
LABEL = "survived"
MEDIAN_COLUMNS = ["age", "fare"]
MODE_COLUMNS = ["embarked"]
CATEGORICAL_COLUMNS = ["sex", "embarked"]
REQUIRED_STATS = ["age_median", "embarked_mode", "fare_median"]

#: Categories that fit in a literal map of the plan, and those that may be broadcast.
MAX_LITERAL_CATEGORIES = 200
MAX_SMALL_CATEGORIES = 100_000

ENCODINGS = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("code", T.IntegerType()),
    ]
)
STATS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("dvalue", T.DoubleType()),
        T.StructField("svalue", T.StringType()),
    ]
)


class NotFittedError(RuntimeError):
    """Preparation is used before it was fitted or loaded."""


def fit_categories(counts: DataFrame) -> DataFrame:
    """Sorted distinct values of each column to codes 0..k-1.

    The counts are read twice, so they should be a table (see ``session.durable``).
    """
    size = counts.groupBy("column").count().agg(F.max("count")).first()[0] or 0
    distinct = counts.select("column", "category")
    if size <= MAX_TASK_VALUES:
        window = Window.partitionBy("column").orderBy("category")
        code = F.row_number().over(window) - 1
        return distinct.select("column", "category", code.cast("int").alias("code"))
    ranked = global_index(distinct, [F.col("column"), F.col("category")])
    first = ranked.groupBy("column").agg(F.min("index").alias("first"))
    return ranked.join(F.broadcast(first), "column").select(
        "column", "category", (F.col("index") - F.col("first")).cast("int").alias("code")
    )


def encode_lookup(
    df: DataFrame, encodings: DataFrame, column: str, unseen_to_first: bool, small: bool
) -> DataFrame:
    """Replace a category by its code through the fitted table.

    ``small`` says that the table was counted and may be broadcast; a larger one is
    joined by shuffle, where adaptive execution splits a hot category. An unseen
    category becomes code 0 (the first in sorted order) or null.
    """
    codes = encodings.where(F.col("column") == column).select(
        F.col("category").alias("__category"), F.col("code").alias("__code")
    )
    side = F.broadcast(codes) if small else codes
    joined = df.join(side, df[f"`{column}`"].cast("string") == F.col("__category"), "left")
    code = F.coalesce(F.col("__code"), F.lit(0)) if unseen_to_first else F.col("__code")
    return joined.withColumn(column, code).drop("__category", "__code")


@dataclass
class Preparation:
    """Medians, modes, category codes and feature order of a training table."""

    stats: dict[str, float | str | None] = field(default_factory=dict)
    encodings: DataFrame | None = None
    categories: dict[str, list[str]] | None = None
    small: bool = True
    feature_columns: list[str] = field(default_factory=list)
    label: str = LABEL
    key_columns: tuple[str, ...] = ("passenger_id",)

    @property
    def fitted(self) -> bool:
        return self.encodings is not None

    def _require_fit(self) -> None:
        if not self.fitted:
            raise NotFittedError("fit or load the preparation before using it")

    # -- fit ---------------------------------------------------------------

    def fit(self, df: DataFrame) -> "Preparation":
        """One pass for sizes, one for the medians (more only for very many values),
        and one that counts the categories."""
        present = set(df.columns)
        medians = [c for c in MEDIAN_COLUMNS if c in present]
        categorical = [c for c in CATEGORICAL_COLUMNS if c in present]
        summary = [F.count("*").alias("rows"), *median_sizes(medians)]
        if self.label in present:
            summary.append(F.avg(self.label).alias("label_rate"))
        totals = df.agg(*summary).first()
        self.stats = {
            "rows": float(totals["rows"]),
            "columns": float(len(df.columns)),
            "label_rate": totals["label_rate"] if self.label in present else None,
        }
        found = medians_of(df, medians, totals) if medians else {}
        self.stats.update({f"{c}_median": v for c, v in found.items()})
        self._fit_categories(df, categorical)
        skipped = {self.label, *self.key_columns}
        self.feature_columns = [c for c in self._derive(df).columns if c not in skipped]
        return self

    def _fit_categories(self, df: DataFrame, columns: list[str]) -> None:
        wanted = [c for c in MODE_COLUMNS if c in columns]
        if not columns:
            self._keep_small(df.sparkSession, [])
            return
        counts = value_counts(df, columns)
        rows = counts.limit(MAX_LITERAL_CATEGORIES + 1).collect()
        if len(rows) <= MAX_LITERAL_CATEGORIES:
            names: dict[str, list[str]] = {c: [] for c in columns}
            chosen: dict[str, str] = {}
            for row in sorted(rows, key=lambda r: (-r["n"], r["category"])):
                chosen.setdefault(row["column"], row["category"])
                names[row["column"]].append(row["category"])
            codes = [(c, name, i) for c in columns for i, name in enumerate(sorted(names[c]))]
            self._keep_small(df.sparkSession, codes)
        else:
            counts = durable(counts)
            chosen = {r["column"]: r["mode"] for r in modes(counts).collect()}
            self._keep_large(durable(fit_categories(counts)))
        self.stats.update({f"{c}_mode": chosen.get(c) for c in wanted})

    def _keep_small(self, spark: SparkSession, codes: list[tuple[str, str, int]]) -> None:
        """A short code table becomes a literal map in the plan, with no join."""
        self.encodings = spark.createDataFrame(codes, ENCODINGS)
        self.categories = {}
        for column, category, _ in sorted(codes, key=lambda code: (code[0], code[2])):
            self.categories.setdefault(column, []).append(category)

    def _keep_large(self, table: DataFrame) -> None:
        """A longer one is joined, by broadcast as long as its size allows that."""
        self.encodings, self.categories = table, None
        self.small = table.count() <= MAX_SMALL_CATEGORIES

    def _set_encodings(self, table: DataFrame) -> None:
        """Take over a stored code table, short or long."""
        rows = table.limit(MAX_LITERAL_CATEGORIES + 1).collect()
        if len(rows) <= MAX_LITERAL_CATEGORIES:
            codes = [(row["column"], row["category"], row["code"]) for row in rows]
            self._keep_small(table.sparkSession, codes)
        else:
            self._keep_large(table)

    # -- apply -------------------------------------------------------------

    def impute(self, df: DataFrame) -> DataFrame:
        """Fill age, fare and port from the fitted statistics."""
        fills = {c: self.stats.get(f"{c}_median") for c in MEDIAN_COLUMNS}
        fills.update({c: self.stats.get(f"{c}_mode") for c in MODE_COLUMNS})
        columns = {}
        for name, fill in fills.items():
            if name not in df.columns or fill is None:
                continue
            value = F.col(name)
            if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
                value = F.nanvl(value, F.lit(None))
            columns[name] = F.coalesce(value, F.lit(fill))
        return df.withColumns(columns) if columns else df

    def _derive(self, df: DataFrame) -> DataFrame:
        return derive_features(self.impute(drop_columns(df)))

    def _code(self, column: str, unseen_to_first: bool) -> Column:
        names = self.categories.get(column, [])
        if not names:  # as for any other unseen value
            return F.lit(0) if unseen_to_first else F.lit(None).cast("int")
        pairs = [F.lit(x) for i, name in enumerate(names) for x in (name, i)]
        code = F.try_element_at(F.create_map(*pairs), F.col(column).cast("string"))
        return F.coalesce(code, F.lit(0)) if unseen_to_first else code

    def encode(self, df: DataFrame, unseen_to_first: bool = True) -> DataFrame:
        """Categories to codes; an unseen category gets the first code."""
        for column in CATEGORICAL_COLUMNS:
            if column not in df.columns:
                continue
            if self.categories is not None:
                df = df.withColumn(column, self._code(column, unseen_to_first))
            else:
                df = encode_lookup(df, self.encodings, column, unseen_to_first, self.small)
        return df

    def transform(self, df: DataFrame, on_unbinned: str = "null") -> DataFrame:
        """Impute, derive and encode. An age outside all bands has no band;
        ``on_unbinned='error'`` fails on it instead."""
        self._require_fit()
        prepared = self.encode(self._derive(df))
        if on_unbinned == "error" and "age_group" in prepared.columns:
            outside = F.raise_error(F.lit("age outside all bands")).cast("int")
            prepared = prepared.withColumn("age_group", F.coalesce("age_group", outside))
        return prepared

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def features(self, df: DataFrame) -> DataFrame:
        """Only the feature columns, in fitted order."""
        self._require_fit()
        return self.transform(df).select(*self.feature_columns)

    def single(
        self, spark: SparkSession, row: dict, schema: T.StructType | None = None
    ) -> DataFrame:
        """One request row through the same path as a batch."""
        self._require_fit()
        return self.features(spark.createDataFrame([Row(**row)], schema))

    # -- state as tables ----------------------------------------------------

    def stats_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (k, None, v) if isinstance(v, str) else (k, None if v is None else float(v), None)
            for k, v in self.stats.items()
        ]
        return spark.createDataFrame(rows, STATS)

    def save(self, spark: SparkSession, path: str) -> None:
        self._require_fit()
        self.stats_table(spark).write.mode("overwrite").parquet(f"{path}/stats")
        self.encodings.write.mode("overwrite").parquet(f"{path}/encodings")
        columns = spark.createDataFrame(
            list(enumerate(self.feature_columns)), "pos int, name string"
        )
        columns.write.mode("overwrite").parquet(f"{path}/feature_columns")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> "Preparation":
        from ..sources.files import require_paths

        require_paths(spark, [f"{path}/{p}" for p in ("stats", "encodings", "feature_columns")])
        loaded = cls(**options)
        for row in spark.read.parquet(f"{path}/stats").collect():
            loaded.stats[row["name"]] = row["svalue"] if row["dvalue"] is None else row["dvalue"]
        loaded._set_encodings(spark.read.parquet(f"{path}/encodings"))
        columns = spark.read.parquet(f"{path}/feature_columns").orderBy("pos").collect()
        loaded.feature_columns = [row["name"] for row in columns]
        return loaded
