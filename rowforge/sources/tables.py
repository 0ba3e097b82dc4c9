"""The parquet tables of a data folder and the two views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PASSENGER_FIELDS = ["pclass", "sex", "age", "sibsp", "parch", "fare", "embarked"]


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than cores, over all cores.

    For work that costs far more than moving rows. Spark cuts any input of more than a
    few megabytes per core into at least as many splits as cores, so a large input is
    never moved. Only for scans: the number of partitions of anything else is known only
    after its shuffles have run.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Lazy access to ``<root>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, root: str, spread_rows: bool = False):
        self.spark = spark
        self.root = root.rstrip("/")
        self.spread_rows = spread_rows

    def __getitem__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return spread(df) if self.spread_rows else df

    @property
    def spread(self) -> "Tables":
        """The same tables, small ones spread over all cores."""
        return Tables(self.spark, self.root, spread_rows=True)

    @property
    def passengers(self) -> DataFrame:
        return passengers_from_orders(self["orders"])

    @property
    def requests(self) -> DataFrame:
        return requests_from_events(self["events"])


def passengers_from_orders(orders: DataFrame) -> DataFrame:
    """A labelled passenger table with the missing values a raw one has."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    even = cust % 2 == 0
    points = F.when(even, 3).otherwise(0) + (2 - key % 3) + key % 4
    port = (
        F.when(key % 50 == 1, F.lit(None).cast("string"))
        .when(F.col("o_orderstatus") == "F", "C")
        .when(F.col("o_orderstatus") == "O", "S")
        .otherwise("Q")
    )
    return orders.select(
        key.alias("passenger_id"),
        (1 + key % 3).cast("int").alias("pclass"),
        F.when(even, "female").otherwise("male").alias("sex"),
        F.when(key % 5 != 0, (1 + (key * 7) % 79).cast("double")).alias("age"),
        (cust % 4).cast("int").alias("sibsp"),
        ((key % 9 - key % 3) / 3).cast("int").alias("parch"),
        F.when(key % 97 != 0, F.col("o_totalprice") / 1000).alias("fare"),
        port.alias("embarked"),
        F.when(points >= 4, 1).otherwise(0).alias("survived"),
    )


def requests_from_events(events: DataFrame) -> DataFrame:
    """The event table read as a request log."""
    return events.select(
        F.col("event_id").alias("request_id"),
        "ts",
        "user_id",
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
    )
