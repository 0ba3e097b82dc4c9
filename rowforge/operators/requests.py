"""Request logs: thresholds, tails, metrics and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.formats import RATE_UNITS, round_to
from .ranking import HOT_GROUP_ROWS, group_row_number

# Log thresholds in milliseconds and the wait after a refusal.
SLOW_REQUEST_MS, SLOW_PREDICTION_MS, LAZY_LOAD_MS = 100, 200, 1000
RETRY_AFTER_SECONDS = 60
TAIL_FIELDS = ["timestamp", "severity", "text_payload"]


def slow_requests(df: DataFrame, threshold_ms: float = SLOW_REQUEST_MS) -> DataFrame:
    slow = df.where(F.col("duration_ms") > threshold_ms)
    return slow.withColumn("duration_ms", round_to(F.col("duration_ms"), 2))


def slow_predictions(df: DataFrame, threshold_ms: float = SLOW_PREDICTION_MS) -> DataFrame:
    """Slow predictions, marked when they took long enough to have loaded models."""
    lazy = F.col("duration_ms") > LAZY_LOAD_MS
    return slow_requests(
        df.where(F.col("duration_ms") > threshold_ms).withColumn("models_lazy_loaded", lazy),
        threshold_ms,
    )


def log_tail_filter(df: DataFrame, service: str, region: str) -> DataFrame:
    """Log lines of one service in one region; works on batches and streams."""
    wanted = (F.col("service_name") == service) & (F.col("location") == region)
    return df.where(wanted).select(*TAIL_FIELDS)


def request_measures() -> list[Column]:
    failed = (F.col("status_code") >= 400).cast("int")
    return [
        F.count("*").alias("n"),
        F.avg("duration_ms").alias("mean_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.avg(failed).alias("error_rate"),
    ]


def request_metrics(df: DataFrame, *by: str | Column) -> DataFrame:
    """Count, mean, maximum and error rate per endpoint, or per the given keys."""
    return df.groupBy(*(by or ("endpoint",))).agg(*request_measures())


def user_activity(df: DataFrame, user: str = "user_id") -> DataFrame:
    return df.groupBy(user).agg(F.count("*").alias("n_events"))


def sign_in_outcomes(df: DataFrame, success: str, reason: str) -> DataFrame:
    return df.groupBy(success, reason).agg(F.count("*").alias("n"))


def prediction_results(df: DataFrame, result: str) -> DataFrame:
    return df.groupBy(result).agg(F.count("*").alias("n"))


def rate_limit_decide(
    df: DataFrame,
    key: str,
    limit: int,
    unit: str,
    ts: str = "ts",
    id_col: str = "request_id",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Number every request of a key within its clock window; those over the limit
    are refused. A key that floods a window is numbered across many tasks."""
    windowed = df.withColumn("window_start", F.date_trunc(unit, F.col(ts)))
    numbered = group_row_number(
        windowed, [key, "window_start"], [F.col(ts), F.col(id_col)], "nth", hot_rows
    )
    return numbered.withColumn("allowed", F.col("nth") <= limit)


def rate_limit_headers(
    decided: DataFrame, limit: int, unit: str, ts: str = "ts"
) -> DataFrame:
    """Header values per request; a refused one has none left and must wait."""
    epoch = F.unix_timestamp(F.col(ts).cast("timestamp"))
    window_end = F.unix_timestamp(F.col("window_start").cast("timestamp")) + RATE_UNITS[unit]
    refused = ~F.col("allowed")
    return decided.withColumns(
        {
            "limit": F.lit(limit),
            "policy": F.lit(f"{limit};w={RATE_UNITS[unit]}"),
            "remaining": F.when(refused, F.lit(0)).otherwise(limit - F.col("nth")).cast("long"),
            "retry_after": F.when(refused, F.lit(RETRY_AFTER_SECONDS)),
            "reset": F.when(refused, epoch + RETRY_AFTER_SECONDS).otherwise(window_end),
        }
    )
