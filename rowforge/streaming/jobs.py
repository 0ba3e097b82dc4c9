"""Streaming twins of the batch operators, with exactly-once file sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.formats import RATE_UNITS, normalize_level
from ..functions.redaction import redact_keys
from ..operators.requests import log_tail_filter, request_measures
from ..operators.training import TrainingRun
from ..operators.validate import validate_rows

GOOD, QUARANTINE = "good", "quarantine"


def write_files(
    df: DataFrame, path: str, checkpoint: str, partition_by: list[str] = (), **trigger
) -> StreamingQuery:
    """Append to a parquet folder; the sink's log makes every batch count once."""
    writer = df.writeStream.format("parquet").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (
        writer.option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def validated(stream: DataFrame) -> DataFrame:
    """Validated rows with the verdict that chooses their folder."""
    checked = validate_rows(stream)
    return checked.withColumn("verdict", F.when(F.col("is_valid"), GOOD).otherwise(QUARANTINE))


def stream_validate(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Good and quarantined rows to two folders of one sink, validated once."""
    return write_files(validated(stream), path, checkpoint, ["verdict"], **trigger)


def stream_score(
    stream: DataFrame, run: TrainingRun, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Prepare and score arriving rows; no state, no shuffle."""
    return write_files(run.score(stream), path, checkpoint, **trigger)


def windowed(
    stream: DataFrame, keys: list[str], ts: str, window: str, lateness: str
) -> DataFrame:
    """Group by key and clock window; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, window).alias("window"))


def rate_counts(
    stream: DataFrame, key: str, limit: int, window: str, lateness: str, ts: str = "ts"
) -> DataFrame:
    """Requests, accepted and refused ones per key and closed window."""
    counted = windowed(stream, [key], ts, window, lateness).agg(F.count("*").alias("n"))
    return counted.select(
        key,
        F.col("window.start").alias("window_start"),
        "n",
        F.least(F.col("n"), F.lit(limit)).alias("accepted"),
        F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"),
    )


def stream_rate_counts(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    limit: int,
    window: str,
    lateness: str,
    **trigger,
) -> StreamingQuery:
    return write_files(
        rate_counts(stream, key, limit, window, lateness), path, checkpoint, **trigger
    )


class RateDecisions(StatefulProcessor):
    """Numbers the requests of the keys of one bucket and clock window as they arrive.

    The state is the number of requests of every key so far. A timer drops it when the
    watermark has passed the end of the window: whatever comes after that is late and never
    seen here.
    """

    def __init__(self, limit: int, seconds: int, key: str, ts: str, id_col: str, names: list[str]):
        self.limit, self.seconds, self.key, self.ts, self.id_col, self.names = limit, seconds, key, ts, id_col, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "keys array<string>, n array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a batch of the stream is one instant: its requests count in the order of their times
        arrived = pd.concat(list(rows)).sort_values([self.ts, self.id_col], kind="stable")
        keys, before = self.seen.get() if self.seen.exists() else ([], [])
        if not len(keys):
            end = arrived["window_start"].iloc[0] + pd.Timedelta(seconds=self.seconds)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        # places of the keys: first those of the state, then new ones
        codes, found = pd.factorize(arrived[self.key].fillna("").to_numpy(object))
        place = pd.Index(list(keys), dtype=object).get_indexer(found)
        fresh = place < 0
        place[fresh] = len(keys) + np.arange(fresh.sum())
        n = np.concatenate([np.array(before, "int64"), np.zeros(fresh.sum(), "int64")])
        place = place[codes]
        arrived["nth"] = n[place] + arrived.groupby(place).cumcount().to_numpy() + 1
        arrived["allowed"] = arrived["nth"] <= self.limit
        n += np.bincount(place, minlength=len(n))
        self.seen.update(([*keys, *found[fresh].tolist()], n.tolist()))
        yield arrived[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter([])

    def close(self) -> None:
        pass


#: Buckets that the keys of a window are dealt to.
RATE_BUCKETS = 64


def rate_decisions(
    stream: DataFrame,
    key: str,
    limit: int,
    unit: str,
    lateness: str,
    ts: str = "ts",
    id_col: str = "request_id",
    buckets: int = RATE_BUCKETS,
) -> DataFrame:
    """One decision per request, in the batch of the stream in which it arrives: its number
    within its key and clock window, and whether it is allowed.

    A call costs far more than a row, so one call decides for a bucket of the keys of a
    window; null is a key of its own. A task holds the requests of one bucket and window that
    arrive in one batch, so only their id and time are carried; bound a batch with the options
    of the source, or take more buckets. A checkpoint keeps the buckets it began with.
    """
    narrow = stream.select(id_col, key, ts).withWatermark(ts, lateness)
    key_type = narrow.schema[key].dataType
    # as text, since pandas has integers next to null as doubles
    narrow = narrow.withColumns({key: F.col(key).cast("string"), "window_start": F.date_trunc(unit, F.col(ts))})
    decided = T.StructType([*narrow.schema.fields, T.StructField("nth", T.LongType()), T.StructField("allowed", T.BooleanType())])
    bucket = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    numbered = narrow.withColumn("__bucket", bucket).groupBy("window_start", "__bucket").transformWithStateInPandas(
        RateDecisions(limit, RATE_UNITS[unit], key, ts, id_col, decided.names), decided, "Append", "EventTime"
    )
    return numbered.withColumn(key, F.col(key).cast(key_type))


def stream_rate_decide(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    limit: int,
    unit: str,
    lateness: str,
    **trigger,
) -> StreamingQuery:
    return write_files(rate_decisions(stream, key, limit, unit, lateness), path, checkpoint, **trigger)


def metrics_per_window(
    stream: DataFrame, window: str, lateness: str, ts: str = "ts"
) -> DataFrame:
    """Latency and error rate per endpoint and closed window."""
    measured = windowed(stream, ["endpoint"], ts, window, lateness).agg(*request_measures())
    start = F.col("window.start").alias("window_start")
    return measured.select("endpoint", start, "n", "mean_ms", "max_ms", "error_rate")


def stream_request_metrics(
    stream: DataFrame, path: str, checkpoint: str, window: str, lateness: str, **trigger
) -> StreamingQuery:
    return write_files(metrics_per_window(stream, window, lateness), path, checkpoint, **trigger)


def stream_log_filter(
    stream: DataFrame, path: str, checkpoint: str, service: str, region: str, **trigger
) -> StreamingQuery:
    """Redact, normalise the level, keep one service and region."""
    clean = redact_keys(stream).withColumn("severity", normalize_level(F.col("severity")))
    return write_files(log_tail_filter(clean, service, region), path, checkpoint, **trigger)
