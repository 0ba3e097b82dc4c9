"""Streaming jobs over the tables, run until all their input is processed.

Each plan writes its table as several files, streams them in, and returns what the
sink holds. The SQL is the batch twin, for windows the last watermark has closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from ..sources.tables import Tables
from ..streaming import jobs
from .common import trained
from .filters import log_lines
from .registry import OFF_TIE, PASSENGERS, REQUESTS, query
from .scalars import _RAW, _raw

def _as_stream(t: Tables, df: DataFrame, name: str, order: str) -> DataFrame:
    """The rows of ``df`` as a file stream of range-partitioned files, as many as their
    size asks for. All are one batch: files of one writer have no order in time, and a
    watermark between them would drop rows as late."""
    path = scratch_path(t.spark, f"{name}-in")
    df.repartitionByRange(order).write.parquet(path)
    return t.spark.readStream.schema(df.schema).parquet(path)


def _run(t: Tables, name: str, start) -> DataFrame:
    """Start a job, wait until its input is used up, and read its sink."""
    out, state = scratch_path(t.spark, f"{name}-out"), scratch_path(t.spark, f"{name}-state")
    start(out, state).awaitTermination()
    return t.spark.read.parquet(out)


@query(
    "stream_validate",
    _RAW
    + """select passenger_id, case when age is null or age > 120 or fare is null or fare < 0
         or sex not in ('male', 'female') or embarked is null then 'quarantine' else 'good' end
         as verdict from raw""",
)
def stream_validate_plan(t: Tables) -> DataFrame:
    stream = _as_stream(t, _raw(t), "validate", "passenger_id")
    done = _run(t, "validate", lambda out, state: jobs.stream_validate(stream, out, state))
    return done.select("passenger_id", F.col("verdict").cast("string").alias("verdict"))


@query("stream_score", PASSENGERS + "select passenger_id, true as same_score from passengers")
def stream_score_plan(t: Tables) -> DataFrame:
    """Scores of the stream against those of the batch."""
    run = trained(t)
    stream = _as_stream(t, t.passengers, "score", "passenger_id")
    done = _run(
        t,
        "score",
        lambda out, state: jobs.stream_score(stream, run, out, state),
    )
    batch = run.score(t.passengers).select(
        "passenger_id", F.col("score.ensemble_result").alias("expected")
    )
    return done.join(batch, "passenger_id").select(
        "passenger_id", (F.col("score.ensemble_result") == F.col("expected")).alias("same_score")
    )


def _with_open(t: Tables, done: DataFrame, batch, window: str) -> DataFrame:
    """The closed windows from the sink, and those that the last watermark leaves open from
    the batch twin over their rows."""
    rows = _timed(t)
    watermark = rows.agg(F.max("ts") - F.expr("interval 1 hour")).scalar()
    open_rows = rows.where(F.window("ts", window)["end"] > watermark)
    still = batch(open_rows).withColumn("closed", F.lit(False))
    return done.withColumn("closed", F.lit(True)).unionByName(still)


def _timed(t: Tables) -> DataFrame:
    return t.requests.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_rate_counts",
    REQUESTS
    + """, w as (select user_id, date_trunc('day', ts) as start, count(*) as n
         from requests group by 1, 2)
       select user_id, strftime(start, '%Y-%m-%d') as day, n, least(n, 3) as accepted,
         greatest(n - 3, 0) as refused,
         start + interval 1 day <= (select max(ts) from requests) - interval 1 hour as closed
       from w""",
)
def stream_rate_counts_plan(t: Tables) -> DataFrame:
    stream = _as_stream(t, _timed(t), "rate", "ts")
    done = _run(
        t,
        "rate",
        lambda out, state: jobs.stream_rate_counts(
            stream, out, state, "user_id", 3, "1 day", "1 hour"
        ),
    )
    shown = _with_open(t, done, lambda rows: jobs.rate_counts(rows, "user_id", 3, "1 day", "1 hour"), "1 day")
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return shown.select("user_id", day, "n", "accepted", "refused", "closed")


@query(
    "stream_rate_decide",
    REQUESTS
    + """select request_id, user_id, row_number() over (partition by user_id, date_trunc('day', ts)
         order by ts, request_id) as nth,
         row_number() over (partition by user_id, date_trunc('day', ts)
           order by ts, request_id) <= 3 as allowed from requests""",
)
def stream_rate_decide_plan(t: Tables) -> DataFrame:
    """Requests arrive in three batches, one after the other; each is decided on arrival."""
    rows = _timed(t).select("request_id", "user_id", "ts")
    first, last = rows.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    folder, out, state = (scratch_path(t.spark, f"decide-{x}") for x in ("in", "out", "state"))
    part = F.floor((F.unix_micros("ts") - first) * 3 / (last - first + 1))
    for k in range(3):
        rows.where(part == k).write.mode("append").parquet(folder)
        stream = t.spark.readStream.schema(rows.schema).parquet(folder)
        jobs.stream_rate_decide(stream, out, state, "user_id", 3, "day", "1 hour").awaitTermination()
    return t.spark.read.parquet(out).select("request_id", "user_id", "nth", "allowed")


@query(
    "stream_request_metrics",
    REQUESTS
    + f""", w as (select endpoint, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as start,
         count(*) as n, round(avg(duration_ms) + {OFF_TIE}, 6) as mean_ms, max(duration_ms) as max_ms,
         round(avg(case when status_code >= 400 then 1 else 0 end), 6) as error_rate
         from requests group by 1, 2)
       select endpoint, strftime(start, '%Y-%m-%d %H:%M') as window_start, n, mean_ms, max_ms,
         error_rate,
         start + interval 6 hours <= (select max(ts) from requests) - interval 1 hour as closed
       from w""",
)
def stream_request_metrics_plan(t: Tables) -> DataFrame:
    stream = _as_stream(t, _timed(t), "metrics", "ts")
    done = _run(
        t,
        "metrics",
        lambda out, state: jobs.stream_request_metrics(stream, out, state, "6 hours", "1 hour"),
    )
    shown = _with_open(t, done, lambda rows: jobs.metrics_per_window(rows, "6 hours", "1 hour"), "6 hours")
    return shown.select(
        "endpoint",
        "closed",
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "n",
        F.round(F.col("mean_ms") + OFF_TIE, 6).alias("mean_ms"),
        "max_ms",
        F.round("error_rate", 6).alias("error_rate"),
    )


@query(
    "stream_log_filter",
    """select strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp, 'ERROR' as severity,
       props as text_payload from events where event_type = 'error' and user_id % 4 = 2""",
)
def stream_log_filter_plan(t: Tables) -> DataFrame:
    stream = _as_stream(t, log_lines(t["events"]), "tail", "timestamp")
    return _run(
        t,
        "tail",
        lambda out, state: jobs.stream_log_filter(stream, out, state, "error", "zone-2"),
    )
