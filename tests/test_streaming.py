from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from rowforge.streaming import jobs

START = datetime.datetime(2024, 1, 1)
REQUEST = "request_id long, ts timestamp, user_id long, endpoint string, duration_ms double, status_code int"


def request(i, minutes, user=1, endpoint="a", ms=10.0, status=200):
    return (i, START + datetime.timedelta(minutes=minutes), user, endpoint, ms, status)


class Source:
    """A folder that gets one file per call, and the stream over it."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema
        spark.createDataFrame([], schema).write.mode("append").parquet(self.path)

    def add(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


@pytest.fixture()
def source(spark, tmp_path):
    return lambda schema: Source(spark, tmp_path / "in", schema)


def test_late_rows_are_dropped_and_windows_close_once(spark, source, tmp_path):
    data = source(REQUEST)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        jobs.stream_rate_counts(
            data.stream(), out, state, "user_id", 2, "10 minutes", "5 minutes"
        ).awaitTermination()
        rows = spark.read.parquet(out).collect()
        return sorted((r["user_id"], r["window_start"].minute, r["n"], r["accepted"], r["refused"]) for r in rows)

    data.add(*[request(i, 1) for i in range(3)], request(9, 2, user=2))
    assert run() == []
    data.add(request(10, 8), request(11, 17))  # in time: the first window is still open
    assert run() == [(1, 0, 4, 2, 2), (2, 0, 1, 1, 0)]
    data.add(request(12, 3), request(13, 40))  # behind the watermark: dropped
    assert run() == [(1, 0, 4, 2, 2), (1, 10, 1, 1, 0), (2, 0, 1, 1, 0)]
    assert run() == [(1, 0, 4, 2, 2), (1, 10, 1, 1, 0), (2, 0, 1, 1, 0)]


def test_decisions_of_several_batches_are_those_of_one(spark, source, tmp_path):
    from rowforge.operators.requests import rate_limit_decide

    data = source(REQUEST)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        jobs.stream_rate_decide(data.stream(), out, state, "user_id", 2, "hour", "30 minutes").awaitTermination()
        rows = spark.read.parquet(out).collect()
        return sorted((r["request_id"], r["nth"], r["allowed"]) for r in rows)

    batches = [
        [request(1, 1), request(2, 5), request(3, 3), request(4, 2, user=2)],
        [request(5, 50), request(6, 55, user=2), request(7, 55, user=2), request(8, 61)],
        [request(9, 62), request(10, 62), request(11, 70, user=3)],
    ]
    for batch in batches:
        data.add(*batch)
        decided = run()
    everything = spark.createDataFrame([r for b in batches for r in b], REQUEST)
    whole = rate_limit_decide(everything, "user_id", 2, "hour").collect()
    assert decided == sorted((r["request_id"], r["nth"], r["allowed"]) for r in whole)
    assert run() == decided
    # the watermark passes the first hours, and their counts go: a request that late is not seen
    data.add(request(12, 300))
    run()
    data.add(request(13, 58), request(14, 301))
    assert run()[len(decided):] == [(12, 1, True), (14, 2, True)]


def test_decisions_of_many_keys_take_few_states(spark, source, tmp_path):
    """A call per key and window costs more than the batch of a day; one per bucket does not."""
    from rowforge.operators.requests import rate_limit_decide

    data = source(REQUEST)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    big = 2**53  # keys next to each other that a double cannot tell apart
    users = [None, *range(700), *range(big, big + 300)]
    batches = [
        [request(10_000 * b + 3 * i + j, 20 * b + (7 * i + 11 * j) % 20, user=u) for i, u in enumerate(users) for j in range(3 - i % 2)]
        for b in range(2)
    ]
    for batch in batches:
        data.add(*batch)
        run = jobs.stream_rate_decide(data.stream(), out, state, "user_id", 4, "day", "30 minutes")
        run.awaitTermination()
        assert 0 < run.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 3 * (jobs.RATE_BUCKETS + 1)
    whole = rate_limit_decide(spark.createDataFrame(batches[0] + batches[1], REQUEST), "user_id", 4, "day")
    decided = lambda df: sorted((r["request_id"], r["nth"], r["allowed"]) for r in df.collect())
    assert decided(spark.read.parquet(out)) == decided(whole)


def test_metrics_per_window(spark, source, tmp_path):
    data = source(REQUEST)
    data.add(
        request(1, 1, ms=10.0),
        request(2, 2, ms=30.0, status=500),
        request(3, 3, endpoint="b"),
        request(4, 90),
    )
    out = str(tmp_path / "out")
    jobs.stream_request_metrics(
        data.stream(), out, str(tmp_path / "state"), "1 hour", "10 minutes"
    ).awaitTermination()
    rows = {r["endpoint"]: tuple(r)[2:] for r in spark.read.parquet(out).collect()}
    assert rows == {"a": (2, 20.0, 30.0, 0.5), "b": (1, 10.0, 10.0, 0.0)}


def test_verdicts_go_to_their_folders(spark, source, tmp_path):
    data = source("pclass int, sex string, age double, sibsp int, parch int, fare double, embarked string")
    data.add((1, "male", 30.0, 0, 0, 5.0, "S"), (1, "man", 30.0, 0, 0, 5.0, "S"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    jobs.stream_validate(data.stream(), out, state).awaitTermination()
    data.add((2, "female", -1.0, 0, 0, 5.0, "C"))
    jobs.stream_validate(data.stream(), out, state).awaitTermination()
    good = spark.read.parquet(f"{out}/verdict=good").collect()
    bad = spark.read.parquet(out).where(F.col("verdict") == jobs.QUARANTINE)
    assert [list(r["anomalies"]) for r in good] == [["first_class_low_fare"]]
    assert sorted(r["first_issue"] for r in bad.collect()) == ["age:out_of_range", "sex:invalid_value"]


def test_log_tail_is_redacted_first(spark, source, tmp_path):
    data = source(
        "timestamp string, severity string, text_payload string, service_name string, location string, token string"
    )
    data.add(
        ("t1", "warn", "x", "svc", "r1", "s3cret"),
        ("t2", "info", "y", "svc", "r2", "s"),
        ("t3", "exception", "z", "other", "r1", "s"),
    )
    out = str(tmp_path / "out")
    jobs.stream_log_filter(data.stream(), out, str(tmp_path / "state"), "svc", "r1").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("t1", "WARNING", "x")]
