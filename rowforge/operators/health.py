"""Check results, resource levels, required parts and error records."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Severities, startup checks, resource limits, error codes and messages.
STATUSES = ["healthy", "degraded", "unhealthy"]
STARTUP_CHECKS = ["ml_models", "preprocessor", "configuration", "model_files"]
RESOURCE_LIMITS = {
    "cpu": (80.0, 95.0),
    "memory": (85.0, 95.0),
    "disk": (90.0, 98.0),
}
ERROR_STATUS = {
    "ML_SERVICE_ERROR": 500,
    "VALIDATION_ERROR": 400,
    "MODEL_NOT_LOADED": 503,
    "PREDICTION_ERROR": 500,
    "PREDICTION_INPUT_ERROR": 400,
    "MODEL_UNAVAILABLE": 503,
    "AUTHENTICATION_ERROR": 401,
    "AUTHORIZATION_ERROR": 403,
    "CONFIGURATION_ERROR": 500,
    "EXTERNAL_SERVICE_ERROR": 502,
    "BUSINESS_LOGIC_ERROR": 422,
}
DEFAULT_ERROR_STATUS = 500
UNHEALTHY_MESSAGE = "Service unhealthy: %d critical issues"
DEGRADED_MESSAGE = "Service degraded: %d warnings"
HEALTHY_MESSAGE = "All systems operational"
STARTUP_MESSAGE = "Startup validation failed: Startup checks failed: "


class StartupError(RuntimeError):
    """A startup check is unhealthy."""


def missing_required(
    spark: SparkSession, present: DataFrame, required: list[str], name: str = "name"
) -> DataFrame:
    """Required names that do not occur in the table."""
    wanted = spark.createDataFrame([(n,) for n in required], f"{name} string")
    # the short list is the outer side; the table is cut to it before the join
    found = present.select(name).where(F.col(name).isin(required)).distinct()
    return wanted.join(found, name, "left_anti")


def diff_names(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required rows that are not among the present ones; all columns count, and the
    present rows are made distinct before they are shuffled for the join."""
    there = present.distinct().alias("there")
    same = [
        F.col(f"wanted.{name}").eqNullSafe(F.col(f"there.{name}")) for name in required.columns
    ]
    return required.alias("wanted").join(there, reduce(and_, same), "left_anti")


def check_prep_state(spark: SparkSession, stats: DataFrame, required: list[str]) -> DataFrame:
    """Degraded when a required statistic is missing from the table."""
    missing = missing_required(spark, stats, required)
    names = F.array_join(F.array_sort(F.collect_list("name")), ",")
    return missing.agg(
        F.when(F.count("*") > 0, "degraded").otherwise("healthy").alias("status"),
        F.count("*").alias("n_missing"),
        names.alias("missing"),
    )


def severity(status: Column) -> Column:
    """0, 1 or 2; an unknown status counts as the worst."""
    return F.when(status == "healthy", 0).when(status == "degraded", 1).otherwise(2)


def status_rollup(checks: DataFrame, *by: str) -> DataFrame:
    """Counts per status, the worst status and its message."""
    level = severity(F.col("status"))
    counted = checks.groupBy(*by).agg(
        F.count("*").alias("total_checks"),
        F.count_if(level == 0).alias("healthy"),
        F.count_if(level == 1).alias("degraded"),
        F.count_if(level == 2).alias("unhealthy"),
    )
    unhealthy, degraded = F.col("unhealthy"), F.col("degraded")
    return counted.withColumns(
        {
            "status": F.when(unhealthy > 0, "unhealthy")
            .when(degraded > 0, "degraded")
            .otherwise("healthy"),
            "message": F.when(
                unhealthy > 0,
                F.format_string(UNHEALTHY_MESSAGE, unhealthy),
            )
            .when(degraded > 0, F.format_string(DEGRADED_MESSAGE, degraded))
            .otherwise(HEALTHY_MESSAGE),
        }
    )


def failed_startup_checks(checks: DataFrame) -> DataFrame:
    """One row per startup check that is unhealthy, with its latest message."""
    return (
        checks.where(F.col("name").isin(STARTUP_CHECKS) & (severity(F.col("status")) == 2))
        .groupBy("name")
        .agg(F.max_by("message", "timestamp").alias("message"))
    )


def startup_gate(checks: DataFrame) -> DataFrame:
    """The failed startup checks when there are none; raises otherwise."""
    failed = failed_startup_checks(checks)
    rows = failed.collect()  # at most one row per startup check
    if rows:
        listed = "; ".join(
            f"{r['name']}: {r['message']}"
            for r in sorted(rows, key=lambda r: STARTUP_CHECKS.index(r["name"]))
        )
        raise StartupError(STARTUP_MESSAGE + listed)
    return failed


def resource_level(metric: Column, usage: Column) -> Column:
    """0 normal, 1 high, 2 critical; strictly above the limit of the metric."""
    level = None
    for name, (warning, critical) in RESOURCE_LIMITS.items():
        graded = F.when(usage > critical, 2).when(usage > warning, 1).otherwise(0)
        level = F.when(metric == name, graded) if level is None else level.when(metric == name, graded)
    return level.otherwise(0)


def resource_severity(df: DataFrame, cpu: str, memory: str, disk: str) -> DataFrame:
    """Level per metric and the worst of them as a status."""
    levels = {
        name: resource_level(F.lit(name), F.col(column))
        for name, column in (("cpu", cpu), ("memory", memory), ("disk", disk))
    }
    worst = F.greatest(*levels.values())
    return df.withColumns(
        {
            **{f"{name}_level": level for name, level in levels.items()},
            "status": F.element_at(F.array(*[F.lit(s) for s in STATUSES]), worst + 1),
        }
    )


def error_status(code: Column) -> Column:
    """Response status of an error code; an unknown code is a server error."""
    pairs = [F.lit(x) for pair in ERROR_STATUS.items() for x in pair]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), code), F.lit(DEFAULT_ERROR_STATUS)
    )


def flatten_error_path(location: Column) -> Column:
    return F.array_join(location, ".")


def field_errors(errors: Column, fallback: str = "Invalid value") -> Column:
    """Map of dotted path to messages, from the error list (loc, msg) of one row."""
    flat = F.transform(
        errors,
        lambda e: F.struct(
            flatten_error_path(e["loc"]).alias("path"),
            F.coalesce(e["msg"], F.lit(fallback)).alias("msg"),
        ),
    )
    paths = F.array_distinct(F.transform(flat, lambda e: e["path"]))
    return F.map_from_arrays(
        paths,
        F.transform(
            paths,
            lambda path: F.transform(
                F.filter(flat, lambda e: e["path"] == path), lambda e: e["msg"]
            ),
        ),
    )
