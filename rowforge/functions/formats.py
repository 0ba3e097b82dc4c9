"""Rates, durations, timestamps, log levels, keys and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Units in seconds, log level names, display names, byte units.
DURATION_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
RATE_UNITS = {
    "second": 1,
    "minute": 60,
    "hour": 3600,
    "day": 86400,
}
LOG_LEVELS = {
    "debug": "DEBUG",
    "info": "INFO",
    "warning": "WARNING",
    "warn": "WARNING",
    "error": "ERROR",
    "critical": "CRITICAL",
    "exception": "ERROR",
}
CLASS_NAMES = {1: "First", 2: "Second", 3: "Third"}
PORT_NAMES = {"C": "Cherbourg", "Q": "Queenstown", "S": "Southampton"}
BYTE_UNITS = {"mb": 1024.0**2, "gb": 1024.0**3}

_RATE = r"^\s*(\d+)\s*(?:/|per)\s*(second|minute|hour|day)s?\s*$"
_DURATION = r"^(\d+)([smhd])$"


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table, null for an unknown key."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_rate(text: Column) -> Column:
    """``50/minute`` to a struct of count, unit and seconds; null when malformed."""
    unit = F.lower(F.regexp_extract(text, "(?i)" + _RATE, 2))
    return F.when(
        text.rlike("(?i)" + _RATE),
        F.struct(
            F.regexp_extract(text, "(?i)" + _RATE, 1).try_cast("int").alias("count"),
            unit.alias("unit"),
            lookup(unit, RATE_UNITS).alias("seconds"),
        ),
    )


def parse_duration(text: Column, strict: bool = False) -> Column:
    """``30m`` to seconds. A malformed text gives null, or an error when ``strict``."""
    seconds = F.regexp_extract(text, _DURATION, 1).try_cast("bigint") * lookup(
        F.regexp_extract(text, _DURATION, 2), DURATION_UNITS
    )
    fallback = (
        F.raise_error(F.concat(F.lit("invalid duration: "), text))
        if strict
        else F.lit(None)
    )
    return F.when(text.rlike(_DURATION), seconds).otherwise(fallback.cast("bigint"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with microseconds and Z; the session zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def normalize_level(name: Column) -> Column:
    return F.coalesce(lookup(F.lower(name), LOG_LEVELS), F.upper(name))


def add_context(df: DataFrame, service: str, version: str, environment: str) -> DataFrame:
    return df.withColumns(
        {
            "service": F.lit(service),
            "version": F.lit(version),
            "environment": F.lit(environment),
        }
    )


def limit_key(user_id: Column, address: Column) -> Column:
    """``user:<id>`` when there is a user, else ``ip:<address>``."""
    user = user_id.cast("string")
    return F.when(
        user.isNotNull() & (user != ""), F.concat(F.lit("user:"), user)
    ).otherwise(F.concat(F.lit("ip:"), address))


def key_kind(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def key_value(key: Column) -> Column:
    return F.regexp_extract(key, r"^[^:]*:(.*)$", 1)


def short_request_id() -> Column:
    return F.substring(F.uuid(), 1, 8)


def fixed(value: Column, places: int) -> Column:
    """Text with a fixed number of places.

    ``format_number`` rounds the binary value itself, half to even; ``format_string``
    and ``bround`` round its shortest decimal spelling, which differs at ties. Only half
    a unit of the last place comes out wrong there, so it is spelled out.
    """
    half = float(f"5e-{places + 1}")
    text = F.replace(F.format_number(value, places), F.lit(","), F.lit(""))
    return (
        F.when(value == half, f"{half:.{places}f}")
        .when(value == -half, f"{-half:.{places}f}")
        .otherwise(text)
    )


def round_to(value: Column, places: int) -> Column:
    """The number nearest to ``value`` with so many places."""
    return fixed(value, places).try_cast("double")


def bytes_in(size: Column, unit: str) -> Column:
    """Bytes as MB or GB, two places."""
    return round_to(size / F.lit(BYTE_UNITS[unit]), 2)


def money(value: Column) -> Column:
    return F.concat(F.lit("$"), fixed(value, 2))
