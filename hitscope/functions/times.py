"""Timestamps: parsing of log time texts, bucketing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ISO date and time with zone, or a plain date and time taken as UTC.  The guard
# keeps Spark's lenient cast from accepting shorter forms.
_ISO = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
        r"(T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})"
        r"|[ ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?)$")
_APACHE = r"^[0-9]{2}/[A-Za-z]{3}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$"
_FLOAT_PREFIX = r"^\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"


def float_prefix(text: Column) -> Column:
    """Leading number of a text, as a double; NULL if it has none."""
    return F.regexp_extract(text, _FLOAT_PREFIX, 1).try_cast("double")


def int_prefix(text: Column) -> Column:
    """Leading integer of a text, as BIGINT; NULL if it has none.

    A whole text in exponent notation is a JSON number literal and is truncated.
    """
    exponent = text.rlike(r"^-?[0-9]+([.][0-9]+)?[eE][+-]?[0-9]+$")
    return F.when(exponent, text.try_cast("double").try_cast("bigint")).otherwise(
        F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"))


def parse_time(text: Column) -> Column:
    """ISO, space-separated, Apache/nginx or Unix-seconds text as TIMESTAMP (UTC).

    Unix seconds lose their fraction.  Unreadable text gives NULL.
    """
    iso = F.when(text.rlike(_ISO), text.try_cast("timestamp"))
    apache = F.when(text.rlike(_APACHE), F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    unix = F.timestamp_seconds(float_prefix(text).try_cast("bigint"))
    return F.coalesce(iso, apache, unix)


def bucket(ts: Column, granularity: str) -> Column:
    """Start of the tumbling bucket of ``ts``.

    Buckets are aligned to Mondays, which for minutes, hours and days is the
    same as midnight UTC.
    """
    offset = "4 days" if "week" in granularity or "day" in granularity and not granularity.startswith("1 ") else None
    window = F.window(ts, granularity, granularity, offset) if offset else F.window(ts, granularity)
    return window.getField("start")
