"""Day and history selection on a normalized table.

With a ``log_date`` partition column the predicates prune partitions; without
it they are ranges on ``ts``, which Parquet row groups can skip on.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F


def _days(df: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    if "log_date" in df.columns:
        return df.where(F.col("log_date").between(F.lit(first), F.lit(last)))
    kind = df.schema["ts"].dataType
    start = F.lit(first.isoformat()).cast(kind)
    end = F.lit((last + dt.timedelta(days=1)).isoformat()).cast(kind)
    return df.where((F.col("ts") >= start) & (F.col("ts") < end))


def select_day(df: DataFrame, as_of: dt.date, days_ago: int = 0) -> DataFrame:
    """Records of the day ``days_ago`` before ``as_of`` (0 today, 1 yesterday)."""
    day = as_of - dt.timedelta(days=days_ago)
    return _days(df, day, day)


def select_history(df: DataFrame, as_of: dt.date, days: int = 7) -> DataFrame:
    """Records of the ``days`` days before ``as_of``, with ``day_offset`` 1..days."""
    history = _days(df, as_of - dt.timedelta(days=days), as_of - dt.timedelta(days=1))
    return history.withColumn("day_offset", F.datediff(F.lit(as_of), F.to_date("ts")))
