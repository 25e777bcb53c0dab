"""Requests and threats per country."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import top
from .security import threat_events
from .traffic import country_stats


def country_threats(events: DataFrame) -> DataFrame:
    """Threat events per country."""
    return events.where(F.col("country") != "").groupBy("country").agg(F.count("*").alias("threat_count"))


def geo_stats(df: DataFrame, events: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """``country_stats`` with threats and (errors + 10 x threats) / requests x 100.

    ``events`` are the threat events to count, by default those of ``df``.
    """
    threats = country_threats(threat_events(df, seq) if events is None else events)
    joined = country_stats(df).join(threats, "country", "left").withColumn(
        "threat_count", F.coalesce("threat_count", F.lit(0)))
    return joined.withColumn(
        "threat_score", (F.col("error_count") + F.col("threat_count") * 10) / F.col("count") * 100)


def geo_summary(df: DataFrame, n: int | None = 20, events: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    return top(geo_stats(df, events, seq), n, "count", "country").drop("threat_count")


def threat_map(df: DataFrame, events: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    return geo_stats(df, events, seq).select(
        "country", "threat_score", "threat_count", F.col("count").alias("request_count"))
