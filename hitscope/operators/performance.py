"""Response times per endpoint and handler, cache use, recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.fixed_values import PERFORMANCE_ADVICE
from ..functions.status import is_error
from ..functions.text import count_where, ratio, top
from ..plans.keys import attach, restrict
from ..plans.percentiles import exact_percentiles
from .traffic import response_time_stats

CACHE_HANDLER = "varnish"
CACHE_HIT_SECONDS = 0.01


def _averages(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg("response_time").alias("avg_response_time"),
        count_where(is_error(F.col("status"))).alias("error_count"),
    ).withColumn("error_rate", ratio(F.col("error_count"), F.col("count")))


def with_p95(df: DataFrame, chosen: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """Adds the 95th percentile to ``chosen`` rows, computed for their keys only."""
    rows = restrict(df.select(*keys, "response_time"), chosen, keys, n)
    return attach(chosen, exact_percentiles(rows, keys, "response_time", {"p95_response_time": 0.95}), keys, n)


def slowest_endpoints(df: DataFrame, n: int | None = 10) -> DataFrame:
    return with_p95(df, top(_averages(df, ["path"]), n, "avg_response_time", "path"), ["path"], n)


def slow_endpoints(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Paths with a mean above ``threshold`` seconds (0 stands for the default of 1)."""
    per_path = df.groupBy("path").agg(F.count("*").alias("count"), F.avg("response_time").alias("avg_response_time"))
    return per_path.where(F.col("avg_response_time") > (threshold or 1.0)).orderBy(F.col("avg_response_time").desc(), "path")


def handler_stats(df: DataFrame) -> DataFrame:
    used = df.where(F.col("handler") != "")
    totals = used.groupBy("handler").agg(
        F.count("*").alias("count"), F.avg("response_time").alias("avg_response_time"),
        F.sum("bytes_sent").alias("bytes"), count_where(is_error(F.col("status"))).alias("error_count"))
    totals = totals.withColumn("error_rate", ratio(F.col("error_count"), F.col("count")))
    return totals.join(exact_percentiles(used, ["handler"], "response_time", {"p95_response_time": 0.95}), "handler", "left")


def _cache_hit():
    return (F.col("status") == 304) | (F.col("response_time") < CACHE_HIT_SECONDS)


def cache_stats(df: DataFrame, handler: str | None = None) -> DataFrame:
    """Hits and misses per handler; only the cache handler has any."""
    used = df.where(F.col("handler") != "") if handler is None else df.where(F.col("handler") == handler)
    cached = F.col("handler") == CACHE_HANDLER
    return used.groupBy("handler").agg(
        count_where(cached & _cache_hit()).alias("hits"), count_where(cached & ~_cache_hit()).alias("misses"),
    ).withColumn("hit_rate", ratio(F.col("hits"), F.col("hits") + F.col("misses")))


def perf_recommendations(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """One row per recommendation that applies: (type, priority, description, impact, action)."""
    def advice(name: str, applies: DataFrame, subject=None) -> DataFrame:
        priority, text, impact, action = (F.lit(t) for t in PERFORMANCE_ADVICE[name])
        if subject is not None:
            text, action = F.concat(text, subject), F.concat(action, subject)
        return applies.select(F.lit(name).alias("type"), priority.alias("priority"), text.alias("description"),
                              impact.alias("impact"), action.alias("action"))

    overall = df.agg(F.avg("response_time").alias("avg"))
    p95 = exact_percentiles(df, [], "response_time", {"p95": 0.95})
    slow_paths = df.groupBy("path").agg(F.count("*").alias("n"), F.avg("response_time").alias("avg")).where(
        (F.col("avg") > (threshold or 1.0)) & (F.col("n") > 10)).limit(1)
    handlers = df.where(F.col("handler") != "").groupBy("handler").agg(
        F.count("*").alias("n"), count_where(is_error(F.col("status"))).alias("errors"),
        count_where(_cache_hit()).alias("hits"))
    cold = handlers.where((F.col("handler") == CACHE_HANDLER) & (F.col("n") > 100) & (F.try_divide("hits", "n") < 0.5))
    failing = handlers.where((F.col("n") > 100) & (F.try_divide("errors", "n") > 0.1))
    return reduce(DataFrame.unionByName, [
        advice("response_time", overall.where(F.col("avg") > 1.0)),
        advice("response_time_p95", p95.where(F.col("p95") > 3.0)),
        advice("slow_endpoints", slow_paths),
        advice("cache_hit_rate", cold),
        advice("handler_errors", failing, F.col("handler"))])


def performance_report(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "response_time_stats": response_time_stats(df),
        "handler_stats": handler_stats(df),
        "slowest_endpoints": slowest_endpoints(df, 10),
        "recommendations": perf_recommendations(df),
    }
