"""Windowed statistics on streams.

``sliding_stats``, ``stream_timeline`` and ``stream_alerts`` give final windows
only: event time with a watermark decides, and records later than that are
dropped.  Sliding windows are sums of panes, as wide as the greatest common
divisor of window and slide, so a record is counted once however many windows
it lies in.  ``pane_parts`` keep everything and need no state: what each
micro-batch adds is stored, and ``sliding_of_panes`` makes all windows of it,
exact.  ``timeline_parts`` and ``sliding_parts`` do so in update mode.  Used on
a batch DataFrame the same functions give all windows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.fixed_values import ALERT_ERROR_RATE, ALERT_REQUESTS_PER_MINUTE, ALERT_UNIQUE_IPS_PER_MINUTE
from ..functions.status import is_error
from ..functions.text import count_where
from ..operators.traffic import with_bot_flag
from ..plans.percentiles import exact_percentiles


def _timed(df: DataFrame, delay: str) -> DataFrame:
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", delay) if df.isStreaming else df


def pane_width(window: str, slide: str) -> str:
    """The greatest width that divides both."""
    micros = [int(pd.Timedelta(text).total_seconds() * 1_000_000) for text in (window, slide)]
    return f"{math.gcd(*micros)} microseconds"


def sliding_stats(df: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """The traffic summary of every sliding window.

    Two chained aggregations: records into panes, panes into windows.  Distinct
    addresses (HLL) and percentiles (KLL) are mergeable sketches, so the state
    is one row for each open pane and window, whatever the traffic.
    """
    panes = _timed(with_bot_flag(df), delay).groupBy(F.window("ts", pane_width(window, slide)).alias("pane")).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("ip").alias("ips"), F.sum("bytes_sent").alias("bytes"),
        F.sum("response_time").alias("seconds"), F.count("response_time").alias("timed"),
        F.kll_sketch_agg_double("response_time").alias("times"), count_where(F.col("is_bot")).alias("bots"),
        count_where(is_error(F.col("status"))).alias("errors"))
    stats = panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("window")).agg(
        F.sum("n").alias("total_requests"), F.hll_sketch_estimate(F.hll_union_agg("ips")).alias("unique_ips"),
        F.sum("bytes").alias("total_bytes"), F.sum("seconds").alias("seconds"), F.sum("timed").alias("timed"),
        F.kll_merge_agg_double("times").alias("times"), F.sum("bots").alias("bot_traffic"), F.sum("errors").alias("error_count"))
    ranks = (("median_response_time", 0.5), ("p95_response_time", 0.95), ("p99_response_time", 0.99))
    return stats.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "total_requests", "unique_ips", "total_bytes", F.try_divide("seconds", "timed").alias("avg_response_time"),
        *[F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("times", F.lit(float(p)))).alias(name) for name, p in ranks],
        "bot_traffic", (F.col("total_requests") - F.col("bot_traffic")).alias("human_traffic"),
        "error_count", (F.col("error_count") / F.col("total_requests")).alias("error_rate"))


PANE_KEYS = ("pane", "kind", "ip", "response_time")


def pane_parts(df: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """What ``sliding_of_panes`` needs of some records: counts per (pane, address), and per (pane, response time).

    Parts of different records of one log add up (``sinks.deltas_to_files`` stores those of each micro-batch), so
    no record is ever too late, and a record adds to two rows whatever window and slide are.
    """
    timed = with_bot_flag(df).withColumn("ts", F.col("ts").cast("timestamp"))
    address = F.struct(F.lit("ip").alias("kind"), F.col("ip").alias("ip"), F.lit(None).cast("double").alias("response_time"))
    seconds = F.struct(F.lit("time").alias("kind"), F.lit(None).cast("string").alias("ip"), F.col("response_time").cast("double").alias("response_time"))
    rows = timed.where(F.col("ts").isNotNull()).select(
        F.window("ts", pane_width(window, slide)).alias("_pane"), "bytes_sent", "is_bot", is_error(F.col("status")).alias("_error"), F.inline(F.array(address, seconds)))
    return rows.where("kind = 'ip' OR response_time IS NOT NULL").groupBy(F.col("_pane.start").alias("pane"), *PANE_KEYS[1:]).agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), count_where(F.col("is_bot")).alias("bots"), count_where(F.col("_error")).alias("errors"))


def sliding_of_panes(parts: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """The columns of ``sliding_stats``, exact, from all stored parts.

    An address counts in a window at its first pane there: in the windows that hold this pane but not the one it came
    in before.  So distinct addresses are counts per (pane, gap to the one before), and only such counts, not
    addresses, are spread over the windows.
    """
    parts = parts.groupBy(*PANE_KEYS).agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "bots", "errors")])
    keys = ["window_start", "window_end"]

    def windows(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_w", F.window("pane", window, slide)).withColumns({"window_start": F.col("_w.start"), "window_end": F.col("_w.end")}).drop("_w")

    reach = F.expr(f"INTERVAL {window}")
    before = F.lag("pane").over(Window.partitionBy("ip").orderBy("pane"))
    gaps = parts.where("kind = 'ip'").withColumn("_before", before).withColumn("_before", F.when(F.col("_before") + reach > F.col("pane"), F.col("_before")))
    totals = windows(gaps.groupBy("pane", "_before").agg(
        *[F.sum(c).alias(c) for c in ("n", "bytes", "bots", "errors")], F.count("ip").alias("ips")))
    new = F.col("_before").isNull() | (F.col("_before") < F.col("window_start"))
    stats = totals.groupBy(*keys).agg(
        F.sum("n").alias("total_requests"), F.sum(F.when(new, F.col("ips")).otherwise(0)).alias("unique_ips"), F.sum("bytes").alias("total_bytes"),
        F.sum("bots").alias("bot_traffic"), F.sum("errors").alias("error_count"))
    times = parts.where("kind = 'time'").select("pane", "response_time", "n")
    means = windows(times.groupBy("pane").agg(F.sum(F.col("response_time") * F.col("n")).alias("seconds"), F.sum("n").alias("timed"))).groupBy(*keys).agg(
        (F.sum("seconds") / F.sum("timed")).alias("avg_response_time"))
    ranks = exact_percentiles(windows(times), keys, "response_time", {"median_response_time": 0.5, "p95_response_time": 0.95, "p99_response_time": 0.99}, "n")
    return stats.join(means, keys, "left").join(ranks, keys, "left").select(
        *keys, "total_requests", "unique_ips", "total_bytes", "avg_response_time", "median_response_time", "p95_response_time", "p99_response_time",
        "bot_traffic", (F.col("total_requests") - F.col("bot_traffic")).alias("human_traffic"),
        "error_count", (F.col("error_count") / F.col("total_requests")).alias("error_rate"))


def sliding_parts(df: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str | None = None) -> DataFrame:
    """What ``sliding_of`` needs, for update mode: counts per (window, address, response time).

    Without ``delay`` no record is ever too late, and the state keeps all
    windows; with it, windows that the watermark has passed are final.
    """
    timed = with_bot_flag(df).withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if delay and df.isStreaming else timed
    return timed.groupBy(F.window("ts", window, slide), "ip", "response_time").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), count_where(F.col("is_bot")).alias("bots"),
        count_where(is_error(F.col("status"))).alias("errors")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "ip", "response_time", "n", "bytes", "bots", "errors")


def sliding_of(parts: DataFrame) -> DataFrame:
    """The columns of ``sliding_stats``, exact, from the last stored version of each part."""
    keys = ["window_start", "window_end"]
    ranks = exact_percentiles(parts, keys, "response_time", {"median_response_time": 0.5, "p95_response_time": 0.95, "p99_response_time": 0.99}, "n")
    per_ip = parts.groupBy(*keys, "ip").agg(
        *[F.sum(c).alias(c) for c in ("n", "bytes", "bots", "errors")], F.sum(F.col("response_time") * F.col("n")).alias("seconds"),
        F.sum(F.when(F.col("response_time").isNotNull(), F.col("n"))).alias("timed"))
    stats = per_ip.groupBy(*keys).agg(
        F.sum("n").alias("total_requests"), F.count("ip").alias("unique_ips"), F.sum("bytes").alias("total_bytes"),
        F.try_divide(F.sum("seconds"), F.sum("timed")).alias("avg_response_time"), F.sum("bots").alias("bot_traffic"), F.sum("errors").alias("error_count"))
    return stats.join(ranks, keys, "left").select(
        *keys, "total_requests", "unique_ips", "total_bytes", "avg_response_time", "median_response_time", "p95_response_time", "p99_response_time",
        "bot_traffic", (F.col("total_requests") - F.col("bot_traffic")).alias("human_traffic"),
        "error_count", (F.col("error_count") / F.col("total_requests")).alias("error_rate"))


def timeline_parts(df: DataFrame, granularity: str = "1 minute", delay: str | None = None) -> DataFrame:
    """What ``timeline_of`` needs, for update mode: counts per (bucket, address); ``delay`` as in ``sliding_parts``."""
    timed = df.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", delay) if delay and df.isStreaming else timed
    return timed.groupBy(F.window("ts", granularity), "ip").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), F.sum("response_time").alias("seconds"),
        count_where(is_error(F.col("status"))).alias("errors")).select(F.col("window.start").alias("bucket"), "ip", "n", "bytes", "seconds", "errors")


def timeline_of(parts: DataFrame) -> DataFrame:
    """The columns of ``stream_timeline`` for all buckets so far, from the last stored version of each part."""
    return parts.groupBy("bucket").agg(
        F.sum("n").alias("count"), F.sum("bytes").alias("bytes"), F.count("*").alias("unique_ips"),
        F.sum("errors").alias("error_count"), (F.sum("seconds") / F.sum("n")).alias("avg_response_time"))


def stream_timeline(df: DataFrame, granularity: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Tumbling buckets with the columns of the batch timeline, addresses exact.

    Two chained aggregations: per (bucket, address), then per bucket, so a
    bucket's addresses are spread over the state stores.
    """
    per_ip = _timed(df, delay).groupBy(F.window("ts", granularity), "ip").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), F.sum("response_time").alias("seconds"),
        count_where(is_error(F.col("status"))).alias("errors"))
    return per_ip.groupBy("window").agg(
        F.sum("n").alias("count"), F.sum("bytes").alias("bytes"), F.count("*").alias("unique_ips"),
        F.sum("errors").alias("error_count"), (F.sum("seconds") / F.sum("n")).alias("avg_response_time"),
    ).select(F.col("window.start").alias("bucket"), "count", "bytes", "unique_ips", "error_count", "avg_response_time")


def alerts(buckets: DataFrame, error_rate: float = ALERT_ERROR_RATE, requests: int = ALERT_REQUESTS_PER_MINUTE,
           unique_ips: int = ALERT_UNIQUE_IPS_PER_MINUTE) -> DataFrame:
    """(bucket, alert, value, threshold) for timeline buckets above a threshold."""
    tests = (("error_rate", F.col("error_count") / F.col("count"), error_rate),
             ("requests", F.col("count").cast("double"), requests),
             ("unique_ips", F.col("unique_ips").cast("double"), unique_ips))
    rows = F.array(*[F.struct(F.lit(name).alias("alert"), value.alias("value"), F.lit(float(limit)).alias("threshold"))
                     for name, value, limit in tests])
    return buckets.select("bucket", F.inline(rows)).where(F.col("value") > F.col("threshold"))


def stream_alerts(df: DataFrame, granularity: str = "1 minute", delay: str = "1 minute", **limits) -> DataFrame:
    return alerts(stream_timeline(df, granularity, delay), **limits)
