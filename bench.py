"""Benchmark: raw-log parsing and the headline reports.

Prints one JSON line.  The access log is derived from ``$BENCH_SF_DIR`` and
stored once, as raw JSON lines and as the normalized table, the way the library
is meant to be used; every timed query then reads whole files.
``$BENCH_COPIES`` (default 1) repeats the log to see how time grows.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitscope.operators import (
    anomaly, api_usage, bots, commerce, content, geo, performance, security, timeline, traffic,
)
from hitscope.session import configure
from hitscope.sources.records import read_access_log
from registry.parsing import json_line
from registry.view import hits

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))


def reports(log: DataFrame, raw: str, spark: SparkSession) -> dict:
    """Query name -> function that runs it to the end."""
    def discard(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    middle = log.agg(F.expr("percentile_approx(unix_seconds(cast(ts as timestamp)), 0.5)")).collect()[0][0]
    cut = F.timestamp_seconds(F.lit(middle))
    old, new = log.where(F.col("ts").cast("timestamp") < cut), log.where(F.col("ts").cast("timestamp") >= cut)
    return {
        "parse_json": lambda: discard(read_access_log(spark, raw)),
        "traffic_summary": lambda: traffic.traffic_summary(log).collect(),
        "top_paths": lambda: traffic.top_paths(log).collect(),
        "top_ips": lambda: traffic.top_ips(log).collect(),
        "top_countries": lambda: traffic.top_countries(log).collect(),
        "top_browsers": lambda: traffic.top_browsers(log).collect(),
        "response_time_stats": lambda: traffic.response_time_stats(log).collect(),
        "timeline": lambda: discard(timeline.timeline(log, "1 minute")),
        "threat_events": lambda: discard(security.threat_events(log)),
        "ip_profile": lambda: discard(security.ip_profile(log)),
        "security_summary": lambda: security.security_summary(security.ip_profile(log)).collect(),
        "suspicious_ips": lambda: security.suspicious_ips(security.ip_profile(log)).collect(),
        "bot_behavior": lambda: bots.bot_behavior(bots.bot_profile(log)).collect(),
        "slowest_endpoints": lambda: performance.slowest_endpoints(log).collect(),
        "handler_stats": lambda: performance.handler_stats(log).collect(),
        "api_endpoints": lambda: api_usage.api_endpoints(log).collect(),
        "shop_categories": lambda: commerce.category_stats(log).collect(),
        "extension_stats": lambda: content.extension_stats(log).collect(),
        "geo_summary": lambda: geo.geo_summary(log).collect(),
        "anomalies": lambda: anomaly.detect_anomalies(new, anomaly.baseline(old, "1 hour"), 3.0, "1 hour").collect(),
    }


def main() -> None:
    builder = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g"))
    spark = configure(builder, int(CPUS)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    base = tempfile.mkdtemp(prefix="bench-")
    one = hits(spark, SF_DIR, referer=True)
    rows = one.count()
    copies = one.crossJoin(spark.range(COPIES).withColumnRenamed("id", "_copy")) if COPIES > 1 else one.withColumn("_copy", F.lit(0))
    log = copies.withColumns({
        "seq": F.col("seq") + F.col("_copy") * rows,
        "ip": F.when(F.col("_copy") == 0, F.col("ip")).otherwise(F.concat(F.col("ip"), F.lit("."), F.col("_copy"))),
    }).drop("_copy").repartitionByRange(2 * int(CPUS), "seq")
    started = time.time()
    log.write.parquet(f"{base}/table")
    spark.read.parquet(f"{base}/table").select(json_line().alias("value")).write.text(f"{base}/raw")
    prepared = time.time() - started
    table = spark.read.parquet(f"{base}/table")
    timed = {}
    for name, run in reports(table, f"{base}/raw", spark).items():
        best = None
        for _ in range(3):  # the first run also compiles
            started = time.time()
            run()
            took = time.time() - started
            best = took if best is None else min(best, took)
        timed[name] = round(best, 3)
    total = rows * COPIES
    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": SF_DIR.rsplit("sf", 1)[-1], "rows": total, "cpus": int(CPUS),
        "parse_rows_per_sec": round(total / timed["parse_json"]),
        "report_rows_per_sec": {k: round(total / v) for k, v in timed.items()},
        "prepare_sec": round(prepared, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
