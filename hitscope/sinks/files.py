"""Exports: metric CSV, timeline CSV, JSON, text report, block list.

Each format is a DataFrame of finished lines or fields; the writers only store
it.  Reports are small, so they go to one file; full tables keep their
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import fixed
from ..operators import traffic
from ..plans.arrival import number_arrivals

_DOUBLE_RULE = "═" * 47
_RULE = "─" * 45


def summary_metrics(summary: DataFrame) -> DataFrame:
    """The one-row traffic summary as (position, metric, value) with fixed number formats."""
    def whole(name: str) -> Column:
        return F.col(name).cast("string")

    metrics = (
        ("Total Requests", whole("total_requests")),
        ("Unique IPs", whole("unique_ips")),
        ("Unique Countries", whole("unique_countries")),
        ("Total Bytes", whole("total_bytes")),
        ("Avg Response Time", fixed(F.col("avg_response_time"), 3)),
        ("Median Response Time", fixed(F.col("median_response_time"), 3)),
        ("P95 Response Time", fixed(F.col("p95_response_time"), 3)),
        ("P99 Response Time", fixed(F.col("p99_response_time"), 3)),
        ("Error Rate", F.concat(fixed(F.col("error_rate") * 100, 2), F.lit("%"))),
        ("Bot Traffic", whole("bot_traffic")),
        ("Human Traffic", whole("human_traffic")),
    )
    return summary.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("metric"), value.alias("value"))
        for i, (name, value) in enumerate(metrics)])))


def write_summary_csv(summary: DataFrame, path: str) -> None:
    rows = summary_metrics(summary).coalesce(1).sortWithinPartitions("position")
    rows.select(F.col("metric").alias("Metric"), F.col("value").alias("Value")).write.mode("overwrite").csv(path, header=True)


def timeline_rows(buckets: DataFrame) -> DataFrame:
    return buckets.select(
        F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("count").alias("Count"),
        F.col("bytes").alias("Bytes"), F.col("unique_ips").alias("UniqueIPs"), F.col("error_count").alias("ErrorCount"))


def write_timeline_csv(buckets: DataFrame, path: str) -> None:
    timeline_rows(buckets).orderBy("Timestamp").write.mode("overwrite").csv(path, header=True)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """A dict of DataFrames (security, bot, performance report) as one folder each."""
    for name, df in reports.items():
        write_json(df, f"{path.rstrip('/')}/{name}")


def report_lines(df: DataFrame, n: int = 10) -> DataFrame:
    """The text report: (section, position, line)."""
    summary = traffic.traffic_summary(df)
    n_total = F.col("total_requests")

    def share(part: Column) -> Column:
        return F.concat(F.lit(" ("), fixed(F.try_divide(part, n_total) * 100, 1), F.lit("%)"))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    def seconds(name: str) -> Column:
        return F.concat(fixed(F.col(name), 3), F.lit("s"))

    def block(frame: DataFrame, section: int, lines: list) -> DataFrame:
        return frame.select(F.lit(section).alias("section"), F.posexplode(F.array(*[
            F.lit(c) if isinstance(c, str) else c for c in lines])).alias("position", "line"))

    head = block(summary, 1, [
        _DOUBLE_RULE, "          LOG ANALYSIS REPORT                 ", _DOUBLE_RULE, "",
        "OVERALL STATISTICS", _RULE,
        line("Total Requests:      ", n_total.cast("string")),
        line("Unique IPs:          ", F.col("unique_ips").cast("string")),
        line("Unique Countries:    ", F.col("unique_countries").cast("string")),
        line("Total Bytes:         ", F.concat(fixed(F.col("total_bytes") / 1024 / 1024, 2), F.lit(" MB"))),
        line("Bot Traffic:         ", F.concat(F.col("bot_traffic").cast("string"), share(F.col("bot_traffic")))),
        line("Human Traffic:       ", F.concat(F.col("human_traffic").cast("string"), share(F.col("human_traffic")))), "",
        "PERFORMANCE METRICS", _RULE,
        line("Avg Response Time:   ", seconds("avg_response_time")),
        line("Median Response Time: ", seconds("median_response_time")),
        line("P95 Response Time:   ", seconds("p95_response_time")),
        line("P99 Response Time:   ", seconds("p99_response_time")),
        line("Error Rate:          ", F.concat(fixed(F.col("error_rate") * 100, 2), F.lit("%"))), "",
    ])
    spark = df.sparkSession
    order = Window.orderBy(F.col("count").desc(), "key")  # over a top list or the set of statuses

    def listing(counted: DataFrame, section: int, title: str, text: Column) -> DataFrame:
        rows = counted.withColumn("rank", F.row_number().over(order)).select(
            F.lit(section).alias("section"), (F.col("rank") + 1).alias("position"), text.alias("line"))
        titles = block(spark.range(1), section, [title, _RULE])
        any_row = counted.limit(1)
        return titles.join(any_row.select(F.lit(1).alias("_x")), how="left_semi").unionByName(rows)

    ordinal = F.concat(F.lpad(F.col("rank").cast("string"), 2, " "), F.lit(". "))
    paths = listing(traffic.top_paths(df, n).withColumn("key", F.col("path")), 2, "TOP PATHS", F.concat(
        ordinal, F.col("path"), F.lit(" ("), F.col("count").cast("string"), F.lit(" requests)")))
    countries = listing(traffic.top_countries(df, n).withColumn("key", F.col("country")), 3, "TOP COUNTRIES", F.concat(
        ordinal, F.col("country"), F.lit(" ("), F.col("count").cast("string"), F.lit(" requests, "),
        F.col("unique_ips").cast("string"), F.lit(" IPs)")))
    shares = traffic.share_of_total(traffic.status_counts(df), df).withColumn("key", F.col("status").cast("string"))
    statuses = listing(shares, 4, "STATUS CODE DISTRIBUTION", F.concat(
        F.col("key"), F.lit(": "), F.col("count").cast("string"), F.lit(" ("), fixed(F.col("percentage"), 1), F.lit("%)")))
    return head.unionByName(paths).unionByName(countries).unionByName(statuses)


def write_report(df: DataFrame, path: str, n: int = 10) -> None:
    lines = report_lines(df, n).coalesce(1).sortWithinPartitions("section", "position")
    lines.select("line").write.mode("overwrite").text(path)


def write_block_list(rules: DataFrame, path: str) -> None:
    """The lines of ``security.block_list`` in order, over as many files as the sort has ranges."""
    rules.orderBy(F.col("request_count").desc(), F.col("ip").asc()).select("line").write.mode("overwrite").text(path)


def write_hits(df: DataFrame, path: str, mode: str = "append") -> None:
    """The normalized table as Parquet, partitioned by day for partition pruning.

    The arrival key of the file reader becomes one number, which sorts and
    combines faster than its struct.  No shuffle: log files are in time order,
    so a task sees few days.
    """
    if "seq" in df.columns and isinstance(df.schema["seq"].dataType, T.StructType) and df.schema["seq"].dataType.fieldNames()[-1] == "line":
        df = number_arrivals(df)
    dated = df.withColumn("log_date", F.to_date("ts"))
    dated.write.mode(mode).partitionBy("log_date").parquet(path)
