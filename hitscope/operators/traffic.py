"""Traffic statistics: totals, top lists, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.status import is_error
from ..functions.text import count_where, ratio, seconds_between, top
from ..functions.user_agents import is_bot, parse_user_agent
from ..plans.keys import attach, restrict, restrict_counted, top_keys
from ..plans.percentiles import exact_percentiles
from ..plans.workspace import stored

PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def with_bot_flag(df: DataFrame) -> DataFrame:
    return df if "is_bot" in df.columns else df.withColumn("is_bot", is_bot(F.col("user_agent")))


def strip_query(df: DataFrame) -> DataFrame:
    """Paths without their query string, for reports on very many distinct URLs."""
    return df.withColumn("path", F.substring_index("path", "?", 1))


def total_requests(df: DataFrame):
    """The row count as a scalar subquery, evaluated once."""
    return df.agg(F.count("*")).scalar()


def _sketched_summary(df: DataFrame) -> DataFrame:
    ranks = F.percentile_approx("response_time", [0.5, 0.95, 0.99])
    n = F.col("total_requests")
    return with_bot_flag(df).agg(
        F.count("*").alias("total_requests"), F.approx_count_distinct("ip").alias("unique_ips"),
        F.approx_count_distinct(F.when(F.col("country") != "", F.col("country"))).alias("unique_countries"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("avg_response_time"), ranks.alias("_rank"),
        count_where(F.col("is_bot")).alias("bot_traffic"), count_where(is_error(F.col("status"))).alias("total_errors"),
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
    ).select(
        "total_requests", "unique_ips", "unique_countries", "total_bytes", "avg_response_time",
        *[F.coalesce(F.col("_rank")[i], F.lit(0.0)).alias(name) for i, name in enumerate(
            ("median_response_time", "p95_response_time", "p99_response_time"))],
        "bot_traffic", (n - F.col("bot_traffic")).alias("human_traffic"),
        "total_errors", ratio(F.col("total_errors"), n).alias("error_rate"), "start_time", "end_time")


def traffic_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row of totals.

    Rows are combined per (address, country) first: the distinct counts then
    run over that small table, not over an expanded copy of the log.
    ``approx`` takes distinct counts and percentiles from sketches, in one pass
    without any shuffle of keys.
    """
    if approx:
        return _sketched_summary(df)
    hit = with_bot_flag(df).groupBy("ip", "country").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), F.sum("response_time").alias("seconds"),
        count_where(F.col("is_bot")).alias("bots"), count_where(is_error(F.col("status"))).alias("errors"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    totals = hit.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"),
        F.count_distinct("ip").alias("unique_ips"),
        F.count_distinct(F.when(F.col("country") != "", F.col("country"))).alias("unique_countries"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.sum("seconds").alias("_seconds"),
        F.coalesce(F.sum("bots"), F.lit(0)).alias("bot_traffic"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"),
        F.min("first_ts").alias("start_time"), F.max("last_ts").alias("end_time"))
    ranks = exact_percentiles(df, [], "response_time", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    rank = ranks.select(F.struct("*")).scalar()
    n = F.col("total_requests")
    return totals.withColumn("_rank", rank).select(
        "total_requests", "unique_ips", "unique_countries", "total_bytes",
        ratio(F.col("_seconds"), n).alias("avg_response_time"),
        F.coalesce("_rank.p50", F.lit(0.0)).alias("median_response_time"),
        F.coalesce("_rank.p95", F.lit(0.0)).alias("p95_response_time"),
        F.coalesce("_rank.p99", F.lit(0.0)).alias("p99_response_time"),
        "bot_traffic", (n - F.col("bot_traffic")).alias("human_traffic"),
        "total_errors", ratio(F.col("total_errors"), n).alias("error_rate"),
        "start_time", "end_time")


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("count"))


def method_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("method").agg(F.count("*").alias("count"))


def path_stats(df: DataFrame) -> DataFrame:
    n, errors = F.col("count"), F.col("error_count")
    return df.groupBy("path").agg(
        F.count("*").alias("count"), F.sum("bytes_sent").alias("bytes"),
        F.avg("response_time").alias("avg_response_time"),
        F.max("response_time").alias("max_response_time"), F.min("response_time").alias("min_response_time"),
        count_where(is_error(F.col("status"))).alias("error_count"),
    ).withColumn("error_rate", ratio(errors, n))


def top_paths(df: DataFrame, n: int | None = 10) -> DataFrame:
    return top(path_stats(df), n, "count", "path")


def path_status_counts(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Status counts of the top ``n`` paths, one row per (path, status)."""
    chosen = top_keys(df, ["path"], n)
    return restrict(df, chosen, ["path"], n).groupBy("path", "status").agg(F.count("*").alias("count"))


def top_paths_with_status(df: DataFrame, n: int = 10) -> DataFrame:
    """``top_paths`` plus ``status_counts MAP<INT,BIGINT>``."""
    maps = path_status_counts(df, n).groupBy("path").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("status_counts"))
    return attach(top_paths(df, n), maps, ["path"], n)


def path_handler(df: DataFrame) -> DataFrame:
    """Most frequent non-empty handler per path; the smaller name wins a tie."""
    counted = df.where(F.col("handler") != "").groupBy("path", "handler").agg(F.count("*").alias("n"))
    return counted.groupBy("path").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), "handler")).alias("best")).select("path", F.col("best.handler"))


def ip_stats(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Per address: totals, distinct paths, and what its first record says.

    Two levels: numeric buffers per (address, country, bot flag, path) combine
    map-side, and the strings of the first record are picked from that result.
    """
    per_path = with_bot_flag(df).groupBy("ip", "country", "is_bot", "path").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"),
        count_where(is_error(F.col("status"))).alias("errors"),
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
        F.min_by("ts", seq).alias("first_ts"), F.max_by("ts", seq).alias("last_ts"))
    per_path = per_path.groupBy("ip", "path").agg(
        F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("errors").alias("errors"),
        F.min(F.struct("first_seq", "first_ts", "country", "is_bot")).alias("first"),
        F.max(F.struct("last_seq", "last_ts")).alias("last"))
    per_ip = per_path.groupBy("ip").agg(
        F.sum("n").alias("count"), F.sum("bytes").alias("bytes"), F.sum("errors").alias("error_count"),
        F.count("*").alias("unique_urls"), F.min("first").alias("first"), F.max("last").alias("last"))
    gap = seconds_between(F.col("first.first_ts"), F.col("last.last_ts"))
    return per_ip.select(
        "ip", F.col("first.country").alias("country"), "count", "bytes", "error_count",
        F.col("first.is_bot").alias("is_bot"), "unique_urls",
        ratio(gap, F.col("count") - 1).alias("avg_interval"),
        F.col("first.first_ts").alias("first_seen"), F.col("last.last_ts").alias("last_seen"))


def top_ips(df: DataFrame, n: int | None = 10, seq: str = "seq") -> DataFrame:
    chosen = top_keys(df, ["ip"], n)
    return top(ip_stats(restrict(df, chosen, ["ip"], n), seq), n, "count", "ip")


def country_stats(df: DataFrame) -> DataFrame:
    per_ip = df.where(F.col("country") != "").groupBy("country", "ip").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"),
        count_where(is_error(F.col("status"))).alias("errors"))
    return per_ip.groupBy("country").agg(
        F.sum("n").alias("count"), F.sum("bytes").alias("bytes"),
        F.count("*").alias("unique_ips"), F.sum("errors").alias("error_count"))


def top_countries(df: DataFrame, n: int | None = 10) -> DataFrame:
    return top(country_stats(df), n, "count", "country")


def top_user_agents(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Requests per user agent; the bot flag is taken from the text itself."""
    counted = df.where(F.col("user_agent") != "").groupBy("user_agent").agg(F.count("*").alias("count"))
    return top(counted, n, "count", "user_agent").withColumn("is_bot", is_bot(F.col("user_agent")))


def user_agent_types(df: DataFrame, n: int | None = 15) -> DataFrame:
    return top_user_agents(df, n).select(
        "user_agent", "count", F.when(F.col("is_bot"), "Bot").otherwise("Browser").alias("type"))


def _agent_part(df: DataFrame, part: str, n: int | None) -> DataFrame:
    """Requests per browser or OS, parsed once per distinct user agent."""
    per_agent = df.groupBy("user_agent").agg(F.count("*").alias("n"))
    named = per_agent.select(parse_user_agent(F.col("user_agent"))[part].alias(part), "n")
    return top(named.where(F.col(part) != "").groupBy(part).agg(F.sum("n").alias("count")), n, "count", part)


def top_browsers(df: DataFrame, n: int | None = 10) -> DataFrame:
    return _agent_part(df, "browser", n)


def top_os(df: DataFrame, n: int | None = 10) -> DataFrame:
    return _agent_part(df, "os", n)


def ip_counts(df: DataFrame, seq: str = "seq") -> DataFrame:
    """(ip, country, count): requests and the country of the first record.

    Two small combines; enough to rank addresses without touching their paths.
    """
    part = df.groupBy("ip", "country").agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    return part.groupBy("ip").agg(F.min_by("country", "first_seq").alias("country"), F.sum("n").alias("count"))


def ips_by_country(df: DataFrame, country: str, n: int | None = 10, seq: str = "seq") -> DataFrame:
    """Addresses whose first record came from ``country``, by requests."""
    chosen = top(ip_counts(df, seq).where(F.col("country") == country), n, "count", "ip")
    rows = df.join(chosen.select("ip"), "ip", "left_semi") if n is None else restrict(df, chosen, ["ip"], n)
    return top(ip_stats(rows, seq), n, "count", "ip")


def ips_per_country(df: DataFrame, n: int = 10, seq: str = "seq") -> DataFrame:
    """The same for all countries at once, with the rank inside the country.

    The rank limit is applied before the shuffle, so a country with very many
    addresses still sends only ``n`` rows per task.
    """
    w = Window.partitionBy("country").orderBy(F.col("count").desc(), F.col("ip").asc())
    ranked = stored(ip_counts(df, seq).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("ip", "rank"), "ranked")
    return ip_stats(restrict_counted(df, ranked, "ip", seq), seq).join(ranked, "ip")


def response_time_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """Mean, extremes, population deviation and percentiles (from a sketch if ``approx``)."""
    if approx:
        sketch = F.percentile_approx("response_time", list(PERCENTILES.values()))
        ranks = df.agg(sketch.alias("r")).select(
            F.struct(*[F.col("r")[i].alias(p) for i, p in enumerate(PERCENTILES)])).scalar()
    else:
        ranks = exact_percentiles(df, [], "response_time", PERCENTILES).select(F.struct("*")).scalar()
    return df.agg(
        F.count("response_time").alias("total"), F.avg("response_time").alias("mean"),
        F.min("response_time").alias("min"), F.max("response_time").alias("max"),
        F.stddev_pop("response_time").alias("stddev"),
    ).withColumn("_rank", ranks).select(
        "total", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "min", "max", "stddev")],
        F.coalesce("_rank.p50", F.lit(0.0)).alias("median"),
        *[F.coalesce(f"_rank.{p}", F.lit(0.0)).alias(p) for p in PERCENTILES])


def bandwidth_stats(df: DataFrame) -> DataFrame:
    """Volume totals; the extremes are over the whole-number mean size per path."""
    per_path = df.groupBy("path").agg(F.sum("bytes_sent").alias("bytes"), F.count("*").alias("n"))
    totals = per_path.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.sum("n").alias("_n"),
        F.coalesce(F.max(F.expr("bytes div n")), F.lit(0)).alias("max_bytes_per_req"),
        F.coalesce(F.min(F.expr("bytes div n")), F.lit(0)).alias("min_bytes_per_req"))
    size = F.col("total_bytes")
    return totals.select(
        "total_bytes", (size / 1024 / 1024).alias("total_mb"), (size / 1024 / 1024 / 1024).alias("total_gb"),
        ratio(size, F.col("_n")).alias("avg_bytes_per_req"), "max_bytes_per_req", "min_bytes_per_req")


def traffic_rates(df: DataFrame) -> DataFrame:
    span = df.agg(F.count("*").alias("total_requests"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = seconds_between(F.col("a"), F.col("b")) / 3600
    n = F.col("total_requests")
    return span.select(
        "total_requests", hours.alias("duration_hours"),
        F.try_divide(n, hours).alias("requests_per_hour"),
        F.try_divide(n, hours * 60).alias("requests_per_minute"))


def share_of_total(counted: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds ``percentage`` of all requests to a list with a ``count`` column."""
    return counted.withColumn("percentage", F.try_divide(F.col("count"), total_requests(hits)) * 100)


def country_ip_share(df: DataFrame, countries: int = 10, ips: int = 10,
                     restrict_to_top: int | None = None, seq: str = "seq") -> DataFrame:
    """Per leading country its leading addresses, with their share of its hits.

    ``restrict_to_top=10`` considers only addresses among the ten largest overall.
    """
    lead = top_countries(df, countries).select("country", F.col("count").alias("country_count"))
    address = ip_counts(df, seq)
    if restrict_to_top:
        address = top(address, restrict_to_top, "count", "ip")
    w = Window.partitionBy("country").orderBy(F.col("count").desc(), F.col("ip").asc())
    listed = attach(address.select("ip", "country", "count"), lead, ["country"], countries, "inner")
    return listed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ips).select(
        "country", "ip", "count", "rank", (F.col("count") / F.col("country_count") * 100).alias("percentage"))


# Lists enriched by another table -------------------------------------------

def paths_with_handler(df: DataFrame, n: int = 15) -> DataFrame:
    """Top paths with their main handler, ``-`` if they have none."""
    chosen = top_keys(df, ["path"], n)
    handlers = path_handler(restrict(df, chosen, ["path"], n))
    listed = attach(top_paths(df, n), handlers, ["path"], n)
    return share_of_total(listed.withColumn("handler", F.coalesce("handler", F.lit("-"))), df)


def ips_with_hostname(df: DataFrame, hostnames: DataFrame, n: int = 15, seq: str = "seq") -> DataFrame:
    """Top addresses with the name from an ``(ip, hostname)`` table, else ``-``; of several names the first by text."""
    listed = top_ips(df, n, seq)
    names = restrict(hostnames, listed, ["ip"], n).groupBy("ip").agg(F.min("hostname").alias("hostname"))
    named = attach(listed, names, ["ip"], n)
    name = F.when((F.col("hostname") == "") | (F.col("hostname") == F.col("ip")), "-").otherwise(F.col("hostname"))
    return share_of_total(named.withColumn("hostname", F.coalesce(name, F.lit("-"))), df)
