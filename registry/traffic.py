"""Queries on filters, traffic statistics and time series."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from hitscope.operators import filters as f, timeline as tl, traffic as t
from hitscope.operators.security import threat_events
from hitscope.plans import networks
from hitscope.plans.daily import ADDRESS_ERROR, RANK_ERROR, DailyTables
from hitscope.plans.workspace import shared_folder

from .base import ERRORS, add, add_raw, is_bot_sql, r, text
from .security import EVENTS, FLAGS
from .view import hits

AS_OF = dt.datetime(2024, 1, 20, 12, 0, 0)
START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 9)


def _keys(df):
    return df.select("seq", "ip", "status", "path")


def filtered(name: str, condition, where: str) -> None:
    add(name, lambda df: _keys(df.where(condition() if callable(condition) else condition)),
        f"SELECT seq, ip, status, path FROM hits WHERE {where}")


# Filters --------------------------------------------------------------------
_SPEC = f.HitFilter(countries=("nation_3", "NATION_7"), statuses=(200, 404), methods=("get", "Post"),
                    networks=("203.0.0.0/22",), time_range=(START, END), path_patterns=("product", "^/cart"),
                    exclude_bots=True, ignore_blocked=True)
_BETWEEN = f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


def octet(i: int) -> str:
    return f"split_part(ip, '.', {i})::BIGINT"


IP_NUMBER = f"({octet(1)} * 16777216 + {octet(2)} * 65536 + {octet(3)} * 256 + {octet(4)})"
add("apply_filters", lambda df: _keys(f.apply_filters(df, _SPEC)),
    f"""SELECT seq, ip, status, path FROM hits WHERE country IN ('NATION_3', 'NATION_7') AND status IN (200, 404)
    AND method IN ('GET', 'POST') AND {octet(3)} < 4 AND {_BETWEEN} AND regexp_matches(path, 'product|^/cart')
    AND NOT {is_bot_sql()} AND status NOT IN (403, 429)""")
add("no_filter", lambda df: _keys(f.apply_filters(df, f.HitFilter())), "SELECT seq, ip, status, path FROM hits")
filtered("filter_countries", lambda: f.in_countries(["nation_1", "NATION_2"]), "country IN ('NATION_1', 'NATION_2')")
filtered("filter_statuses", lambda: f.in_statuses([401, 503]), "status IN (401, 503)")
filtered("filter_methods", lambda: f.in_methods(["trace", "post"]), "method IN ('TRACE', 'POST')")
filtered("filter_networks", lambda: f.in_networks(["203.0.0.64/26", "203.0.2.0/23", "2001:db8::/32"]),
         f"({octet(3)} = 0 AND {octet(4)} BETWEEN 64 AND 127) OR {octet(3)} IN (2, 3)")
_NETS = [f"203.0.{i % 6}.{i * 13 % 256}/{32 if i % 2 else 31}" for i in range(400)]
add("filter_many_networks", lambda df: _keys(f.in_network_table(df, _NETS)),
    f"""WITH nets AS (SELECT split_part(c, '/', 1) AS ip, split_part(c, '/', 2)::INTEGER AS len
      FROM (SELECT unnest({_NETS!r}) AS c)),
    ranges AS (SELECT DISTINCT {IP_NUMBER} // (1 << (32 - len)) * (1 << (32 - len)) AS lo,
      {IP_NUMBER} // (1 << (32 - len)) * (1 << (32 - len)) + (1 << (32 - len)) - 1 AS hi FROM nets)
    SELECT seq, ip, status, path FROM hits WHERE EXISTS (SELECT 1 FROM ranges WHERE {IP_NUMBER} BETWEEN lo AND hi)""")
# More networks than a plan should hold, and networks that are a table themselves (suppliers').
_INDEXED = [f"203.0.{i % 7}.{i * 29 % 256 // 3 * 3}/32" for i in range(1_200)] + [f"2001:db8:{i:x}::/48" for i in range(300)]
_IN_RANGES = f"SELECT seq, ip, status, path FROM hits WHERE EXISTS (SELECT 1 FROM ranges WHERE {IP_NUMBER} BETWEEN lo AND hi)"
_RANGES = f"""ranges AS (SELECT DISTINCT {IP_NUMBER} // (1 << (32 - len)) * (1 << (32 - len)) AS lo,
      {IP_NUMBER} // (1 << (32 - len)) * (1 << (32 - len)) + (1 << (32 - len)) - 1 AS hi FROM nets)"""
add("filter_network_index", lambda df: _keys(f.in_network_table(df, _INDEXED)),
    f"""WITH nets AS (SELECT split_part(c, '/', 1) AS ip, split_part(c, '/', 2)::INTEGER AS len
      FROM (SELECT unnest({[c for c in _INDEXED if ":" not in c]!r}) AS c)), {_RANGES} {_IN_RANGES}""")
_NET_TABLE = "'203.0.' || CAST(s_suppkey % 3 AS {string}) || '.' || CAST(s_suppkey * 37 % 256 AS {string})"


def _supplier_networks(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.expr(_NET_TABLE.format(string="STRING") + " || '/' || CAST(29 + s_suppkey % 4 AS STRING)").alias("network"))
    return _keys(networks.in_network_frame(hits(spark, sf_dir), table))


add_raw("filter_network_frame", _supplier_networks,
        f"WITH nets AS (SELECT {_NET_TABLE.format(string='VARCHAR')} AS ip, (29 + s_suppkey % 4)::INTEGER AS len FROM supplier), {_RANGES} {_IN_RANGES}")
filtered("filter_time_range", lambda: f.in_time_range(START, END), _BETWEEN)
filtered("filter_path_patterns", lambda: f.path_matches(["^/rest", "(?i)GRAPHQL"]), "regexp_matches(path, '^/rest|(?i)graphql')")
filtered("filter_exclude_bots", lambda: ~f.is_bot(F.col("user_agent")), f"NOT {is_bot_sql()}")
filtered("filter_ignore_blocked", lambda: ~f.is_blocked(), "status NOT IN (403, 429)")
filtered("filter_blocked_statuses", lambda: f.is_blocked([401]), "status = 401")
filtered("errors_only", f.errors_only, "status >= 400 AND status < 600")
filtered("success_only", f.success_only, "status >= 200 AND status < 300")
filtered("client_errors_only", f.client_errors_only, "status >= 400 AND status < 500")
filtered("server_errors_only", f.server_errors_only, "status >= 500 AND status < 600")
add("no_bots", lambda df: _keys(df.where(f.no_bots(df))), f"SELECT seq, ip, status, path FROM hits WHERE NOT {is_bot_sql()}")
filtered("api_only", f.api_only, "regexp_matches(path, '(?i)/(api|graphql|rest|wp-json)')")
filtered("recent_activity", lambda: f.recent_activity(36, AS_OF), f"ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 36 HOURS AND TIMESTAMP '{AS_OF}'")
filtered("slow_requests", lambda: f.slow_requests(2.0), "response_time >= 2.0")
filtered("large_responses", lambda: f.large_responses(512_000), "bytes_sent >= 512000")
filtered("by_countries", lambda: f.by_countries(["nation_9"]), "country = 'NATION_9'")
filtered("by_status", lambda: f.by_status([500]), "status = 500")
filtered("by_method", lambda: f.by_method(["post"]), "method = 'POST'")

# Traffic ---------------------------------------------------------------------
add("traffic_summary", t.traffic_summary, f"""SELECT count(*) AS total_requests, count(DISTINCT ip) AS unique_ips,
    count(DISTINCT nullif(country, '')) AS unique_countries, sum(bytes_sent)::BIGINT AS total_bytes,
    {r("avg(response_time)")} AS avg_response_time, {r("median(response_time)")} AS median_response_time,
    {r("quantile_cont(response_time, 0.95)")} AS p95_response_time, {r("quantile_cont(response_time, 0.99)")} AS p99_response_time,
    count(*) FILTER ({is_bot_sql()}) AS bot_traffic, count(*) FILTER (NOT {is_bot_sql()}) AS human_traffic,
    {ERRORS} AS total_errors, {r(ERRORS + " / count(*)")} AS error_rate, min(ts) AS start_time, max(ts) AS end_time FROM hits""")
add("status_counts", t.status_counts, "SELECT status, count(*) AS count FROM hits GROUP BY status")
add("method_counts", t.method_counts, "SELECT method, count(*) AS count FROM hits GROUP BY method")
PATHS = f"""SELECT path, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes, {r("avg(response_time)")} AS avg_response_time,
    {r("max(response_time)")} AS max_response_time, {r("min(response_time)")} AS min_response_time, {ERRORS} AS error_count,
    {r(ERRORS + " / count(*)")} AS error_rate FROM hits GROUP BY path"""
add("top_paths", t.top_paths, PATHS + " ORDER BY count DESC, path LIMIT 10")
add("all_paths", t.path_stats, PATHS)
add("paths_without_query", lambda df: t.top_paths(t.strip_query(df).select("path", "bytes_sent", "response_time", "status"), 25),
    PATHS.replace("SELECT path", "SELECT split_part(path, '?', 1) AS path").replace("GROUP BY path", "GROUP BY 1") + " ORDER BY count DESC, path LIMIT 25")
add("path_status_counts", lambda df: t.path_status_counts(df, 10),
    """WITH lead AS (SELECT path FROM hits GROUP BY path ORDER BY count(*) DESC, path LIMIT 10)
    SELECT path, status, count(*) AS count FROM hits WHERE path IN (SELECT path FROM lead) GROUP BY path, status""")
add("top_paths_with_status", lambda df: t.top_paths_with_status(df, 10).select("path", "count", F.explode("status_counts").alias("status", "status_count")),
    """WITH lead AS (SELECT path, count(*) AS count FROM hits GROUP BY path ORDER BY count(*) DESC, path LIMIT 10)
    SELECT h.path, any_value(lead.count) AS count, status, count(*) AS status_count FROM hits h JOIN lead USING (path) GROUP BY h.path, status""")
HANDLERS = """(SELECT path, handler FROM (SELECT path, handler, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, handler) AS k
    FROM hits WHERE handler <> '' GROUP BY path, handler) WHERE k = 1)"""
add("path_handler", t.path_handler, f"SELECT path, handler FROM {HANDLERS}")
IPS = f"""SELECT ip, arg_min(country, seq) AS country, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes, {ERRORS} AS error_count,
    arg_min({is_bot_sql()}, seq) AS is_bot, count(DISTINCT path) AS unique_urls,
    CASE WHEN count(*) > 1 THEN {r("(epoch_us(arg_max(ts, seq)) - epoch_us(arg_min(ts, seq))) / 1e6 / (count(*) - 1)")} ELSE 0.0 END AS avg_interval,
    arg_min(ts, seq) AS first_seen, arg_max(ts, seq) AS last_seen FROM hits GROUP BY ip"""
add("top_ips", t.top_ips, IPS + " ORDER BY count DESC, ip LIMIT 10")
add("ip_stats", t.ip_stats, IPS)
COUNTRIES = f"""SELECT country, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes, count(DISTINCT ip) AS unique_ips,
    {ERRORS} AS error_count FROM hits WHERE country <> '' GROUP BY country"""
add("top_countries", t.top_countries, COUNTRIES + " ORDER BY count DESC, country LIMIT 10")
AGENTS = f"""SELECT user_agent, count(*) AS count, {is_bot_sql()} AS is_bot FROM hits WHERE user_agent <> '' GROUP BY user_agent
    ORDER BY count DESC, user_agent LIMIT """
add("top_user_agents", t.top_user_agents, AGENTS + "10")
add("ua_type_label", t.user_agent_types, f"SELECT user_agent, count, CASE WHEN is_bot THEN 'Bot' ELSE 'Browser' END AS type FROM ({AGENTS} 15)")
# The expected names are those of the nine user agents of the view.
NAMED = """(SELECT *, CASE WHEN user_agent IN ('', '-') THEN 'Unknown' WHEN contains(user_agent, 'iPhone') THEN 'Safari 604.1'
    WHEN contains(user_agent, 'Chrome/120.0') THEN 'Chrome 120.0' WHEN contains(user_agent, 'Mozilla') THEN ''
    ELSE replace(split_part(user_agent, ' ', 1), '/', ' ') END AS browser,
    CASE WHEN user_agent IN ('', '-') THEN 'Unknown' WHEN contains(user_agent, 'iPhone') THEN 'iOS'
    WHEN contains(user_agent, 'Windows') THEN 'Windows 10' ELSE '' END AS os FROM hits)"""
add("top_browsers", t.top_browsers, f"SELECT browser, count(*) AS count FROM {NAMED} WHERE browser <> '' GROUP BY browser ORDER BY count DESC, browser LIMIT 10")
add("top_os", t.top_os, f"SELECT os, count(*) AS count FROM {NAMED} WHERE os <> '' GROUP BY os ORDER BY count DESC, os LIMIT 10")
add("ips_by_country", lambda df: t.ips_by_country(df, "NATION_3", 10), f"SELECT * FROM ({IPS}) WHERE country = 'NATION_3' ORDER BY count DESC, ip LIMIT 10")
add("ips_per_country", lambda df: t.ips_per_country(df, 5),
    f"""SELECT * REPLACE (rank::INTEGER AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY count DESC, ip) AS rank
    FROM ({IPS})) WHERE rank <= 5""")
add("response_time_stats", t.response_time_stats, "SELECT count(*) AS total, " + ", ".join(
    f"{r(e)} AS {n}" for n, e in (("mean", "avg(response_time)"), ("min", "min(response_time)"), ("max", "max(response_time)"),
    ("stddev", "stddev_pop(response_time)"), ("median", "median(response_time)"),
    *[(f"p{p}", f"quantile_cont(response_time, 0.{p})") for p in (50, 75, 90, 95, 99)])) + " FROM hits")
add("bandwidth_stats", t.bandwidth_stats, f"""WITH p AS (SELECT sum(bytes_sent)::BIGINT AS b, count(*) AS n FROM hits GROUP BY path)
    SELECT sum(b)::BIGINT AS total_bytes, {r("sum(b) / 1024 / 1024")} AS total_mb, {r("sum(b) / 1024 / 1024 / 1024")} AS total_gb,
    {r("sum(b) / sum(n)")} AS avg_bytes_per_req, max(b // n) AS max_bytes_per_req, min(b // n) AS min_bytes_per_req FROM p""")
_HOURS = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 3600"
add("traffic_rates", t.traffic_rates, f"""SELECT count(*) AS total_requests, {r(_HOURS)} AS duration_hours,
    {r(f"count(*) / ({_HOURS})")} AS requests_per_hour, {r(f"count(*) / ({_HOURS} * 60)")} AS requests_per_minute FROM hits""")
SHARE = r("count * 100.0 / (SELECT count(*) FROM hits)")
for _name, _build, _sql in (
        ("status_share", t.status_counts, "SELECT status, count(*) AS count FROM hits GROUP BY status"),
        ("country_share", lambda df: t.top_countries(df).select("country", "count"), f"SELECT country, count FROM ({COUNTRIES}) ORDER BY count DESC, country LIMIT 10"),
        ("path_share", lambda df: t.top_paths(df, 15).select("path", "count"), f"SELECT path, count FROM ({PATHS}) ORDER BY count DESC, path LIMIT 15"),
        ("ip_share", lambda df: t.top_ips(df, 15).select("ip", "count"), f"SELECT ip, count FROM ({IPS}) ORDER BY count DESC, ip LIMIT 15"),
        ("browser_share", t.top_browsers, f"SELECT browser, count(*) AS count FROM {NAMED} WHERE browser <> '' GROUP BY browser ORDER BY count DESC, browser LIMIT 10"),
        ("os_share", t.top_os, f"SELECT os, count(*) AS count FROM {NAMED} WHERE os <> '' GROUP BY os ORDER BY count DESC, os LIMIT 10")):
    add(_name, lambda df, build=_build: t.share_of_total(build(df), df), f"SELECT *, {SHARE} AS percentage FROM ({_sql})")
_LISTS = {"status": t.status_counts, "country": t.country_stats, "path": t.path_stats, "ip": t.ip_counts, "browser": lambda df: t.top_browsers(df, None),
          "os": lambda df: t.top_os(df, None)}


def _all_shares(df):
    parts = [t.share_of_total(build(df).select(F.col(k).cast("string").alias("key"), "count"), df).withColumn("list", F.lit(k))
             for k, build in _LISTS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


add("share_of_total", _all_shares, f"SELECT *, {SHARE} AS percentage FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS list, {k}::VARCHAR AS key, count(*) AS count FROM {NAMED} WHERE {k}::VARCHAR <> '' GROUP BY {k}" for k in _LISTS) + ")")
_COUNTRY_IPS = """WITH lead AS (SELECT country, count(*) AS c FROM hits WHERE country <> '' GROUP BY country ORDER BY c DESC, country LIMIT 10),
    addresses AS (SELECT ip, arg_min(country, seq) AS country, count(*) AS count FROM hits GROUP BY ip {restrict})
    SELECT country, ip, count, rank::INTEGER AS rank, round(count * 100.0 / c, 9) AS percentage FROM (
      SELECT *, row_number() OVER (PARTITION BY country ORDER BY count DESC, ip) AS rank FROM addresses JOIN lead USING (country)) WHERE rank <= 10"""
add("country_ip_share", t.country_ip_share, _COUNTRY_IPS.format(restrict=""))
add("country_ip_share_top", lambda df: t.country_ip_share(df, restrict_to_top=10), _COUNTRY_IPS.format(restrict="ORDER BY count DESC, ip LIMIT 10"))
add("paths_with_handler", t.paths_with_handler, f"""SELECT p.*, coalesce(handler, '-') AS handler, {SHARE} AS percentage
    FROM ({PATHS} ORDER BY count DESC, path LIMIT 15) p LEFT JOIN {HANDLERS} USING (path)""")


def _hostnames(spark, sf_dir):
    """Suppliers stand in for resolved hosts: one name per address of the view."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    names = supplier.select(F.concat(F.lit("203.0.0."), (key - 1).cast("string")).alias("ip"),
                            F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("host-"), key.cast("string"))).alias("hostname"))
    return t.ips_with_hostname(hits(spark, sf_dir), names, 15)


add_raw("ips_with_hostname", _hostnames, f"""WITH names AS (SELECT '203.0.0.' || (s_suppkey - 1) AS ip,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'host-' || s_suppkey END AS hostname FROM supplier)
    SELECT p.*, coalesce(nullif(hostname, ''), '-') AS hostname, {SHARE} AS percentage
    FROM ({IPS} ORDER BY count DESC, ip LIMIT 15) p LEFT JOIN names USING (ip)""")

# Time series ------------------------------------------------------------------
def _timeline_sql(unit: str) -> str:
    return f"""SELECT {unit} AS bucket, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes, count(DISTINCT ip) AS unique_ips,
    {ERRORS} AS error_count, {r("avg(response_time)")} AS avg_response_time FROM hits GROUP BY 1"""


HOUR, MINUTE = "date_trunc('hour', ts)", "date_trunc('minute', ts)"
add("timeline", lambda df: tl.timeline(df, "1 hour"), _timeline_sql(HOUR))
add("timeline_minute", tl.timeline, _timeline_sql(MINUTE))
add("timeline_day", lambda df: tl.timeline(df, "1 day"), _timeline_sql("date_trunc('day', ts)::TIMESTAMP"))
add("timeline_week", lambda df: tl.timeline(df, "7 days"), _timeline_sql("date_trunc('week', ts)::TIMESTAMP"))
add("timeline_statuses", lambda df: tl.timeline_status_counts(df, "1 hour"),
    f"SELECT {HOUR} AS bucket, status, count(*) AS count FROM hits GROUP BY ALL")
add("timeline_with_status", lambda df: tl.timeline_with_status(df, "1 day").select("bucket", "count", F.explode("status_counts").alias("status", "status_count")),
    """WITH d AS (SELECT *, date_trunc('day', ts)::TIMESTAMP AS bucket FROM hits)
    SELECT bucket, any_value(n) AS count, status, count(*) AS status_count FROM d
    JOIN (SELECT bucket, count(*) AS n FROM d GROUP BY bucket) USING (bucket) GROUP BY bucket, status""")
add("peak_bucket", lambda df: tl.peak_bucket(df, "1 hour"), _timeline_sql(HOUR) + " ORDER BY count DESC, bucket LIMIT 1")
add("security_timeline", lambda df: tl.security_timeline(threat_events(df), "1 hour").groupBy("bucket", "threat_type", "severity").agg(
        F.sum("count").alias("count"), F.count("*").alias("ips")),
    f"""WITH {FLAGS}, e AS (SELECT {HOUR} AS bucket, ip, threat_type FROM {EVENTS})
    SELECT bucket, threat_type, CASE WHEN threat_type IN ('xss', 'directory_traversal') THEN 'high' ELSE 'critical' END AS severity,
    count(*) AS count, count(DISTINCT ip) AS ips FROM e GROUP BY bucket, threat_type""", True)
add("hour_profile", tl.hour_profile, """SELECT hour, count, row_number() OVER (ORDER BY count DESC, hour)::INTEGER AS peak_rank,
    row_number() OVER (ORDER BY count, hour)::INTEGER AS low_rank FROM (SELECT hour(ts)::INTEGER AS hour, count(*) AS count FROM hits GROUP BY 1)""")
add("traffic_patterns", tl.traffic_patterns, f"""WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM hits GROUP BY 1),
    d AS (SELECT ts::DATE AS day, count(*) AS n FROM hits GROUP BY 1),
    s AS (SELECT date_trunc('second', ts) AS second, count(*) AS n FROM hits GROUP BY 1)
    SELECT (SELECT string_agg(hour, ',' ORDER BY n DESC, hour) FROM (SELECT * FROM h ORDER BY n DESC, hour LIMIT 3)) AS peak_hours,
    (SELECT string_agg(hour, ',' ORDER BY n, hour) FROM (SELECT * FROM h ORDER BY n, hour LIMIT 3)) AS low_hours,
    {r("(SELECT avg(n) FILTER (dayofweek(day) IN (0, 6)) / avg(n) FILTER (dayofweek(day) NOT IN (0, 6)) FROM d)")} AS weekend_weekday_ratio,
    {r("(SELECT sum(n) / (epoch(max(second)) - epoch(min(second)) + 1) FROM s)")} AS avg_rps,
    (SELECT max(n) FROM s) AS peak_rps""")

# Rows kept by day -------------------------------------------------------------
_RANKS = {"median_response_time": 0.5, "p95_response_time": 0.95, "p99_response_time": 0.99}
_FIRST, _LAST = dt.date(2024, 1, 3), dt.date(2024, 1, 24)
_IN_DAYS = f"ts::DATE BETWEEN DATE '{_FIRST}' AND DATE '{_LAST}'"
_RANKS_SQL = ", ".join(f"{r(f'quantile_cont(response_time, {q})')} AS {name}" for name, q in _RANKS.items())


def _daily(df, **keys):
    """The tables by day, odd days after even ones."""
    tables = DailyTables(shared_folder(df.sparkSession, "daily"), keys)
    for k in range(2):
        tables.add(df.where(F.dayofmonth("ts") % 2 == k))
    return tables


def _estimates(df):
    """Sketches judged by the log: whether addresses and ranks are within the errors they state."""
    known = df.groupBy("handler").agg(F.countDistinct("ip").alias("known"))
    guessed = _daily(df, handler="string").estimates(df.sparkSession, _RANKS)
    judged = df.select("handler", "response_time").join(guessed, "handler").groupBy("handler").agg(
        F.first("requests").alias("requests"), F.first("unique_ips").alias("unique_ips"),
        F.greatest(*[F.greatest(F.count(F.when(F.col("response_time") < F.col(p), 1)) - q * F.count("*"),
                                q * F.count("*") - F.count(F.when(F.col("response_time") <= F.col(p), 1))) / F.count("*") for p, q in _RANKS.items()]).alias("off"))
    return judged.join(known, "handler").select("handler", "requests", (F.abs(F.col("unique_ips") - F.col("known")) <= 4 * ADDRESS_ERROR * F.col("known") + 1).alias("addresses_within"),
                                                (F.col("off") * F.col("requests") <= 2 * RANK_ERROR * F.col("requests") + 1).alias("ranks_within"))


add("unique_ips_by_day", lambda df: _daily(df, country="string").unique_ips(df.sparkSession, _FIRST, _LAST),
    f"SELECT country, count(DISTINCT ip) AS unique_ips FROM hits WHERE {_IN_DAYS} GROUP BY country")
add("response_percentiles_by_day", lambda df: _daily(df).percentiles(df.sparkSession, _RANKS),
    f"SELECT {_RANKS_SQL} FROM hits")
add("handler_percentiles_by_day", lambda df: _daily(df, handler="string").percentiles(df.sparkSession, _RANKS, _FIRST, _LAST),
    f"SELECT handler, {_RANKS_SQL} FROM hits WHERE {_IN_DAYS} GROUP BY handler")
add("daily_estimates", _estimates,
    "SELECT handler, count(*) AS requests, true AS addresses_within, true AS ranks_within FROM hits GROUP BY handler")
