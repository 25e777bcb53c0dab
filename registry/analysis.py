"""Queries on bots, performance, API, shop, content, geography, anomalies, exports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from hitscope.functions.fixed_values import AI_BOT_NAMES, API_WORDS, BOT_CATEGORIES, SHOP_CATEGORIES, SHOP_PLATFORMS
from hitscope.functions.user_agents import bot_category, is_ai_bot, legitimacy_score
from hitscope.operators import anomaly as an, api_usage as api, bots as b, commerce as shop, content as ct, geo, performance as pf
from hitscope.operators import timeline as tl, traffic as t
from hitscope.operators.security import threat_events
from hitscope.plans.reports import bot_report
from hitscope.plans.workspace import shared_folder
from hitscope.sinks import files as out

from .base import ERRORS, ORACLES, add, contains_any_sql, is_bot_sql, r, text
from .security import EVENTS, FLAGS
from .traffic import COUNTRIES, PATHS, _timeline_sql, HOUR

# Bots ---------------------------------------------------------------------------
CATEGORY = "CASE " + " ".join(f"WHEN contains(lower(user_agent), {text(w)}) THEN {text(c)}" for w, c in BOT_CATEGORIES.items()) \
    + " WHEN regexp_matches(lower(user_agent), 'bot|crawler|spider') THEN 'generic' ELSE 'unknown' END"
AI = contains_any_sql("lower(user_agent)", AI_BOT_NAMES)
LEGIT = f"""least(100.0, CASE {CATEGORY} WHEN 'search_engine' THEN 95 WHEN 'social_media' THEN 90 WHEN 'monitoring' THEN 85
    WHEN 'ai_llm' THEN 70 WHEN 'security_scanner' THEN 60 WHEN 'generic' THEN 40 ELSE 30 END
    + CASE WHEN regexp_matches(lower(user_agent), 'https?://') THEN 10 ELSE 0 END + CASE WHEN strlen(user_agent) > 100 THEN 5 ELSE 0 END
    + CASE WHEN contains(lower(user_agent), 'compatible') THEN 5 ELSE 0 END)::DOUBLE"""
_SPAN = "(epoch_us(arg_max(ts, seq)) - epoch_us(arg_min(ts, seq))) / 1e6"
BOTS = f"""SELECT user_agent, any_value({CATEGORY}) AS category, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes,
    count(DISTINCT path) AS unique_paths, {_SPAN} AS span,
    CASE WHEN count(*) > 1 THEN {r(_SPAN + " / (count(*) - 1)")} ELSE 0.0 END AS avg_interval,
    any_value({LEGIT}) AS legitimacy_score, any_value({AI}) AS is_ai_bot FROM hits WHERE {is_bot_sql()} GROUP BY user_agent"""


def _bots(build):
    return lambda df: build(b.bot_profile(df))


_agents = lambda df: df.groupBy("user_agent").agg(F.count("*").alias("count"))
add("bot_category", lambda df: _agents(df).withColumn("category", bot_category(F.col("user_agent"))),
    f"SELECT user_agent, count(*) AS count, any_value({CATEGORY}) AS category FROM hits GROUP BY user_agent")
add("is_ai_bot", lambda df: _agents(df).withColumn("is_ai_bot", is_ai_bot(F.col("user_agent"))),
    f"SELECT user_agent, count(*) AS count, any_value({AI}) AS is_ai_bot FROM hits GROUP BY user_agent")
add("legitimacy_score", lambda df: _agents(df).withColumn("legitimacy_score", legitimacy_score(F.col("user_agent"), bot_category(F.col("user_agent")))),
    f"SELECT user_agent, count(*) AS count, any_value({LEGIT}) AS legitimacy_score FROM hits GROUP BY user_agent")
add("bot_stats", _bots(lambda p: b.top_bots(p, None)), f"SELECT * EXCLUDE (span) FROM ({BOTS})")
add("top_bots", _bots(lambda p: b.top_bots(p, 5)), f"SELECT * EXCLUDE (span) FROM ({BOTS}) ORDER BY count DESC, user_agent LIMIT 5")
add("ai_bots", _bots(b.ai_bots), f"SELECT * EXCLUDE (span) FROM ({BOTS}) WHERE is_ai_bot")
add("legitimacy_scores", _bots(b.legitimacy_scores), f"SELECT user_agent, category, legitimacy_score FROM ({BOTS})")
add("bot_summary", b.bot_summary, f"""SELECT count(*) FILTER ({is_bot_sql()}) AS total_bot_requests,
    count(DISTINCT user_agent) FILTER ({is_bot_sql()}) AS unique_bots, {r(f"count(*) FILTER ({is_bot_sql()}) * 100.0 / count(*)")} AS bot_traffic_pct FROM hits""")
_BY_CATEGORY = f"SELECT category, count(*) AS unique_bots, sum(count)::BIGINT AS requests FROM ({BOTS}) GROUP BY category"
add("bots_by_category", _bots(b.bots_by_category), _BY_CATEGORY)
add("bot_category_shares", _bots(b.bot_category_shares), f"SELECT *, {r('requests * 100.0 / sum(requests) OVER ()')} AS percentage FROM ({_BY_CATEGORY})")
_IN_CATEGORY = f"""SELECT category, user_agent, count, bytes, unique_paths, legitimacy_score, is_ai_bot,
    row_number() OVER (PARTITION BY category ORDER BY count DESC, user_agent)::INTEGER AS rank FROM ({BOTS})"""
add("bots_in_category", _bots(lambda p: b.bots_in_category(p, 2)), f"SELECT * FROM ({_IN_CATEGORY}) WHERE rank <= 2")
add("bots_in_category_all", _bots(b.bots_in_category), f"SELECT * EXCLUDE (rank) FROM ({_IN_CATEGORY})")
add("bot_behavior", _bots(b.bot_behavior), f"""WITH x AS (SELECT *, CASE WHEN count > 1 AND span > 0 THEN count / span ELSE 0.0 END AS rps FROM ({BOTS}))
    SELECT user_agent, category, count AS request_count, unique_paths, {r("rps")} AS requests_per_second,
    CASE WHEN rps > 10 THEN 'aggressive' WHEN rps > 1 THEN 'moderate' WHEN unique_paths > 100 THEN 'comprehensive'
    WHEN unique_paths > 10 THEN 'targeted' ELSE 'light' END AS behavior_type FROM x""")
add("bot_share", b.bot_share, f"""SELECT {is_bot_sql()} AS is_bot, count(*) AS count,
    {r("count(*) * 100.0 / (SELECT count(*) FROM hits)")} AS percentage FROM hits GROUP BY 1""")

# Performance ----------------------------------------------------------------------
_AVG, _P95, _RATE = r("avg(response_time)"), r("quantile_cont(response_time, 0.95)"), r(ERRORS + " / count(*)")
_ENDPOINT = f"count(*) AS count, {_AVG} AS avg_response_time, {ERRORS} AS error_count, {_RATE} AS error_rate, {_P95} AS p95_response_time"
add("slowest_endpoints", pf.slowest_endpoints, f"""SELECT * EXCLUDE (m) FROM (SELECT path, {_ENDPOINT}, avg(response_time) AS m
    FROM hits GROUP BY path ORDER BY m DESC, path LIMIT 10)""")
add("all_endpoints", lambda df: pf.slowest_endpoints(df, None), f"SELECT path, {_ENDPOINT} FROM hits GROUP BY path")
add("slow_endpoints", lambda df: pf.slow_endpoints(df, 0.5), f"""SELECT path, count(*) AS count, {_AVG} AS avg_response_time
    FROM hits GROUP BY path HAVING avg(response_time) > 0.5""")
add("handler_stats", pf.handler_stats, f"SELECT handler, {_ENDPOINT}, sum(bytes_sent)::BIGINT AS bytes FROM hits WHERE handler <> '' GROUP BY handler")
_HIT = "status = 304 OR response_time < 0.01"
_CACHE = f"""SELECT handler, count(*) FILTER (handler = 'varnish' AND ({_HIT})) AS hits, count(*) FILTER (handler = 'varnish' AND NOT ({_HIT})) AS misses,
    CASE handler WHEN 'varnish' THEN {r(f"count(*) FILTER ({_HIT}) / count(*)")} ELSE 0.0 END AS hit_rate FROM hits WHERE handler <> '' GROUP BY handler"""
add("cache_stats", pf.cache_stats, _CACHE)
add("cache_stats_handler", lambda df: pf.cache_stats(df, "varnish"), f"SELECT * FROM ({_CACHE}) WHERE handler = 'varnish'")
_ADVICE = """SELECT 'response_time' AS type, 'high' AS priority, 'Average response time is high (>1s)' AS description,
      'User experience degradation' AS impact, 'Optimize database queries, add caching, or scale resources' AS action
    FROM (SELECT avg(response_time) AS a FROM hits) WHERE a > 1
    UNION ALL SELECT 'response_time_p95', 'medium', 'P95 response time is very high (>3s)', 'Poor experience for significant portion of users',
      'Identify and optimize slowest endpoints' FROM (SELECT quantile_cont(response_time, 0.95) AS p FROM hits) WHERE p > 3
    UNION ALL SELECT 'slow_endpoints', 'high', 'Multiple slow endpoints detected', 'Performance bottlenecks affecting user experience',
      'Review and optimize slow endpoints, consider caching' WHERE EXISTS (
      SELECT 1 FROM hits GROUP BY path HAVING avg(response_time) > {limit} AND count(*) > 10)
    UNION ALL SELECT 'cache_hit_rate', 'high', 'Low Varnish cache hit rate (<50%)', 'Increased load on backend, slower response times',
      'Review cache configuration and cache-control headers' FROM (SELECT count(*) AS n, count(*) FILTER (status = 304 OR response_time < 0.01) AS h
      FROM hits WHERE handler = 'varnish') WHERE n > 100 AND h / n < 0.5
    UNION ALL SELECT 'handler_errors', 'critical', 'High error rate for handler: ' || handler, 'Service reliability issues',
      'Investigate and fix errors in ' || handler FROM hits WHERE handler <> '' GROUP BY handler
      HAVING count(*) > 100 AND count(*) FILTER (status >= 400) / count(*) > 0.1"""
add("perf_recommendations", pf.perf_recommendations, _ADVICE.replace("{limit}", "1.0"))
add("perf_recommendations_slow", lambda df: pf.perf_recommendations(df.withColumn("response_time", F.col("response_time") * 4), 0.4),
    "WITH hits4 AS (SELECT * REPLACE (response_time * 4 AS response_time) FROM hits) "
    + _ADVICE.replace("{limit}", "0.4").replace("FROM hits", "FROM hits4"))



def _report_sizes(df):
    parts = [part.agg(F.count("*").alias("rows")).withColumn("part", F.lit(name)) for name, part in pf.performance_report(df).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


add("performance_report", _report_sizes, f"""SELECT 'response_time_stats' AS part, 1::BIGINT AS rows
    UNION ALL SELECT 'handler_stats', count(DISTINCT nullif(handler, '')) FROM hits
    UNION ALL SELECT 'slowest_endpoints', least(10, count(DISTINCT path)) FROM hits
    UNION ALL SELECT 'recommendations', count(*) FROM ({_ADVICE.replace("{limit}", "1.0")})""")

# API ----------------------------------------------------------------------------------
_API = contains_any_sql("lower(path)", API_WORDS)
_PLATFORM = """CASE WHEN regexp_matches(lower(path), 'wp-json|wc-api') THEN 'woocommerce'
    WHEN regexp_matches(lower(path), '/rest/v1|/graphql') AND regexp_matches(lower(path), 'magento|/rest/v[0-9]+/') THEN 'magento'
    WHEN regexp_matches(lower(path), 'store-api|/api/') AND contains(lower(path), 'shopware') THEN 'shopware'
    WHEN contains(lower(path), 'prestashop') THEN 'prestashop' ELSE 'generic' END"""
add("is_api_request", lambda df: api.api_hits(df).select("seq", "path"), f"SELECT seq, path FROM hits WHERE {_API}")
add("api_platform", lambda df: api.api_hits(df).select("seq", api.api_platform(F.col("path")).alias("platform")),
    f"SELECT seq, {_PLATFORM} AS platform FROM hits WHERE {_API}")
_PLATFORMS = f"SELECT {_PLATFORM} AS platform, count(*) AS count FROM hits WHERE {_API} GROUP BY 1"
add("api_platforms", api.api_platforms, _PLATFORMS)
add("primary_platform", api.primary_platform, _PLATFORMS + " ORDER BY count DESC, platform LIMIT 1")
_ENDPOINTS = f"SELECT method, path, {_ENDPOINT} FROM hits WHERE {_API} GROUP BY method, path"
add("api_endpoints", api.api_endpoints, _ENDPOINTS + " ORDER BY count DESC, method, path LIMIT 20")
add("api_endpoint_statuses", api.api_endpoint_statuses, f"""WITH lead AS ({_ENDPOINTS} ORDER BY count DESC, method, path LIMIT 20)
    SELECT method, path, status, count(*) AS count FROM hits WHERE (method, path) IN (SELECT (method, path) FROM lead) GROUP BY ALL""")
add("endpoint_details", lambda df: api.endpoint_details(df, "GET /rest/V1/products/1"),
    f"SELECT * FROM ({_ENDPOINTS}) WHERE contains(method || ' ' || path, 'GET /rest/V1/products/1')")
add("graphql_ops", api.graphql_ops, f"""SELECT CASE WHEN contains(path || ' ' || referer, 'IntrospectionQuery') THEN 'IntrospectionQuery'
    WHEN contains(path || ' ' || referer, 'GetProduct') THEN 'GetProduct' ELSE 'unknown' END AS operation, count(*) AS count,
    {_AVG} AS avg_response_time, {ERRORS} AS error_count FROM hits WHERE {_API} AND contains(lower(path), 'graphql') GROUP BY 1""", True)
add("api_summary", api.api_summary, f"""SELECT count(*) AS total_api_requests, count(DISTINCT (method, path)) AS unique_endpoints,
    {_RATE} AS error_rate, {_AVG} AS avg_response_time,
    (SELECT platform FROM ({_PLATFORMS}) ORDER BY count DESC, platform LIMIT 1) AS platform FROM hits WHERE {_API}""")

# Shop -----------------------------------------------------------------------------------
_SHOP = "CASE " + " ".join(f"WHEN {contains_any_sql('lower(path)', [w.lower() for w in words])} THEN {text(name)}"
                           for name, words in SHOP_PLATFORMS.items()) + " END"
_FIRST = f"(SELECT seq AS first_seq, p AS platform FROM (SELECT seq, {_SHOP} AS p FROM hits) WHERE p IS NOT NULL ORDER BY seq LIMIT 1)"
_COMMON = " ".join(f"WHEN {contains_any_sql('lower(path)', words)} THEN {text(c)}" for c, words in SHOP_CATEGORIES)
CATEGORIZED = f"""(SELECT *, CASE {_COMMON}
    WHEN shop = 'magento' AND regexp_matches(lower(path), '/rest/v1/|/graphql') THEN 'api'
    WHEN shop = 'magento' AND contains(lower(path), 'customer/section/load') THEN 'customer_section'
    WHEN shop = 'woocommerce' AND contains(lower(path), 'wc-ajax') THEN 'ajax'
    WHEN shop = 'woocommerce' AND contains(lower(path), 'wp-json/wc') THEN 'api'
    WHEN shop = 'shopware' AND contains(lower(path), 'store-api') THEN 'api'
    WHEN shop = 'shopware' AND contains(lower(path), '/account') THEN 'account' END AS category
    FROM (SELECT hits.*, CASE WHEN seq >= first_seq THEN platform END AS shop FROM hits, {_FIRST}))"""
add("detect_shop_platform", shop.detect_shop_platform, f"SELECT platform, first_seq FROM {_FIRST}")
add("request_category", lambda df: shop.categorize(df).select("seq", "category"), f"SELECT seq, category FROM {CATEGORIZED}")
_SHOP_STATS = f"count(*) AS count, {_AVG} AS avg_response_time, {ERRORS} AS error_count"
add("category_stats", shop.category_stats, f"SELECT category, {_SHOP_STATS}, {_RATE} AS error_rate FROM {CATEGORIZED} WHERE category IS NOT NULL GROUP BY category")
add("shop_summary", shop.shop_summary, f"SELECT count(category) AS total_requests, (SELECT platform FROM {_FIRST}) AS platform FROM {CATEGORIZED}")
add("funnel", shop.funnel, f"""SELECT *, {r("1 - orders / product_views")} AS drop_off_rate FROM (
    SELECT count(*) FILTER (category = 'product') AS product_views, count(*) FILTER (category = 'cart') AS cart_adds,
    count(*) FILTER (category = 'checkout') AS checkouts, count(*) FILTER (category = 'order') AS orders FROM {CATEGORIZED} WHERE status < 400)""")
add("checkout_errors", shop.checkout_errors, f"""SELECT path, count(*) AS count, 'checkout_error' AS error_type FROM {CATEGORIZED}
    WHERE category = 'checkout' AND status >= 400 GROUP BY path""")
# The first shop record decides the platform.  So that the GraphQL bucket is
# used, GraphQL requests arrive before all others; every record stays.
def _graphql_first(df):
    return df.withColumn("seq", F.when(F.col("path").contains("/graphql"), F.col("seq") - 10**12).otherwise(F.col("seq")))


add("shop_graphql", lambda df: shop.shop_graphql(_graphql_first(df)), f"""SELECT 'graphql_query' AS operation, {_SHOP_STATS} FROM hits
    WHERE contains(lower(path), 'graphql')""")
add("category_stats_magento", lambda df: shop.category_stats(_graphql_first(df)),
    f"""WITH h AS (SELECT *, CASE {_COMMON} WHEN regexp_matches(lower(path), '/rest/v1/|/graphql') THEN 'api' END AS category FROM hits)
    SELECT category, {_SHOP_STATS}, {_RATE} AS error_rate FROM h WHERE category IS NOT NULL GROUP BY category""")

# Content ----------------------------------------------------------------------------------
EXT = "lower(regexp_extract(path, '([.][^./]*)$', 1))"
RESOURCES = f"(SELECT * FROM (SELECT *, {EXT} AS extension FROM hits) WHERE extension <> '')"
_KIND = """CASE WHEN extension IN ('.jpg', '.jpeg', '.png', '.gif', '.webp', '.svg', '.ico') THEN 'image'
    WHEN extension IN ('.js', '.jsx', '.ts', '.tsx') THEN 'script' WHEN extension IN ('.css', '.scss', '.sass', '.less') THEN 'style'
    WHEN extension IN ('.mp4', '.webm', '.mp3', '.ogg', '.wav') THEN 'media'
    WHEN extension IN ('.pdf', '.doc', '.docx', '.xls', '.xlsx') THEN 'document' ELSE 'other' END"""
_MIME = """CASE extension WHEN '.html' THEN 'text/html' WHEN '.css' THEN 'text/css' WHEN '.js' THEN 'application/javascript'
    WHEN '.json' THEN 'application/json' WHEN '.xml' THEN 'application/xml' WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg'
    WHEN '.png' THEN 'image/png' WHEN '.gif' THEN 'image/gif' WHEN '.webp' THEN 'image/webp' WHEN '.svg' THEN 'image/svg+xml'
    WHEN '.pdf' THEN 'application/pdf' WHEN '.zip' THEN 'application/zip' ELSE 'application/octet-stream' END"""
add("extension", lambda df: df.select("seq", ct.extension(F.col("path")).alias("extension")), f"SELECT seq, {EXT} AS extension FROM hits")
add("extension_stats", ct.extension_stats, f"""SELECT extension, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes, {_AVG} AS avg_response_time
    FROM {RESOURCES} GROUP BY extension""")
add("resource_categories", ct.resource_categories, f"SELECT {_KIND} AS category, count(*) AS count FROM {RESOURCES} GROUP BY 1")
add("content_types", ct.content_types, f"SELECT {_MIME} AS content_type, count(*) AS count FROM {RESOURCES} GROUP BY 1")
add("content_summary", ct.content_summary, f"SELECT count(*) AS total_resources FROM {RESOURCES}")
add("seo_issues", ct.seo_issues, f"""SELECT * FROM (
    SELECT 'large_images' AS type, count(*) FILTER ({_KIND} = 'image' AND bytes_sent > 512000) AS count, 'medium' AS severity,
      'Images larger than 500KB detected - consider optimization' AS description FROM {RESOURCES}
    UNION ALL SELECT 'broken_links', count(*) FILTER (status = 404), 'high', '404 errors detected - broken links affect SEO' FROM {RESOURCES}
    UNION ALL SELECT 'slow_resources', count(*) FILTER (response_time > 2), 'medium', 'Slow loading resources detected - impacts page speed' FROM {RESOURCES}
    ) WHERE count > 0""")

# Geography -----------------------------------------------------------------------------------
_GEO = f"""WITH {FLAGS}, e AS (SELECT country, count(*) AS threats FROM {EVENTS} GROUP BY country),
    g AS (SELECT c.*, coalesce(threats, 0) AS threat_count, (error_count + coalesce(threats, 0) * 10) / count * 100 AS score
    FROM ({COUNTRIES}) c LEFT JOIN e USING (country))"""
add("geo_summary", geo.geo_summary, f"{_GEO} SELECT * EXCLUDE (threat_count, score), {r('score')} AS threat_score FROM g ORDER BY count DESC, country LIMIT 20", True)
add("country_threats", lambda df: geo.country_threats(threat_events(df)),
    f"WITH {FLAGS} SELECT country, count(*) AS threat_count FROM {EVENTS} WHERE country <> '' GROUP BY country", True)
add("threat_map", geo.threat_map, f"{_GEO} SELECT country, {r('score')} AS threat_score, threat_count, count AS request_count FROM g", True)

# Anomalies: the first three weeks are the baseline of the rest ----------------------------------
SPLIT = dt.datetime(2024, 1, 22)
_METRICS = """(SELECT date_trunc('hour', ts) AS bucket, count(*)::DOUBLE AS requests, count(*) FILTER (status >= 400) / count(*) AS error_rate,
    avg(response_time) AS response_time FROM hits WHERE ts {op} TIMESTAMP '""" + str(SPLIT) + "' GROUP BY 1)"


def _base_sql(rounding) -> str:
    return "(SELECT " + ", ".join(f"{rounding(f'avg({m})')} AS avg_{m}, {rounding(f'stddev_pop({m})')} AS stddev_{m}"
                                  for m in ("requests", "error_rate", "response_time")) + f" FROM {_METRICS.replace('{op}', '<')})"


_TEXTS = {"traffic_spike": ("requests", "Unusual traffic volume detected"), "error_rate": ("error_rate", "Unusual error rate detected"),
          "response_time": ("response_time", "Unusual response time detected")}


def _anomalies_sql(limit: float) -> str:
    parts = [f"""SELECT bucket, {text(k)} AS type, {text(d)} AS description, {m} AS value, avg_{m} AS expected,
        ({m} - avg_{m}) / stddev_{m} AS z FROM {_METRICS.replace("{op}", ">=")}, {_base_sql(str)} WHERE stddev_{m} <> 0""" for k, (m, d) in _TEXTS.items()]
    return f"""(SELECT bucket, type, description, {r("value")} AS value, {r("expected")} AS expected, {r("z")} AS z_score,
        CASE WHEN abs(z) >= 5 THEN 'critical' WHEN abs(z) >= 4 THEN 'high' WHEN abs(z) >= 3 THEN 'medium' ELSE 'low' END AS severity
        FROM ({" UNION ALL ".join(parts)}) WHERE z > {limit} OR (type = 'traffic_spike' AND z < -{limit}))"""


def _before(df):
    return df.where(F.col("ts") < F.lit(str(SPLIT)).cast("timestamp_ntz"))


def _after(df):
    return df.where(F.col("ts") >= F.lit(str(SPLIT)).cast("timestamp_ntz"))


def _found(df, limit=2.0):
    return an.detect_anomalies(_after(df), an.baseline(_before(df), "1 hour"), limit, "1 hour")


add("baseline", lambda df: an.baseline(_before(df), "1 hour"), f"SELECT * FROM {_base_sql(r)}")


def _merged_baseline(df):
    """A state for each of three sets of days, then one baseline of all days."""
    days = [_before(df).where(F.dayofmonth("ts") % 3 == k) for k in range(3)]
    states = [an.baseline_state(day, "1 hour") for day in days]
    return an.merge_baselines(reduce(lambda a, b: a.unionByName(b), states))


add("baseline_merged", _merged_baseline, f"SELECT * FROM {_base_sql(r)}")
add("detect_anomalies", _found, f"SELECT * FROM {_anomalies_sql(2.0)}")
add("detect_anomalies_default", lambda df: _found(df, 0), f"SELECT * FROM {_anomalies_sql(3.0)}")
add("severity", lambda df: _found(df).select("bucket", "type", "severity"), f"SELECT bucket, type, severity FROM {_anomalies_sql(2.0)}")
add("anomaly_summary", lambda df: an.anomaly_summary(_found(df)), f"SELECT type, severity, count(*) AS count FROM {_anomalies_sql(2.0)} GROUP BY ALL")
add("anomaly_count", lambda df: an.anomaly_count(_found(df)), f"SELECT count(*) AS total_anomalies FROM {_anomalies_sql(2.0)}")

# Exports: the rows and lines that the writers store -----------------------------------------------
_TOTALS = f"""totals AS (SELECT count(*) AS n, count(DISTINCT ip) AS ips, count(DISTINCT nullif(country, '')) AS countries, sum(bytes_sent)::BIGINT AS bytes,
    avg(response_time) AS a, median(response_time) AS m, quantile_cont(response_time, 0.95) AS p95, quantile_cont(response_time, 0.99) AS p99,
    {ERRORS} * 100.0 / count(*) AS e, count(*) FILTER ({is_bot_sql()}) AS bots FROM hits)"""
_METRIC_ROWS = (("Total Requests", "n::VARCHAR"), ("Unique IPs", "ips::VARCHAR"), ("Unique Countries", "countries::VARCHAR"),
                ("Total Bytes", "bytes::VARCHAR"), ("Avg Response Time", "printf('%.3f', a)"), ("Median Response Time", "printf('%.3f', m)"),
                ("P95 Response Time", "printf('%.3f', p95)"), ("P99 Response Time", "printf('%.3f', p99)"),
                ("Error Rate", "printf('%.2f%%', e)"), ("Bot Traffic", "bots::VARCHAR"), ("Human Traffic", "(n - bots)::VARCHAR"))
add("summary_csv", lambda df: out.summary_metrics(t.traffic_summary(df)), f"WITH {_TOTALS} " + " UNION ALL ".join(
    f"SELECT {i + 1} AS position, {text(m)} AS metric, {v} AS value FROM totals" for i, (m, v) in enumerate(_METRIC_ROWS)))
add("timeline_csv", lambda df: out.timeline_rows(tl.timeline(df, "1 hour")), f"""SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS "Timestamp",
    count AS "Count", bytes AS "Bytes", unique_ips AS "UniqueIPs", error_count AS "ErrorCount" FROM ({_timeline_sql(HOUR)})""")
add("json_export", lambda df: out.json_lines(t.status_counts(df)),
    """SELECT '{"status":' || status || ',"count":' || count(*) || '}' AS value FROM hits GROUP BY status""")
_LINES = (("═" * 47, None), ("          LOG ANALYSIS REPORT                 ", None), ("═" * 47, None), ("", None), ("OVERALL STATISTICS", None),
          ("─" * 45, None), (None, "'Total Requests:      ' || n"), (None, "'Unique IPs:          ' || ips"), (None, "'Unique Countries:    ' || countries"),
          (None, "printf('Total Bytes:         %.2f MB', bytes / 1048576)"), (None, "printf('Bot Traffic:         %d (%.1f%%)', bots, bots * 100.0 / n)"),
          (None, "printf('Human Traffic:       %d (%.1f%%)', n - bots, (n - bots) * 100.0 / n)"), ("", None), ("PERFORMANCE METRICS", None), ("─" * 45, None),
          (None, "printf('Avg Response Time:   %.3fs', a)"), (None, "printf('Median Response Time: %.3fs', m)"), (None, "printf('P95 Response Time:   %.3fs', p95)"),
          (None, "printf('P99 Response Time:   %.3fs', p99)"), (None, "printf('Error Rate:          %.2f%%', e)"), ("", None))
_HEAD = " UNION ALL ".join(f"SELECT 1 AS section, {i} AS position, {text(c) if v is None else v} AS line FROM totals" for i, (c, v) in enumerate(_LINES))
_TITLES = " UNION ALL ".join(f"SELECT {s}, {i}, {text(line)}" for s, title in ((2, "TOP PATHS"), (3, "TOP COUNTRIES"), (4, "STATUS CODE DISTRIBUTION"))
                             for i, line in enumerate((title, "─" * 45)))
add("text_report", out.report_lines, f"""WITH {_TOTALS} {_HEAD} UNION ALL {_TITLES}
    UNION ALL SELECT 2, (k + 1)::INTEGER, printf('%2d. %s (%d requests)', k, path, count) FROM (
      SELECT *, row_number() OVER (ORDER BY count DESC, path) AS k FROM ({PATHS})) WHERE k <= 10
    UNION ALL SELECT 3, (k + 1)::INTEGER, printf('%2d. %s (%d requests, %d IPs)', k, country, count, unique_ips) FROM (
      SELECT *, row_number() OVER (ORDER BY count DESC, country) AS k FROM ({COUNTRIES})) WHERE k <= 10
    UNION ALL SELECT 4, (row_number() OVER (ORDER BY c DESC, status::VARCHAR) + 1)::INTEGER, printf('%d: %d (%.1f%%)', status, c, c * 100.0 / (SELECT n FROM totals))
      FROM (SELECT status, count(*) AS c FROM hits GROUP BY status)""")

# Report documents: written, read again, one row for each value --------------------------------------
_DOCUMENT_NAMES = {"handler_stats": "handler", "slowest_endpoints": "path", "recommendations": "type"}


def _document_rows(df, reports):
    folder = shared_folder(df.sparkSession, "documents")
    out.write_reports(reports, folder)

    def rows(part, frame):
        name = _DOCUMENT_NAMES.get(part)

        def entry(column, kind):
            shown = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS") if kind.startswith("timestamp") else F.col(column)
            is_text = kind.startswith(("timestamp", "string"))
            return F.struct(F.lit(column).alias("metric"), (F.lit(None) if is_text else F.col(column)).cast("double").alias("value"),
                            (shown if is_text else F.lit(None)).cast("string").alias("text"))

        read = df.sparkSession.read.schema(frame.schema).json(f"{folder}/{part}")
        entries = F.explode(F.array(*[entry(c, kind) for c, kind in frame.dtypes if c != name]))
        return read.select(F.lit(part).alias("part"), (F.col(name) if name else F.lit("")).alias("name"), entries.alias("e")).select("part", "name", "e.*")

    return reduce(lambda a, b: a.unionByName(b), [rows(part, frame) for part, frame in reports.items()])


def _document_sql(parts):
    """``parts``: part -> (SQL of its rows, columns of numbers, of texts, of times)."""
    def rows(part, sql, numbers, texts, times):
        name = _DOCUMENT_NAMES.get(part, "''")
        shown = [(c, f"{c}::DOUBLE", "NULL::VARCHAR") for c in numbers.split()] + [(c, "NULL::DOUBLE", c) for c in texts.split()] \
            + [(c, "NULL::DOUBLE", f"strftime({c}, '%Y-%m-%d %H:%M:%S.%g')") for c in times.split()]
        return " UNION ALL ".join(f"SELECT {text(part)} AS part, {name} AS name, {text(c)} AS metric, {v} AS value, {t} AS text FROM {part}_rows" for c, v, t in shown)

    return "WITH " + ", ".join(f"{part}_rows AS ({sql})" for part, (sql, *_) in parts.items()) + " " + " UNION ALL ".join(
        rows(part, *columns) for part, columns in parts.items())


_EACH = "count avg_response_time error_count error_rate p95_response_time"
add("performance_documents", lambda df: _document_rows(df, pf.performance_report(df)), _document_sql({
    "response_time_stats": (ORACLES["response_time_stats"], "total mean min max stddev median p50 p75 p90 p95 p99", "", ""),
    "handler_stats": (ORACLES["handler_stats"], _EACH + " bytes", "", ""),
    "slowest_endpoints": (ORACLES["slowest_endpoints"], _EACH, "", ""),
    "recommendations": (_ADVICE.replace("{limit}", "1.0"), "", "priority description impact action", "")}))
add("summary_document", lambda df: _document_rows(df, {"summary": t.traffic_summary(df)}), _document_sql({
    "summary": (ORACLES["traffic_summary"], "total_requests unique_ips unique_countries total_bytes avg_response_time median_response_time p95_response_time "
                "p99_response_time bot_traffic human_traffic total_errors error_rate", "", "start_time end_time")}))
_BOT = "count bytes unique_paths avg_interval legitimacy_score is_ai_bot"
_DOCUMENT_NAMES.update({"categories": "category", "top_bots": "user_agent", "ai_bots": "user_agent", "behavior": "user_agent"})
add("bot_documents", lambda df: _document_rows(df, bot_report(df, b.bot_profile(df))), _document_sql({
    "summary": (ORACLES["bot_summary"], "total_bot_requests unique_bots bot_traffic_pct", "", ""),
    "categories": (ORACLES["bot_category_shares"], "unique_bots requests percentage", "", ""),
    "top_bots": (ORACLES["bot_stats"] + " ORDER BY count DESC, user_agent LIMIT 10", _BOT, "category", ""),
    "ai_bots": (ORACLES["ai_bots"], _BOT, "category", ""),
    "behavior": (ORACLES["bot_behavior"], "request_count unique_paths requests_per_second", "category behavior_type", "")}))
