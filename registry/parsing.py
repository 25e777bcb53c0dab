"""Queries on sources and normalization.

Raw lines are derived from the view: each event gives one well-formed line,
one blank line and one that is cut off.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hitscope.functions import status as st
from hitscope.functions.times import float_prefix, int_prefix, parse_time
from hitscope.functions.addresses import with_address
from hitscope.functions.user_agents import BROWSER_RULES, MOBILE_WORDS, OS_RULES, is_bot, parse_user_agent
from hitscope.plans.workspace import shared_folder
from hitscope.schema import RAW_JSON
from hitscope.sources import days, lines as ln, records

from .base import add, add_raw, contains_any_sql, is_bot_sql, text
from .view import hits

AS_OF = dt.date(2024, 1, 15)
DEFAULT_TS = "2024-02-01 00:00:00"


def _time_text() -> Column:
    """The event time in one of the seven accepted layouts."""
    ts = F.col("ts").cast("timestamp")
    later = ts + F.expr("INTERVAL 2 HOURS")
    unix = F.unix_timestamp(ts).cast("string")
    layouts = [
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.concat(F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.concat(F.date_format(later, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200")),
        unix,
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.concat(unix, F.lit(".900")),
    ]
    chain = F.lit(None).cast("string")
    for i, layout in enumerate(layouts):
        chain = F.when(F.col("seq") % 7 == i, layout).otherwise(chain)
    return chain


TIME_SQL = "CASE WHEN seq % 7 < 2 THEN ts ELSE date_trunc('second', ts) END"


def _address_text() -> Column:
    ip = F.col("ip")
    return (F.when(F.col("seq") % 19 == 0, F.lit("-"))
            .when(F.col("seq") % 19 == 1, F.concat(F.lit("2001:0DB8:0:0::00"), F.hex(F.col("seq") % 255 + 1)))
            .when(F.col("seq") % 19 == 2, F.concat(F.lit("::FFFF:"), ip))
            .when(F.col("seq") % 19 == 3, F.concat(ip, F.lit(".junk")))
            .when(F.col("seq") % 3 == 0, F.concat(ip, F.lit(", 10.0.0.1"))).otherwise(ip))


ADDRESS_SQL = ("CASE WHEN seq % 19 IN (0, 3) THEN '<nil>' "
               "WHEN seq % 19 = 1 THEN '2001:db8::' || lower(to_hex(seq % 255 + 1)) ELSE ip END")


def json_line() -> Column:
    number = F.when(F.col("seq") % 2 == 0, F.col("status").cast("string")).otherwise(
        F.concat(F.lit('"'), F.col("status").cast("string"), F.lit('abc"')))
    rest = F.to_json(F.struct(
        _time_text().alias("time"), _address_text().alias("remote_addr"),
        F.concat(F.col("method"), F.lit(" "), F.col("path"), F.lit(" HTTP/1.1")).alias("request"),
        F.col("bytes_sent").alias("body_bytes_sent"), F.col("response_time").cast("string").alias("request_time"),
        "user_agent", "country", "handler", "referer", F.lit("shop.example").alias("host")))
    return F.concat(F.lit('{"status":'), number, F.lit(","), F.substring(rest, 2, 1 << 30))


def tsv_line() -> Column:
    return F.concat_ws("\t", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), "ip", "method", "path",
                       F.col("status").cast("string"), F.col("bytes_sent").cast("string"),
                       F.col("response_time").cast("string"), "user_agent", "country", "handler")


def column_line() -> Column:
    return F.concat(F.col("status").cast("string"), F.lit("  "), F.format_string("%.4f", "response_time"), F.lit(" "),
                    F.when(F.col("country") == "", "--").otherwise(F.col("country")), F.lit(" "), F.col("ip"),
                    F.lit("  "), F.col("method"), F.lit(" "), F.col("path"), F.lit(" HTTP/1.1"))


def raw_lines(df: DataFrame, line: Column) -> DataFrame:
    """(seq, value): the line, a blank one and a truncated one per event."""
    cut = F.when(line.startswith("{"), F.expr("substring(_l, 1, length(_l) - 1)")).otherwise(F.lit("bad line"))
    return df.withColumn("_l", line).select("seq", F.explode(F.array("_l", F.lit("  "), cut.alias("_c"))).alias("value"))


def _with_referer(build):
    return lambda spark, sf: build(hits(spark, sf, True))


_FIELDS = ["seq", "ts", "ip", "method", "path", "status", "bytes_sent", "response_time", "user_agent", "is_bot",
           "country", "handler", "referer"]


def _flat(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "ts" else F.col(c) for c in (*_FIELDS, *more)])


JSON_SQL = f"""SELECT seq, {TIME_SQL} AS ts, {ADDRESS_SQL} AS ip, method, path, status, bytes_sent,
 round(response_time, 9) AS response_time, user_agent, {is_bot_sql()} AS is_bot, country, handler, referer"""

add_raw("parse_json", _with_referer(lambda df: _flat(records.parse_json(raw_lines(df, json_line())), "host", "ts_defaulted")),
        JSON_SQL + ", 'shop.example' AS host, false AS ts_defaulted FROM hits", True)

def _whole_record(df: DataFrame) -> DataFrame:
    read = df.select("seq", F.explode(F.array(F.from_json(json_line(), RAW_JSON))).alias("record"))
    out = records.normalize(read, default_ts=F.lit(DEFAULT_TS).cast("timestamp"), keep=("seq",))
    return out.select("seq", *[F.col(c).cast("timestamp_ntz").alias(c) if c == "ts" else F.col(c) for c in out.columns
                               if c not in ("seq", "ua")], F.col("ua.device").alias("device"))


add_raw("normalize", _with_referer(_whole_record),
        JSON_SQL + f""", false AS ts_defaulted, 'shop.example' AS host, '' AS server_name, '' AS port, '' AS ssl_protocol, '' AS ssl_cipher,
        '' AS remote_user, CASE WHEN user_agent IN ('', '-') THEN 'Unknown' WHEN {contains_any_sql('user_agent', MOBILE_WORDS)} THEN 'Mobile'
        WHEN {is_bot_sql()} THEN 'Bot' ELSE 'Desktop' END AS device FROM hits""", True)

add_raw("rejected_json", _with_referer(lambda df: records.rejected_json(raw_lines(df, json_line()))),
        "SELECT unnest(['accepted', 'blank', 'malformed']) AS outcome, n AS count FROM (SELECT count(*) AS n FROM hits)", True)

TSV_SQL = f"""SELECT seq, date_trunc('second', ts) AS ts, ip, method, path, status, bytes_sent,
 round(response_time, 9) AS response_time, user_agent,
 {contains_any_sql("lower(user_agent)", ("bot", "crawler", "spider"))} AS is_bot, country, handler, '' AS referer FROM hits"""

add("parse_tsv", lambda df: _flat(records.parse_tsv(raw_lines(df, tsv_line()))), TSV_SQL)

COLUMNS_SQL = f"""SELECT seq, TIMESTAMP {text(DEFAULT_TS)} AS ts, ip, method, path, status, 0::BIGINT AS bytes_sent,
 round(response_time, 4) AS response_time, '' AS user_agent, false AS is_bot,
 CASE country WHEN '' THEN '--' ELSE country END AS country, '' AS handler, '' AS referer FROM hits"""

add("parse_columns", lambda df: _flat(records.parse_columns(raw_lines(df, column_line()), F.lit(DEFAULT_TS).cast("timestamp"))),
    COLUMNS_SQL)

_MIXED = lambda: F.when(F.col("seq") % 3 == 0, json_line()).when(F.col("seq") % 3 == 1, tsv_line()).otherwise(column_line())
add_raw("parse_mixed", _with_referer(lambda df: _flat(records.parse_mixed(raw_lines(df, _MIXED()), F.lit(DEFAULT_TS).cast("timestamp")))),
        f"""SELECT * FROM ({JSON_SQL} FROM hits) WHERE seq % 3 = 0
        UNION ALL SELECT * FROM ({TSV_SQL}) WHERE seq % 3 = 1 UNION ALL SELECT * FROM ({COLUMNS_SQL}) WHERE seq % 3 = 2""", True)


def _through_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as gzip and as plain text, discovered, read back and counted."""
    base = shared_folder(spark, "logs")
    df = hits(spark, sf_dir, True)
    lines = raw_lines(df, json_line()).select("seq", "value")
    lines.where("seq % 2 = 0").select("value").write.text(f"{base}/nginx/access.log-a", compression="gzip")
    lines.where("seq % 2 = 1").select("value").write.text(f"{base}/nginx/access.log-b")
    read = records.read_access_log(spark, [f"{base}/nginx/access.log-a", f"{base}/nginx/access.log-b"])
    return read.groupBy("method", "status", F.col("seq.source").alias("source")).agg(
        F.count("*").alias("count"), F.sum("bytes_sent").alias("bytes"))


add_raw("read_access_log", _through_files,
        """SELECT method, status, (seq % 2)::INTEGER AS source, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes
        FROM hits GROUP BY ALL""", True)

def _discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in three places, found by their names, and the lines of each place."""
    base = shared_folder(spark, "logs")
    lines = hits(spark, sf_dir, True).select("seq", json_line().alias("value"))
    places = ["access.log.1", "nginx/access.log", "nginx/shop/access.log-old"]
    for i, place in enumerate(places):
        lines.where(F.col("seq") % 3 == i).select("value").write.text(f"{base}/{place}")
    place = F.regexp_extract("file_path", "/((nginx/)?(shop/)?access[.]log[^/]*)/", 1).alias("place")
    found = ln.discover_logs(spark, base).select(place).distinct()
    read = ln.read_lines(spark, [f"{base}/{p}" for p in places]).groupBy(place).agg(F.count("*").alias("line_count"))
    return found.join(read, "place")


add_raw("discover_logs", _discovered, """SELECT ['access.log.1', 'nginx/access.log', 'nginx/shop/access.log-old'][seq % 3 + 1] AS place,
    count(*) AS line_count FROM hits GROUP BY 1""", True)


# Lines with file attributes, as the file reader gives them.
def _file_lines(df: DataFrame) -> DataFrame:
    return df.withColumn("_l", json_line()).select(
        "seq", F.explode(F.array("_l", F.lit("broken"))).alias("value"),
        F.concat(F.lit("/logs/access.log."), F.dayofmonth("ts").cast("string"), F.lit(".gz")).alias("file_path"),
        F.lit(1).cast("bigint").alias("file_size"), F.date_trunc("day", "ts").alias("file_time"))


add_raw("file_profile", _with_referer(lambda df: ln.file_profile(_file_lines(df)).withColumns(
            {c: F.col(c).cast("timestamp_ntz") for c in ("file_time", "first_entry", "last_entry")})),
        f"""SELECT '/logs/access.log.' || day(ts) || '.gz' AS file_path, 1::BIGINT AS file_size,
        max(date_trunc('day', ts))::TIMESTAMP AS file_time, 2 * count(*) AS line_count,
        min_by({TIME_SQL}, seq) AS first_entry, max_by({TIME_SQL}, seq) AS last_entry, true AS is_gzipped
        FROM hits GROUP BY day(ts)""", True)

add_raw("last_n", _with_referer(lambda df: records.parse_json(
            ln.last_n(df.select("seq", json_line().alias("value")), 100)).select("seq", "path", "status")),
        "SELECT seq, path, status FROM hits ORDER BY seq DESC LIMIT 100", True)

for _name, _ago in (("select_today", 0), ("select_yesterday", 1), ("select_day", 5)):
    add(_name, lambda df, ago=_ago: days.select_day(df, AS_OF, ago).select("seq", "ts", "path"),
        f"SELECT seq, ts, path FROM hits WHERE ts::DATE = DATE '{AS_OF - dt.timedelta(days=_ago)}'")
add("select_history", lambda df: days.select_history(df, AS_OF).groupBy("day_offset").agg(F.count("*").alias("count")),
    f"""SELECT date_diff('day', ts::DATE, DATE '{AS_OF}')::INTEGER AS day_offset, count(*) AS count FROM hits
    WHERE ts::DATE BETWEEN DATE '{AS_OF - dt.timedelta(days=7)}' AND DATE '{AS_OF - dt.timedelta(days=1)}' GROUP BY 1""")

# Normalization, one aspect each.
add("parse_timestamps", lambda df: df.select("seq", parse_time(_time_text()).cast("timestamp_ntz").alias("parsed")),
    f"SELECT seq, {TIME_SQL} AS parsed FROM hits")
add("parse_addresses", lambda df: with_address(df, _address_text(), "address").select("seq", "address"),
    f"SELECT seq, {ADDRESS_SQL} AS address FROM hits")


def _split(df: DataFrame) -> DataFrame:
    request = F.when(F.col("seq") % 5 == 0, F.col("method")).when(F.col("seq") % 5 == 1, F.lit("")).when(
        F.col("seq") % 5 == 2, F.lit(None)).otherwise(F.concat_ws(" ", "method", "path", F.lit("HTTP/1.1")))
    method, path = records.split_request(request)
    return df.select("seq", method.alias("m"), path.alias("p"))


add("split_requests", _split, """SELECT seq, CASE WHEN seq % 5 < 2 THEN 'GET' WHEN seq % 5 = 2 THEN '' ELSE method END AS m,
    CASE WHEN seq % 5 < 2 THEN '/' WHEN seq % 5 = 2 THEN '' ELSE path END AS p FROM hits""")
add("coerce_numbers", lambda df: df.select(
        "seq", int_prefix(F.concat(F.lit(" "), F.col("status").cast("string"), F.lit("x1"))).alias("whole"),
        int_prefix(F.concat((F.col("bytes_sent") / 10).cast("decimal(20,1)").cast("string"))).alias("truncated"),
        float_prefix(F.concat(F.format_string("%.4f", "response_time"), F.lit("s"))).alias("number")),
    """SELECT seq, status::BIGINT AS whole, bytes_sent // 10 AS truncated, round(response_time, 4) AS number FROM hits""")
add("bot_flags", lambda df: df.groupBy("user_agent").agg(F.count("*").alias("count")).withColumn("is_bot", is_bot(F.col("user_agent"))),
    f"SELECT user_agent, count(*) AS count, {is_bot_sql()} AS is_bot FROM hits GROUP BY user_agent")

_browser = " ".join(f"WHEN regexp_matches(user_agent, {text(p)}) THEN {text(n + ' ')} || regexp_extract(user_agent, {text(p)}, 1)"
                    for n, _, p in BROWSER_RULES)
_product = "'^([A-Za-z][^/ ]*)/([0-9][0-9.]*)'"
_os = " ".join(f"WHEN contains(user_agent, {text(w)}) THEN {text(n)}" for n, w in OS_RULES)
add("parse_user_agents", lambda df: df.groupBy("user_agent").agg(F.count("*").alias("count")).withColumn(
        "ua", parse_user_agent(F.col("user_agent"))).select("user_agent", "count", "ua.*"),
    f"""SELECT user_agent, count(*) AS count,
    CASE WHEN user_agent IN ('', '-') THEN 'Unknown' {_browser}
      WHEN regexp_extract(user_agent, {_product}, 1) NOT IN ('', 'Mozilla')
      THEN regexp_extract(user_agent, {_product}, 1) || ' ' || regexp_extract(user_agent, {_product}, 2) ELSE '' END AS browser,
    CASE WHEN user_agent IN ('', '-') THEN 'Unknown' {_os} ELSE '' END AS os,
    CASE WHEN user_agent IN ('', '-') THEN 'Unknown' WHEN {contains_any_sql('user_agent', MOBILE_WORDS)} THEN 'Mobile'
      WHEN {is_bot_sql()} THEN 'Bot' ELSE 'Desktop' END AS device FROM hits GROUP BY user_agent""")
add("status_category", lambda df: df.groupBy(st.status_category(F.col("status")).alias("category")).agg(F.count("*").alias("count")),
    """SELECT CASE status // 100 WHEN 2 THEN 'success' WHEN 3 THEN 'redirect' WHEN 4 THEN 'client_error'
    WHEN 5 THEN 'server_error' ELSE 'other' END AS category, count(*) AS count FROM hits GROUP BY 1""")
add("error_success_flags", lambda df: df.groupBy("status").agg(
        F.count_if(st.is_error(F.col("status"))).alias("errors"), F.count_if(st.is_success(F.col("status"))).alias("successes")),
    """SELECT status, count(*) FILTER (status >= 400) AS errors, count(*) FILTER (status >= 200 AND status < 300) AS successes
    FROM hits GROUP BY status""")
