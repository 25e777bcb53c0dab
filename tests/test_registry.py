"""The registration, and a sample of the queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["traffic_summary", "top_ips", "ip_profile", "ip_profile_chunked", "parse_mixed", "security_timeline", "handler_stats",
          "category_stats", "detect_anomalies", "bot_behavior", "filter_many_networks", "geo_summary", "text_report",
          "unique_ips_by_day", "response_percentiles_by_day", "handler_percentiles_by_day", "daily_estimates", "performance_documents", "summary_document", "bot_documents"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def test_every_oracle_is_valid_and_named(duck):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, sql in entry.oracle_sql().items():
        duck.execute("EXPLAIN " + sql)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
