"""Cuts that must not be there, and what took their place."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hitscope.operators import filters, security, traffic
from hitscope.plans import workspace
from hitscope.plans.percentiles import exact_percentiles
from hitscope.sources import records
from hitscope.streaming import sinks, windows


def test_every_threat_of_an_address(log):
    df = log([{"path": "/?q=<script>"}] * 20 + [{"ip": "2.2.2.2"}])
    suspicious = security.suspicious_ips(security.ip_profile(df), None)
    rows = security.suspicious_threats(df, suspicious).orderBy("ip", "seq", "position").collect()
    assert [r.threat_type for r in rows] == ["sql_injection", "xss"] * 20 and {r.ip for r in rows} == {"1.1.1.1"}


def test_more_than_a_hundred_block_rules(log, tmp_path):
    df = log([{"ip": f"9.9.{i // 250}.{i % 250}", "path": "/?q=union"} for i in range(130)])
    everyone = security.suspicious_ips(security.ip_profile(df), None)
    rules = security.block_list(security.with_threat_text(df, everyone), "all")
    assert rules.count() == 130 and security.suspicious_ips(security.ip_profile(df)).count() == 100
    from hitscope.sinks import files
    files.write_block_list(rules, str(tmp_path / "deny"))
    lines = [r.value for r in df.sparkSession.read.text(str(tmp_path / "deny")).collect()]
    assert len(lines) == 130 and len(set(lines)) == 130


def test_networks(log):
    ips = ["10.0.0.1", "10.0.1.1", "192.168.7.9", "2001:db8::1", "2001:db9::1", "not an address"]
    df = log([{"ip": ip} for ip in ips])
    assert filters.in_network_table(df, []).count() == len(ips)
    found = filters.in_network_table(df, ["10.0.0.0/24", "192.168.0.0/16", "2001:db8::/32", "10.0.0.0/25"])
    assert sorted(r.ip for r in found.collect()) == ["10.0.0.1", "192.168.7.9", "2001:db8::1"]
    many = [f"10.{i}.0.0/24" for i in range(0, 400, 2) if i < 256] + [f"2001:db8:{i:x}::/48" for i in range(272)]
    assert sorted(r.ip for r in filters.in_network_table(df, many).collect()) == ["10.0.0.1", "2001:db8::1"]
    assert found.columns == df.columns


def test_one_row_for_each_address_with_names(spark, log):
    df = log([{"ip": "1.1.1.1"}] * 3 + [{"ip": "1.1.1.2"}] * 2 + [{"ip": "1.1.1.3"}])
    names = spark.createDataFrame([("1.1.1.1", "b.example"), ("1.1.1.1", "a.example"), ("1.1.1.2", "")], "ip string, hostname string")
    got = {r.ip: r.hostname for r in traffic.ips_with_hostname(df, names, 3).collect()}
    assert got == {"1.1.1.1": "a.example", "1.1.1.2": "-", "1.1.1.3": "-"}
    assert traffic.ips_with_hostname(df, names, 3).count() == 3


def test_tabs_around_json(spark):
    line = '{"remote_addr": "1.2.3.4", "request": "GET / HTTP/1.1", "status": "200"}'
    lines = spark.createDataFrame([(0, "\t" + line), (1, line + " \t\r"), (2, "\t \t"), (3, "\t{")], "seq bigint, value string")
    assert [r.seq for r in records.parse_json(lines).orderBy("seq").collect()] == [0, 1]
    assert {r.outcome: r["count"] for r in records.rejected_json(lines).collect()} == {"accepted": 2, "blank": 1, "malformed": 1}
    assert sorted(r.seq for r in records.parse_mixed(lines).collect()) == [0, 1]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        workspace.shared_folder(Elsewhere, "x")


def test_weighted_percentiles(spark):
    rows = [("a", float(v), v % 3 + 1) for v in range(1, 40)]
    weighted = spark.createDataFrame(rows, "k string, v double, n bigint")
    plain = weighted.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).drop("_")
    wanted = {"p50": 0.5, "p95": 0.95}
    assert exact_percentiles(weighted, ["k"], "v", wanted, "n").collect() == exact_percentiles(plain, ["k"], "v", wanted).collect()


def test_late_records_are_not_lost(spark, tmp_path):
    """A record far behind the others is counted by the parts, and dropped by the final windows."""
    schema = "seq bigint, ts timestamp, ip string, status int, bytes_sent bigint, response_time double, user_agent string"
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 30, 7_200, 10_800, 20]  # the last one comes in a later file
    for i, s in enumerate(at):
        spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), f"1.1.1.{i}", 200, 10, 0.5, "x")], schema).coalesce(1).write.parquet(str(tmp_path / f"in/day={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sinks.updates_to_files(windows.timeline_parts(stream, "1 minute"), str(tmp_path / "parts"), str(tmp_path / "c1")).awaitTermination()
    parts = sinks.latest_updates(spark, str(tmp_path / "parts"), ["bucket", "ip"])
    assert {r.bucket: r["count"] for r in windows.timeline_of(parts).collect()}[t0] == 3
    sinks.compact_updates(spark, str(tmp_path / "parts"), ["bucket", "ip"], str(tmp_path / "compact"))
    assert sinks.latest_updates(spark, str(tmp_path / "compact"), ["bucket", "ip"]).count() == parts.count()
    sinks.append_to_files(windows.stream_timeline(stream, "1 minute", "1 minute"), str(tmp_path / "final"), str(tmp_path / "c2")).awaitTermination()
    assert {r.bucket: r["count"] for r in spark.read.parquet(str(tmp_path / "final")).collect()}[t0] == 2


def test_arrival_chunks_are_bounded(spark, log, tmp_path):
    """No chunk of an address holds more rows than asked for, with any of the arrival keys."""
    from hitscope.plans.arrival import chunk_of, number_arrivals
    from hitscope.sources.lines import read_lines

    spark.range(500).selectExpr("'line ' || id AS value").coalesce(1).write.text(str(tmp_path / "lines"))
    lines = read_lines(spark, str(tmp_path / "lines"))
    numbered = number_arrivals(lines)
    for df in (lines, numbered):
        sizes = [r["count"] for r in df.groupBy(chunk_of(df, "seq", 100).alias("c")).count().collect()]
        assert sum(sizes) == 500 and max(sizes) <= 100 and len(sizes) <= 7
    assert [r.value for r in numbered.orderBy("seq").collect()] == [r.value for r in lines.orderBy("seq").collect()]
    timed = log([{"at": i} for i in range(240)]).withColumn("seq", F.struct("ts", "seq"))
    sizes = [r["count"] for r in timed.groupBy(chunk_of(timed, "seq").alias("c")).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 240
    few = security.ip_profile(timed).first()
    assert few.request_count == 240


def test_no_sorted_part_is_large(spark):
    """Of a hundred thousand different values without a key, no sorted part holds more than a thousandth."""
    from hitscope.plans import percentiles

    df = spark.range(100_000).select((F.col("id") / 1000 + 1).alias("v"))
    place = percentiles._place(F.col("v"))
    parts = df.groupBy(F.floor(place).alias("s"), F.floor((place - F.floor(place)) * percentiles._PARTS).alias("p")).count()
    assert parts.agg(F.max("count")).first()[0] <= 100
    assert exact_percentiles(df, [], "v", {"p50": 0.5}).first().p50 == pytest.approx(50.9995)
