import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from hitscope import discover_logs, file_profile, last_n, read_access_log, read_lines, select_day, select_history
from hitscope.operators import security, traffic
from hitscope.plans.arrival import number_arrivals
from hitscope.sinks import files as out
from hitscope.sources import records


def line(i, **more):
    when = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    return json.dumps({"time": when.isoformat() + "Z", "remote_addr": f"10.0.0.{i % 3}", "request": f"GET /p{i} HTTP/1.1", "status": "200", **more})


def logs(folder):
    (folder / "nginx" / "shop").mkdir(parents=True)
    (folder / "access.log").write_text("\n".join(line(i) for i in range(5)) + "\nbroken\n")
    with gzip.open(folder / "nginx" / "access.log.1.gz", "wt") as f:
        f.write("\n".join(line(i) for i in range(10, 14)) + "\n")
    (folder / "nginx" / "shop" / "access.log").write_text(line(20) + "\n\n")
    (folder / "other.log").write_text(line(99) + "\n")
    return folder


def test_discover_read_and_profile(spark, tmp_path):
    base = logs(tmp_path)
    found = [r.file_path for r in discover_logs(spark, str(base)).collect()]
    assert sorted(p.split(str(base))[1] for p in found) == ["/access.log", "/nginx/access.log.1.gz", "/nginx/shop/access.log"]
    assert discover_logs(spark, str(base / "nginx" / "shop" / "none")).count() == 0
    order = [str(base / "nginx" / "access.log.1.gz"), str(base / "access.log")]
    paths = [r.path for r in read_access_log(spark, order).orderBy("seq").collect()]
    assert paths == [f"/p{i}" for i in (10, 11, 12, 13, 0, 1, 2, 3, 4)]
    profile = {r.file_path.rsplit("/", 1)[1]: r for r in file_profile(read_lines(spark, order)).collect()}
    plain, packed = profile["access.log"], profile["access.log.1.gz"]
    assert (plain.line_count, plain.is_gzipped, plain.file_size) == (6, False, (base / "access.log").stat().st_size)
    assert (plain.first_entry, plain.last_entry) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 4))
    assert (packed.line_count, packed.is_gzipped) == (4, True)


def test_last_lines_then_parse(spark, tmp_path):
    base = logs(tmp_path)
    got = records.parse_json(last_n(read_lines(spark, str(base / "access.log")), 3)).collect()
    assert sorted(r.path for r in got) == ["/p3", "/p4"]


def test_small_splits_keep_the_line_order(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("\n".join(line(i) for i in range(3000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    spark.conf.set("spark.sql.files.minPartitionNum", 10)
    try:
        read = read_access_log(spark, str(path))
        assert read.rdd.getNumPartitions() > 5
        got = [r.path for r in read.orderBy("seq").collect()]
        profile = {r.ip: r for r in security.ip_profile(read).collect()}
        first = {r.ip: r for r in traffic.ip_stats(read).collect()}
        numbered = number_arrivals(read)
        assert numbered.schema["seq"].dataType.simpleString() == "bigint"
        assert [r.path for r in numbered.orderBy("seq").collect()] == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == [f"/p{i}" for i in range(3000)]
    assert profile["10.0.0.1"].first_seen == dt.datetime(2024, 1, 1, 0, 1)
    assert first["10.0.0.2"].last_seen == dt.datetime(2024, 1, 1) + dt.timedelta(minutes=2999)


def test_days_prune_partitions(spark, log, tmp_path):
    rows = [{"at": d * 86400 + 60} for d in range(10)]
    out.write_hits(log(rows), str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    as_of = dt.date(2024, 1, 9)
    day = select_day(table, as_of, 1)
    assert [r.seq for r in day.collect()] == [7]
    assert "PartitionFilters: [isnotnull(log_date" in day._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.seq, r.day_offset) for r in select_history(table, as_of).collect()) == [(i, 8 - i) for i in range(1, 8)]
    assert [r.seq for r in select_day(log(rows), as_of, 0).collect()] == [8]


def test_sinks_round_trip(spark, log, tmp_path):
    df = log([{"ip": f"1.1.1.{i % 3}", "path": f"/{i % 4}", "status": 500 if i % 5 == 0 else 200, "at": i * 40} for i in range(40)])
    summary = traffic.traffic_summary(df)
    out.write_summary_csv(summary, str(tmp_path / "csv"))
    stored = {r.Metric: r.Value for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()}
    assert stored["Total Requests"] == "40" and stored["Error Rate"] == "20.00%" and stored["Avg Response Time"] == "0.100"
    from hitscope.operators import timeline
    out.write_timeline_csv(timeline.timeline(df), str(tmp_path / "tl"))
    rows = spark.read.csv(str(tmp_path / "tl"), header=True)
    assert rows.columns == ["Timestamp", "Count", "Bytes", "UniqueIPs", "ErrorCount"] and rows.count() == 27
    out.write_reports({"statuses": traffic.status_counts(df)}, str(tmp_path / "json"))
    assert {(r.status, r["count"]) for r in spark.read.json(str(tmp_path / "json" / "statuses")).collect()} == {(200, 32), (500, 8)}
    out.write_report(df, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "Total Requests:      40" in text and " 1. /0 (10 requests)" in text and "500: 8 (20.0%)" in text
    profile = security.ip_profile(df.withColumn("path", F.lit("/?q=union")))
    named = security.with_threat_text(df, security.suspicious_ips(profile, None))
    out.write_block_list(security.block_list(named, "all"), str(tmp_path / "deny"))
    rules = [r.value for r in spark.read.text(str(tmp_path / "deny")).collect()]
    assert len(rules) == 3 and rules[0].startswith("deny 1.1.1.0;  # Score: 100.0, Requests: 14, Error: ")
