import datetime as dt
import ipaddress
import json
import random

from pyspark.sql import functions as F

from hitscope.functions.addresses import in_networks, with_address
from hitscope.functions.times import bucket, float_prefix, int_prefix, parse_time
from hitscope.operators.filters import in_network_table
from hitscope.sources import records

def default():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq bigint, value string")


def expected_address(text):
    if "," in text:
        text = text.split(",")[0].strip(" ")
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return "<nil>"
    if "%" in text:
        return "<nil>"
    return str(ip.ipv4_mapped) if ip.version == 6 and ip.ipv4_mapped else str(ip)


def test_addresses(spark):
    rnd = random.Random(1)
    texts = ["203.0.113.9", "203.0.113.9, 10.0.0.1", "-", "", "junk", "1.2.3", "1.2.3.256", "01.2.3.4", "::", "::1", "1::", ":::", "1::2::3",
             "::ffff:1.2.3.4", "64:ff9b::1.2.3.4", "::ffff:1.2.3.400", "1:2:3:4:5:6:7::", "fe80::1%eth0", "12345::", "g::", ":1", "1:", "1:2:3:4:5:6:7:8:9"]
    for _ in range(400):
        groups = [rnd.choice(["0", "0", "0000", f"{rnd.randrange(65536):x}", f"{rnd.randrange(65536):04X}"]) for _ in range(8)]
        text = ":".join(groups)
        texts += [text, str(ipaddress.IPv6Address(int(ipaddress.ip_address(text)))), text.replace(":0:0:", "::", 1), text[rnd.randrange(5):]]
    got = with_address(lines(spark, texts), F.col("value")).select("value", "ip").collect()
    assert [(r.value, r.ip) for r in got if r.ip != expected_address(r.value)] == []


def test_networks(spark):
    ips = ["10.0.0.1", "10.1.0.0", "192.168.1.255", "2001:db8::5", "2001:db9::", "<nil>", "::"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    cidrs = ["10.0.0.0/16", "192.168.1.128/25", "2001:db8::/32", "::/128"]
    want = [i for i in ips if i != "<nil>" and any(
        ipaddress.ip_address(i) in n for n in map(ipaddress.ip_network, cidrs) if n.version == ipaddress.ip_address(i).version)]
    assert [r.ip for r in df.where(in_networks(F.col("ip"), cidrs)).collect()] == want
    many = cidrs + [f"172.16.{i}.0/{24 + i % 8}" for i in range(0, 200, 2)] + [f"2001:db8:{i:x}::/48" for i in range(50)]
    assert sorted(r.ip for r in in_network_table(df, many).collect()) == sorted(want)


def test_times(spark):
    at = dt.datetime(2024, 1, 1, 10)
    cases = {
        "2024-01-01T12:00:00+02:00": at, "2024-01-01T10:00:00.123456Z": at.replace(microsecond=123456), "2024-01-01T10:00:00Z": at,
        "2024-01-01 10:00:00": at, "01/Jan/2024:12:00:00 +0200": at, "1704103200": at, "1704103200.9": at,
        "2024-01-01T11:00:00.5+01:00": at.replace(microsecond=500000), "junk": None, "": None,
    }
    got = lines(spark, list(cases)).select("value", parse_time(F.col("value")).alias("t")).collect()
    assert {r.value: r.t for r in got} == cases


def test_number_prefixes(spark):
    got = lines(spark, ["200", "200abc", " 7", "-3x", "1.9", "1.5e3", "abc", "", "0.120", ".5x", "1e2z"]).orderBy("seq").select(
        int_prefix(F.col("value")), float_prefix(F.col("value"))).collect()
    assert [r[0] for r in got] == [200, 200, 7, -3, 1, 1500, None, None, 0, None, 1]
    assert [r[1] for r in got] == [200.0, 200.0, 7.0, -3.0, 1.9, 1500.0, None, None, 0.12, 0.5, 100.0]


def test_json_records(spark):
    full = {"time": "2024-01-01T10:00:00Z", "remote_addr": "203.0.113.9", "request": "POST /a?b=1 HTTP/1.1", "status": 404,
            "body_bytes_sent": "12", "request_time": 0.25, "user_agent": "curl/8.0", "country": "NL", "host": "h", "extra": {"x": 1}}
    texts = [json.dumps(full), "{}", "", "   ", "bad", "[1]", '{"status":', "null", json.dumps({"request": "GET", "user_agent": "-"}),
             "  " + json.dumps({"request": "", "status": "x"})]
    got = records.parse_json(lines(spark, texts), default()).orderBy("seq").collect()
    assert [r.seq for r in got] == [0, 1, 8, 9]
    a, b, c, d = got
    assert (a.ts, a.ip, a.method, a.path, a.status, a.bytes_sent, a.response_time, a.is_bot, a.country, a.host, a.ts_defaulted) == (
        dt.datetime(2024, 1, 1, 10), "203.0.113.9", "POST", "/a?b=1", 404, 12, 0.25, True, "NL", "h", False)
    assert (b.ts, b.ts_defaulted, b.ip, b.method, b.path, b.status, b.ua, b.is_bot) == (dt.datetime(2030, 1, 1), True, "<nil>", "", "", 0, None, False)
    assert (c.method, c.path, c.ua.browser, c.ua.os, c.ua.device) == ("GET", "/", "Unknown", "Unknown", "Unknown")
    assert (d.method, d.path, d.status) == ("GET", "/", 0)
    assert {r.outcome: r["count"] for r in records.rejected_json(lines(spark, texts)).collect()} == {"accepted": 4, "blank": 2, "malformed": 4}


def test_tsv_and_columns(spark):
    tsv = "\t".join(["2024-01-01 10:00:00", "203.0.113.9", "GET", "/x y", "200", "5", "0.5", "MyCrawler", "NL", "varnish"])
    texts = [tsv, "403  0.000 US 184.105.139.69  GET / HTTP/1.1", "403 0.000 US 1.1.1.1", '{"request":"GET /j HTTP/1.1"}', "", "500 1.5 DE bad GET"]
    got = records.parse_mixed(lines(spark, texts), default()).orderBy("seq").collect()
    assert [(r.seq, r.ip, r.method, r.path, r.status, r.response_time, r.is_bot, r.country, r.handler) for r in got] == [
        (0, "203.0.113.9", "GET", "/x y", 200, 0.5, True, "NL", "varnish"),
        (1, "184.105.139.69", "GET", "/", 403, 0.0, False, "US", ""),
        (3, "<nil>", "GET", "/j", 0, 0.0, False, "", ""),
        (5, "<nil>", "GET", "", 500, 1.5, False, "DE", "")]
    assert records.parse_tsv(lines(spark, texts), default()).count() == 1
    assert [r.seq for r in records.parse_columns(lines(spark, texts[1:3]), default()).collect()] == [0]


def test_week_buckets_start_on_monday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 10, 5),)], "ts timestamp")
    assert df.select(bucket(F.col("ts"), "7 days")).first()[0] == dt.datetime(2024, 1, 8)
    assert df.select(bucket(F.col("ts"), "1 day")).first()[0] == dt.datetime(2024, 1, 10)
