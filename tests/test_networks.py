"""Addresses in very many networks, and baselines that merge."""

import ipaddress
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitscope.operators import anomaly, filters
from hitscope.plans import networks
from hitscope.streaming import anomalies, sinks

IPS = ["10.0.0.1", "10.0.1.1", "192.168.7.9", "2001:db8::1", "2001:db8:1::", "2001:db9::1", "<nil>", "not an address", "", None, "255.255.255.255", "0.0.0.0", "::"]


def some_networks(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if rng.random() < 0.6:
            out.append(str(ipaddress.ip_network((rng.choice([10 << 24, 192 << 24 | 168 << 16, 0]) + rng.randrange(1 << 16), rng.choice([8, 16, 20, 24, 31, 32])), strict=False)))
        else:
            out.append(str(ipaddress.ip_network(((0x20010DB8 << 96) + (rng.randrange(1 << 20) << 78), rng.choice([32, 48, 64, 127, 128])), strict=False)))
    return out


def expected(ip, cidrs):
    try:
        return any(ipaddress.ip_address(ip) in ipaddress.ip_network(c, strict=False) for c in cidrs)
    except ValueError:
        return False


@pytest.mark.parametrize("seed", range(5))
def test_index_by_brute_force(seed):
    cidrs, rng = some_networks(seed, 40), random.Random(seed)
    ips = IPS + [str(ipaddress.ip_network(c)[rng.choice([0, -1])]) for c in cidrs] + [f"10.0.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(100)]
    index = networks.NetworkIndex(cidrs)
    assert index.contains(pd.Series(ips)).tolist() == [expected(ip, cidrs) for ip in ips]
    for low, high in index.ranges.values():
        assert (low <= high).all() and (high[:-1] < low[1:]).all()


def test_index_edges():
    assert networks.NetworkIndex(["0.0.0.0/0", "::/0"]).contains(pd.Series(IPS)).tolist() == [True, True, True, True, True, True, False, False, False, False, True, True, True]
    assert not networks.NetworkIndex([]).contains(pd.Series(IPS)).any() and len(networks.NetworkIndex(["10.0.0.0/25", "10.0.0.128/25", "10.0.0.7"])) == 1
    assert networks.NetworkIndex(["10.1.2.3/255.255.0.0"]).contains(pd.Series(["10.1.9.9", "10.2.0.0"])).tolist() == [True, False]
    for wrong in ("10.0.0.0/33", "x/8", "10.0.0.0/-1"):
        with pytest.raises(ValueError):
            networks.NetworkIndex([wrong])


def test_a_million_networks_in_seconds(log):
    started = time.time()
    cidrs = [f"10.{i >> 12 & 255}.{i >> 4 & 255}.{(i & 15) * 16}/29" for i in range(1_000_000)]
    rows = filters.in_network_table(log([{"ip": "10.3.4.1"}, {"ip": "10.3.4.9"}, {"ip": "11.0.0.0"}]), cidrs)
    assert [r.ip for r in rows.collect()] == ["10.3.4.1"] and time.time() - started < 60


@pytest.mark.parametrize("sent", [0, networks.SENT])
def test_all_ways_are_equal(spark, log, monkeypatch, sent):
    cidrs = some_networks(9, 30)
    df = log([{"ip": ip} for ip in IPS] + [{"ip": str(ipaddress.ip_network(c)[0])} for c in cidrs] * 2)
    few = sorted(r.seq for r in filters.in_network_table(df, cidrs).collect())
    monkeypatch.setattr(filters, "_IN_PLAN", 0)
    monkeypatch.setattr(networks, "SENT", sent)
    many = filters.in_network_table(df, cidrs)
    assert many.columns == df.columns and sorted(r.seq for r in many.collect()) == few == sorted(
        r.seq for r in df.collect() if expected(r.ip, cidrs))
    none = networks.in_network_frame(df, spark.createDataFrame([(None,), ("nonsense",)], "network string"))
    assert none.collect() == []


def test_baselines_merge(spark, log):
    rng = random.Random(2)
    df = log([{"at": rng.randrange(7_200), "status": rng.choice([200, 500]), "response_time": rng.choice([None, rng.random()])} for _ in range(900)])
    cuts = [df.where(F.floor(F.unix_timestamp("ts") / 600) % 3 == k) for k in range(3)] + [df.where("false")]
    states = [anomaly.baseline_state(part) for part in cuts]
    got = anomaly.merge_baselines(states[0].union(states[1]).union(states[2]).union(states[3])).first()
    want = anomaly.baseline(df).first()
    assert got.asDict() == pytest.approx(want.asDict()) and set(got.asDict()) == set(want.asDict())
    assert set(anomaly.merge_baselines(states[3]).first()) == {None}


def test_stream_anomalies(spark, log, tmp_path):
    calm = log([{"at": i * 7 + i % 5} for i in range(500)])
    busy = [{"at": 10_000 + i * 7, "status": 500 if 1_000 < i * 7 < 1_200 else 200, "response_time": 9.0 if i > 400 else 0.1 + i % 3 / 100} for i in range(500)]
    now = log(busy + [{"at": 10_600 + i / 50} for i in range(900)])
    base = anomaly.baseline(calm.withColumn("response_time", F.lit(0.1) + F.col("seq") % 3 / 100).withColumn("status", F.when(F.col("seq") % 17 == 0, 500).otherwise(200)))
    base.write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    now.write.parquet(str(tmp_path / "in"))
    want = {str(r) for r in anomaly.detect_anomalies(now, base).collect()}
    assert len(want) > 5
    stream = spark.readStream.schema(now.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sinks.deltas_to_files(stream, anomalies.bucket_parts, str(tmp_path / "parts"), str(tmp_path / "c1")).awaitTermination()
    close = lambda rows: sorted((r.bucket, r.type, round(r.z_score, 6), r.severity) for r in rows)
    assert close(anomalies.anomalies_of(spark.read.parquet(str(tmp_path / "parts")), base).collect()) == close(anomaly.detect_anomalies(now, base).collect())
    # in append mode, with records in order: every bucket but those that are still open
    ordered = now.orderBy("ts").coalesce(1)
    ordered.write.parquet(str(tmp_path / "sorted"))
    stream = spark.readStream.schema(now.schema).parquet(str(tmp_path / "sorted"))
    sinks.append_to_files(anomalies.stream_anomalies(stream, base), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    final = close(spark.read.parquet(str(tmp_path / "out")).collect())
    assert final and set(final) <= set(close(anomaly.detect_anomalies(now, base).collect())) and len(final) >= len(want) - 6
