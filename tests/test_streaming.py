import json
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hitscope import stream_access_log
from hitscope.functions.attacks import ATTACK_TYPES
from hitscope.operators import security, timeline
from hitscope.streaming import sinks, threats, windows

PATHS = ["/", "/login", "/api/a", "/?q=union", "/.env", "/c99.php", "/{{x}}", "/graphql?introspection", "/rest/1;x"]


@pytest.fixture
def split_stream(spark, log, tmp_path):
    """A log as one batch DataFrame and as a stream over several landed files."""
    def build(rows, parts=4):
        df = log(rows, 1)
        size = -(-len(rows) // parts)
        for i in range(parts):
            folder = tmp_path / f"part-{i}"
            df.where(F.floor(F.col("seq") / size) == i).coalesce(1).write.parquet(str(folder))
            piece = next(folder.glob("*.parquet"))
            (tmp_path / "landed").mkdir(exist_ok=True)
            (tmp_path / "landed" / f"{i}.parquet").write_bytes(piece.read_bytes())
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
        return df, stream
    return build


def test_running_threats_end_like_the_batch(spark, split_stream, tmp_path):
    rnd = random.Random(2)
    at, rows = 0.0, []
    for _ in range(900):
        at += rnd.choice([0.01, 0.05, 0.3])
        rows.append({"at": at, "ip": rnd.choice(["9.9.9.9", "9.9.9.9", f"1.1.1.{rnd.randrange(12)}"]),
                     "path": rnd.choices(PATHS, [8, 3, 12, 1, 1, 1, 1, 1, 1])[0], "status": rnd.choices([200, 401, 404], [4, 2, 1])[0]})
    df, stream = split_stream(rows)
    sinks.updates_to_files(threats.stream_ip_threats(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    columns = ["ip", "country", "request_count", "error_count", "core_hits", "first_seen", "last_seen", *ATTACK_TYPES, "attack_type_count", "threat_score"]
    got = sinks.latest_updates(spark, str(tmp_path / "out"), ["ip"]).select(columns)
    want = security.ip_profile(df).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_timeline_and_alerts(spark, split_stream, tmp_path):
    rows = [{"at": i * 2, "ip": f"1.1.1.{i % 7}", "status": 500 if (i // 30) % 2 else 200} for i in range(300)]
    df, stream = split_stream(rows)
    sinks.append_to_files(windows.stream_timeline(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.bucket: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.bucket: r for r in timeline.timeline(df).collect()}
    # The last buckets are not final before the watermark passes them.
    assert len(got) == len(want) - 2 and all(tuple(got[b])[1:] == pytest.approx(tuple(want[b])[1:]) for b in got)
    found = windows.alerts(timeline.timeline(df), unique_ips=6).collect()
    assert {r.alert for r in found} == {"error_rate", "unique_ips"} and len(found) == 15


def test_sliding_stats_match_a_batch(spark, split_stream, tmp_path):
    rows = [{"at": i * 3, "ip": f"1.1.1.{i % 7}", "response_time": i / 100} for i in range(200)]
    df, stream = split_stream(rows)
    sinks.append_to_files(windows.sliding_stats(stream, "2 minutes", "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.window_start: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.window_start: r for r in windows.sliding_stats(df, "2 minutes", "1 minute").collect()}
    assert got and all(got[w] == want[w] for w in got)
    assert want[min(want)].unique_ips == 7


def test_log_files_as_stream(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    for part in range(2):
        (landed / f"{part}.log").write_text("".join(json.dumps(
            {"time": (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=part)).isoformat() + "Z", "request": f"GET /{part}/{i} HTTP/1.1"}) + "\n"
            for i in range(5)) + "broken\n")
    stream = stream_access_log(spark, str(landed), max_files_per_trigger=1).select("ts", "path", "ip")
    sinks.append_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.path for r in got) == [f"/{p}/{i}" for p in range(2) for i in range(5)] and {r.ip for r in got} == {"<nil>"}
