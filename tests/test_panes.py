"""Sliding windows as sums of panes, and late records kept aside."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hitscope.operators import timeline
from hitscope.streaming import late, sinks, windows

SCHEMA = "seq bigint, ts timestamp, ip string, status int, bytes_sent bigint, response_time double, user_agent string"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def landed(spark, tmp_path):
    """A log in several files, and a stream that takes one of them at a time."""
    def build(rows, files):
        df = spark.createDataFrame(rows, SCHEMA)
        for i in range(files):
            df.where(F.col("seq") % files == i).coalesce(1).write.parquet(str(tmp_path / f"in/file={i}"))
        return df, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    return build


def log_rows(n=400, seed=3):
    rng = random.Random(seed)
    return [(i, T0 + dt.timedelta(seconds=rng.randrange(5_400)), rng.choice([None, "1.1.1.1", "1.1.1.1", f"2.2.2.{rng.randrange(30)}"]),
             rng.choice([200, 404, 500]), rng.randrange(1000), rng.choice([None, rng.randrange(40) / 8]), rng.choice(["x", "Googlebot"])) for i in range(n)]


@pytest.mark.parametrize("size", [("30 minutes", "10 minutes"), ("25 minutes", "10 minutes"), ("10 minutes", "10 minutes"), ("10 minutes", "4 minutes")])
def test_panes_equal_a_rescan(spark, landed, tmp_path, size):
    df, stream = landed(log_rows(), 4)
    query = sinks.deltas_to_files(stream, lambda batch: windows.pane_parts(batch, *size), str(tmp_path / "parts"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert not query.lastProgress["stateOperators"]  # no state at all
    got = windows.sliding_of_panes(spark.read.parquet(str(tmp_path / "parts")), *size)
    rescan = windows.sliding_of(windows.sliding_parts(df, *size))

    def rows(frame):
        return sorted(tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in frame.collect())

    assert got.columns == rescan.columns and rows(got) == rows(rescan)
    sinks.compact_deltas(spark, str(tmp_path / "parts"), list(windows.PANE_KEYS), str(tmp_path / "compact"))
    assert rows(windows.sliding_of_panes(spark.read.parquet(str(tmp_path / "compact")), *size)) == rows(got)


def test_stored_rows_do_not_depend_on_the_overlap(spark, log):
    df = spark.createDataFrame(log_rows(), SCHEMA)
    few, many = (windows.pane_parts(df, window, "1 minute").count() for window in ("2 minutes", "60 minutes"))
    assert few == many <= 2 * df.count()
    assert windows.sliding_parts(df, "60 minutes", "1 minute").count() > 20 * many


def test_final_windows_have_one_state_row_a_pane_and_window(spark, landed, tmp_path):
    _, stream = landed([(i, T0 + dt.timedelta(seconds=9 * i), f"1.1.{i % 7}.{i % 50}", 200, 1, i / 8, "x") for i in range(600)], 3)
    query = sinks.append_to_files(windows.sliding_stats(stream, "10 minutes", "1 minute", "2 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    states = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert states and max(states) <= 100  # 90 minutes of panes at most, whatever the overlap


def test_late_records(spark, landed, tmp_path):
    df, stream = landed(log_rows(), 4)
    path = str(tmp_path / "late")
    late.timeline_with_late(stream, path, str(tmp_path / "cp"), "1 minute", "5 minutes").awaitTermination()
    aside = late.late_records(spark, path)
    assert 100 < aside.count() < 300 and {r.batch_id for r in aside.select("batch_id").distinct().collect()} == {1, 2, 3}
    whole = {r.bucket: r for r in timeline.timeline(df).select("bucket", "count", "bytes", "error_count").collect()}
    fixed = {r.bucket: r for r in late.corrected_timeline(spark, path).select("bucket", "count", "bytes", "error_count").collect()}
    assert fixed == whole
    mark = late.watermark(spark, path, "5 minutes")
    final = {r.bucket: r["count"] for r in late.final_timeline(spark, path, "1 minute", "5 minutes").collect()}
    assert final and all(b + dt.timedelta(minutes=1) <= mark for b in final) and sum(final.values()) < df.count() - aside.count() + 1
    added = {r.bucket: r["count"] for r in timeline.timeline(aside).collect()}
    assert all(final[b] + added.get(b, 0) == whole[b]["count"] for b in final)


def test_nothing_is_late_without_times(spark, tmp_path):
    spark.createDataFrame([(1, None, "1.1.1.1", 200, 1, 0.5, "x")], SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    late.timeline_with_late(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert late.watermark(spark, str(tmp_path / "out")) is None and late.late_records(spark, str(tmp_path / "out")).isEmpty()
    assert late.final_timeline(spark, str(tmp_path / "out")).isEmpty()
