"""Streaming queries: the events table read as a stream, run until it is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitscope.functions.attacks import ATTACK_TYPES
from hitscope.operators import anomaly
from hitscope.operators.security import ip_profile
from hitscope.plans.workspace import shared_folder, stored
from hitscope.sinks.files import write_hits
from hitscope.sources.records import read_access_log
from hitscope.streaming import anomalies, late, sinks, threats, windows
from hitscope.streaming.sources import follow_access_log, stream_access_log

from . import analysis, parsing
from .base import ERRORS, add_raw, is_bot_sql, r
from .security import PROFILE
from .view import hits


def hit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, stream=True)


def _appended(build, *times: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_folder(spark, "stream")
        sinks.append_to_files(build(hit_stream(spark, sf_dir)), path, shared_folder(spark, "progress")).awaitTermination()
        stored = spark.read.parquet(path)
        return stored.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})
    return run


def _updated(build, keys: list[str], finish, *times: str):
    """All windows: the parts run in update mode, the last version of each is put together."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared_folder(spark, "stream")
        sinks.updates_to_files(build(hit_stream(spark, sf_dir)), path, shared_folder(spark, "progress")).awaitTermination()
        done = finish(sinks.latest_updates(spark, path, keys))
        return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times if c in done.columns})
    return run


_TIMELINE = f"""(SELECT date_trunc('hour', ts) AS bucket, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes, count(DISTINCT ip) AS unique_ips,
    {ERRORS} AS error_count, {r("avg(response_time)")} AS avg_response_time FROM hits GROUP BY 1)"""
_PART = ["bucket", "ip"]
add_raw("stream_timeline", _updated(lambda s: windows.timeline_parts(s, "1 hour"), _PART, windows.timeline_of, "bucket"), f"SELECT * FROM {_TIMELINE}")
_LIMITS = {"error_rate": 0.5, "requests": 18, "unique_ips": 17}
add_raw("stream_alerts", _updated(lambda s: windows.timeline_parts(s, "1 hour"), _PART, lambda p: windows.alerts(windows.timeline_of(p), **_LIMITS), "bucket"),
        f"""WITH f AS (SELECT * FROM {_TIMELINE}) SELECT bucket, 'error_rate' AS alert, {r("error_count / count")} AS value, 0.5::DOUBLE AS threshold FROM f WHERE error_count / count > 0.5
        UNION ALL SELECT bucket, 'requests', count::DOUBLE, 18.0::DOUBLE FROM f WHERE count > 18
        UNION ALL SELECT bucket, 'unique_ips', unique_ips::DOUBLE, 17.0::DOUBLE FROM f WHERE unique_ips > 17""")


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, from what each micro-batch adds to the panes."""
    path, size = shared_folder(spark, "stream"), ("6 hours", "2 hours")
    sinks.deltas_to_files(hit_stream(spark, sf_dir), lambda batch: windows.pane_parts(batch, *size), path, shared_folder(spark, "progress")).awaitTermination()
    done = windows.sliding_of_panes(spark.read.parquet(path), *size)
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


add_raw("sliding_stats", _sliding,
        f"""WITH w AS (SELECT *, time_bucket(INTERVAL 2 HOURS, ts) - k * INTERVAL 2 HOURS AS window_start FROM hits, (SELECT unnest([0, 1, 2]) AS k))
        SELECT window_start, window_start + INTERVAL 6 HOURS AS window_end, count(*) AS total_requests, count(DISTINCT ip) AS unique_ips, sum(bytes_sent)::BIGINT AS total_bytes,
        {r("avg(response_time)")} AS avg_response_time, {r("quantile_cont(response_time, 0.5)")} AS median_response_time, {r("quantile_cont(response_time, 0.95)")} AS p95_response_time,
        {r("quantile_cont(response_time, 0.99)")} AS p99_response_time, count(*) FILTER ({is_bot_sql()}) AS bot_traffic, count(*) FILTER (NOT {is_bot_sql()}) AS human_traffic,
        {ERRORS} AS error_count, {r(ERRORS + " / count(*)")} AS error_rate FROM w GROUP BY window_start""")
# Final windows only: what append mode stores once the watermark has passed a bucket's end.
add_raw("stream_timeline_final", _appended(lambda s: windows.stream_timeline(s, "1 hour", "1 hour"), "bucket"),
        f"SELECT * FROM {_TIMELINE} WHERE bucket + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM hits) - INTERVAL 1 HOUR")


#: The log arrives in so many files, dealt out by turns: all but the first hold hardly anything but late records.
_TURNS = 3


def _out_of_order(spark: SparkSession, sf_dir: str) -> str:
    """Runs the timeline over records that arrive out of order; the folder of what it stored."""
    landed, path = shared_folder(spark, "landed"), shared_folder(spark, "stream")
    turns = hits(spark, sf_dir)
    for turn in range(_TURNS):
        turns.where(F.col("seq") % _TURNS == turn).write.parquet(f"{landed}/turn={turn}")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(landed)
    late.timeline_with_late(stream, path, shared_folder(spark, "progress"), "1 hour", "1 hour").awaitTermination()
    return path


def _late_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _out_of_order(spark, sf_dir)
    if late.late_records(spark, path).isEmpty():
        raise ValueError("no record was late")
    done = late.corrected_timeline(spark, path, "1 hour")
    return done.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def _kept_and_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by bucket: those in time and those that came late are all there are."""
    path = _out_of_order(spark, sf_dir)
    in_time = late.timeline_of(late._parts(spark, path)).select("bucket", F.col("count").alias("n"))
    aside = late.late_records(spark, path).groupBy(F.window("ts", "1 hour")["start"].alias("bucket")).agg(F.count("*").alias("n"))
    return in_time.unionByName(aside).groupBy(F.col("bucket").cast("timestamp_ntz").alias("bucket")).agg(F.sum("n").alias("count"))


add_raw("stream_timeline_late", _late_timeline, f"SELECT * FROM {_TIMELINE}")
add_raw("stream_late_records", _kept_and_late, "SELECT date_trunc('hour', ts) AS bucket, count(*)::BIGINT AS count FROM hits GROUP BY 1")


def _threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "stream")
    stream = threats.stream_ip_threats(hit_stream(spark, sf_dir))
    sinks.updates_to_files(stream, path, shared_folder(spark, "progress")).awaitTermination()
    return sinks.latest_updates(spark, path, ["ip"]).select(
        "ip", "country", "request_count", "error_count", "core_hits", *ATTACK_TYPES, "attack_type_count", "threat_score")


# The stream's records have no referer, which two rules would read.
add_raw("stream_ip_threats", _threats,
        PROFILE.replace(" || ' ' || referer", "") + f""" SELECT ip, country, request_count, error_count, core_hits, {', '.join(ATTACK_TYPES)},
        attack_type_count, {r("threat_score")} AS threat_score FROM profile""")


#: Lines of a landed file, about; a file is one value of the ordered stream, so it must not grow with the log.
LINES_A_FILE = 100_000
#: Micro-batches are small, as an address's records of one batch are held in one frame.
FILES_A_TRIGGER = 16


def _land(spark: SparkSession, sf_dir: str) -> str:
    """The log as JSON lines in files of a bounded size, three at least, in order of arrival by name and by time."""
    landed = shared_folder(spark, "landed")
    record = F.to_json(F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"), F.col("ip").alias("remote_addr"),
        F.concat(F.col("method"), F.lit(" "), F.col("path"), F.lit(" HTTP/1.1")).alias("request"), F.col("status").cast("string").alias("status"),
        F.col("bytes_sent").alias("body_bytes_sent"), "user_agent", "country", "handler", "referer"))
    parts = max(3, -(-hits(spark, sf_dir).count() // LINES_A_FILE))
    # JSON is made after the sort: its sampling reads all rows once more, and as columns they are smaller.
    hits(spark, sf_dir, True).repartitionByRange(parts, "seq").sortWithinPartitions("seq").select(record.alias("value")).write.text(landed)
    _in_order(spark, landed)
    return landed


def _landed_files(spark: SparkSession, landed: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(landed)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store, sorted((f for f in store.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())


def _in_order(spark: SparkSession, landed: str) -> None:
    """File times in order of the names: the tasks ended in any order, and a stream takes files by time."""
    store, files = _landed_files(spark, landed)
    last = max((f.getModificationTime() for f in files), default=0)
    for k, f in enumerate(files):
        store.setTimes(f.getPath(), last - len(files) + 1 + k, -1)


def _landed_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw lines in several micro-batches to the threat score."""
    landed, path = _land(spark, sf_dir), shared_folder(spark, "stream")
    files = min(FILES_A_TRIGGER, max(1, len(_landed_files(spark, landed)[1]) // 3))
    stream = stream_access_log(spark, landed, max_files_per_trigger=files, ordered=True)
    sinks.updates_to_files(threats.stream_ip_threats(stream), path, shared_folder(spark, "progress")).awaitTermination()
    return sinks.latest_updates(spark, path, ["ip"]).select(
        "ip", "country", "request_count", "error_count", "core_hits", *ATTACK_TYPES, "attack_type_count", "threat_score")


def _profile_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documented route: files, normalized records stored with a numeric arrival key, profile."""
    table = shared_folder(spark, "hits")
    write_hits(read_access_log(spark, _land(spark, sf_dir)), table)
    return ip_profile(spark.read.parquet(table)).select(
        "ip", "country", "request_count", "error_count", "core_hits", *ATTACK_TYPES, "attack_type_count", "threat_score")


add_raw("ip_profile_from_files", _profile_from_files, PROFILE + f""" SELECT ip, country, request_count, error_count, core_hits, {', '.join(ATTACK_TYPES)},
        attack_type_count, {r("threat_score")} AS threat_score FROM profile""", True)
add_raw("stream_log_threats", _landed_threats, PROFILE + f""" SELECT ip, country, request_count, error_count, core_hits, {', '.join(ATTACK_TYPES)},
        attack_type_count, {r("threat_score")} AS threat_score FROM profile""", True)


def _log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines landed as files, then read by the log stream."""
    landed, path = shared_folder(spark, "landed"), shared_folder(spark, "stream")
    parsing.raw_lines(hits(spark, sf_dir, True), parsing.json_line()).select("value").write.text(landed, compression="gzip")
    stream = stream_access_log(spark, landed).select("ip", "method", "path", "status", "bytes_sent")
    sinks.append_to_files(stream, path, shared_folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(path).groupBy("method", "status").agg(F.count("*").alias("count"), F.sum("bytes_sent").alias("bytes"))


add_raw("stream_access_log", _log_stream,
        "SELECT method, status, count(*) AS count, sum(bytes_sent)::BIGINT AS bytes FROM hits GROUP BY method, status", True)


def _stream_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last days as a stream, against the baseline of the days before, which is a stored table."""
    path = shared_folder(spark, "stream")
    base = stored(anomaly.baseline(analysis._before(hits(spark, sf_dir)), "1 hour"), "baseline")
    sinks.deltas_to_files(analysis._after(hit_stream(spark, sf_dir)), lambda batch: anomalies.bucket_parts(batch, "1 hour"), path, shared_folder(spark, "progress")).awaitTermination()
    return anomalies.anomalies_of(spark.read.parquet(path), base, 2.0).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


add_raw("stream_anomalies", _stream_anomalies, f"SELECT * FROM {analysis._anomalies_sql(2.0)}")


def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one stream over a folder whose files become more between them, in tasks of a few megabytes."""
    landed, path, progress = shared_folder(spark, "landed"), shared_folder(spark, "stream"), shared_folder(spark, "progress")
    record = parsing.raw_lines(hits(spark, sf_dir, True), parsing.json_line())
    columns = ["ip", "method", "path", "status", "bytes_sent", "seq"]
    for turn in range(2):
        record.where(F.col("seq") % 2 == turn).select("value").write.mode("append").text(landed)
        stream = follow_access_log(spark, landed, pattern="part-*", split_bytes=FOLLOWED_BYTES).select(columns)
        sinks.append_to_files(stream, path, progress).awaitTermination()
    lines = spark.read.parquet(path)
    return lines.groupBy("method", "status").agg(F.count("*").alias("count"), F.countDistinct("seq").alias("places"), F.sum("bytes_sent").alias("bytes"))


#: Bytes of a task.
FOLLOWED_BYTES = 8 << 20
add_raw("follow_access_log", _followed,
        "SELECT method, status, count(*) AS count, count(*) AS places, sum(bytes_sent)::BIGINT AS bytes FROM hits GROUP BY method, status", True)
