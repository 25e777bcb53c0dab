"""Raw log lines from files: batch, stream, file discovery and file profile.

A line carries ``seq``, its arrival key: a struct that sorts first by the order
in which the paths were given, then by file, by split within the file, and by
line within the split.  It needs no extra pass over the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixed_values import DEFAULT_LOG_PATHS, LOG_GLOBS
from ..functions.text import trimmed
from ..functions.times import parse_time
from ..schema import RAW_JSON


def _with_position(lines: DataFrame, source: int) -> DataFrame:
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.struct(
            F.lit(source).alias("source"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
    )


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of plain or gzip files, folders or globs, in the order given.

    Give one folder or glob rather than a long list: each entry of the list is
    a scan of its own.  Gzip files cannot be split, so one file is one task;
    land logs in files of moderate size.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = [_with_position(spark.read.text(p), i) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def stream_lines(spark: SparkSession, folder: str, max_files_per_trigger: int = 100, ordered: bool = False) -> DataFrame:
    """Stream of the lines of files that land in ``folder``.

    The unit of arrival is a whole (rotated) file.  ``ordered`` adds ``seq``:
    file time, file and line, the order of the lines of a micro-batch.  A
    stream can't number rows, so each file is then read as one value and cut
    into numbered lines: land files that a task can hold.
    """
    source = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    path = F.col("_metadata.file_path")
    if not ordered:
        return source.text(folder).select("value", path.alias("file_path"), F.col("_metadata.file_block_start").alias("split"))
    files = source.option("wholetext", "true").text(folder).select(
        path.alias("file_path"), F.col("_metadata.file_modification_time").alias("_time"),
        F.posexplode(F.split("value", "\r?\n")).alias("_line", "value"))
    return files.select("value", "file_path", F.struct(
        F.col("_time").alias("time"), F.col("file_path").alias("file"), F.col("_line").cast("bigint").alias("line")).alias("seq"))


def discover_logs(spark: SparkSession, base: str | None = None) -> DataFrame:
    """Access-log files under ``base``, each once: (file_path, file_size, file_time).

    Without ``base`` the usual locations are tried.  Only listings are read.
    """
    globs = [f"{base.rstrip('/')}/{g}" for g in LOG_GLOBS] if base else list(DEFAULT_LOG_PATHS)
    found = []
    for glob in globs:
        try:
            found.append(spark.read.format("binaryFile").load(glob).select(
                F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                F.col("modificationTime").alias("file_time")))
        except Exception as missing:  # a glob without a match is not an error
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    if not found:
        return spark.createDataFrame([], "file_path string, file_size bigint, file_time timestamp")
    return reduce(DataFrame.unionByName, found).distinct()


def last_n(lines: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The last ``n`` lines in arrival order (a top-k, never a full sort)."""
    return lines.orderBy(F.col(seq).desc()).limit(n)


def file_profile(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """Per file: size, modification time, gzip flag, lines, first and last record time.

    Every line counts; the times come from the first and last readable record.
    """
    text = trimmed("value")
    record = F.from_json(text, RAW_JSON, {"columnNameOfCorruptRecord": "_corrupt_record"})
    readable = text.startswith("{") & record.isNotNull() & record["_corrupt_record"].isNull()
    timed = lines.select("file_path", "file_size", "file_time", seq,
                         F.when(readable, parse_time(record["time"])).alias("_ts"))
    position = F.when(F.col("_ts").isNotNull(), F.col(seq))
    return timed.groupBy("file_path").agg(
        F.max("file_size").alias("file_size"),
        F.max("file_time").alias("file_time"),
        F.count("*").alias("line_count"),
        F.min_by("_ts", position).alias("first_entry"),
        F.max_by("_ts", position).alias("last_entry"),
    ).withColumn("is_gzipped", F.col("file_path").endswith(".gz"))
