"""Streams of normalized records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..sources import records
from ..sources.growing import SPLIT_BYTES, follow_lines
from ..sources.lines import stream_lines

_PARSERS = {"json": records.parse_json, "tsv": records.parse_tsv, "columns": records.parse_columns, "mixed": records.parse_mixed}


def stream_access_log(spark: SparkSession, folder: str, fmt: str = "json", default_ts: Column | None = None,
                      max_files_per_trigger: int = 100, ordered: bool = False) -> DataFrame:
    """Normalized records of log files as they land in ``folder``.

    The parsing is the one of the batch reader.  ``ordered`` adds the arrival key ``seq`` that
    ``stream_ip_threats`` needs.
    """
    return _PARSERS[fmt](stream_lines(spark, folder, max_files_per_trigger, ordered), default_ts=default_ts,
                         keep=("file_path", "seq") if ordered else ("file_path",))


def follow_access_log(spark: SparkSession, folder: str, fmt: str = "json", default_ts: Column | None = None,
                      pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Normalized records of log files that grow in ``folder``, with ``file_path`` and the arrival key ``seq``.

    As ``stream_access_log``, for files that are still written to and rotated; see ``sources.growing``.
    """
    return _PARSERS[fmt](follow_lines(spark, folder, pattern, split_bytes), default_ts=default_ts, keep=("file_path", "seq"))
