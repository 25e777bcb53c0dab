"""Access-log analytics on Spark: DataFrame in, DataFrame out."""

from .sources.records import normalize, parse_columns, parse_json, parse_mixed, parse_tsv, read_access_log
from .sources.lines import discover_logs, file_profile, last_n, read_lines
from .sources.days import select_day, select_history
from .streaming.sources import stream_access_log

__all__ = [
    "normalize", "parse_columns", "parse_json", "parse_mixed", "parse_tsv", "read_access_log",
    "discover_logs", "file_profile", "last_n", "read_lines", "select_day", "select_history", "stream_access_log",
]
