"""From raw lines to the normalized access-log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.addresses import with_address
from ..functions.text import trimmed
from ..functions.times import float_prefix, int_prefix, parse_time
from ..functions.user_agents import is_bot, is_bot_short, parse_user_agent
from ..schema import HIT_COLUMNS, RAW_JSON, UA
from .lines import read_lines

_STRINGS = ("host", "server_name", "handler", "port", "ssl_protocol", "ssl_cipher", "referer", "remote_user")


def _or_default(ts: Column, default_ts: Column | None) -> list[Column]:
    fallback = F.lit(None).cast("timestamp") if default_ts is None else default_ts.cast("timestamp")
    return [F.coalesce(ts, fallback).alias("ts"), ts.isNull().alias("ts_defaulted")]


def _status(text: Column) -> Column:
    return F.coalesce(int_prefix(text).try_cast("int"), F.lit(0))


def _bytes(text: Column) -> Column:
    return F.coalesce(int_prefix(text), F.lit(0).cast("bigint"))


def _seconds(text: Column) -> Column:
    return F.coalesce(float_prefix(text), F.lit(0.0))


def split_request(request: Column) -> tuple[Column, Column]:
    """(method, path) of a request line.

    No request: both empty.  A request without a path: ``GET`` and ``/``.
    """
    parts = F.split(request, " ")
    complete = F.size(parts) >= 2
    method = F.when(request.isNull(), "").when(complete, F.get(parts, F.lit(0))).otherwise("GET")
    path = F.when(request.isNull(), "").when(complete, F.get(parts, F.lit(1))).otherwise("/")
    return method, path


def normalize(records: DataFrame, record: str = "record", default_ts: Column | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Project a struct of raw JSON fields to the normalized record.

    ``default_ts`` replaces times that are missing or unreadable, flagged by
    ``ts_defaulted``.  Columns named in ``keep`` pass through.
    """
    r = F.col(record)
    method, path = split_request(r["request"])
    agent = r["user_agent"]
    located = records if "_ip" in records.columns else with_address(records, F.coalesce(r["remote_addr"], F.lit("")), "_ip")
    return located.select(
        *keep,
        *_or_default(parse_time(r["time"]), default_ts),
        F.col("_ip").alias("ip"),
        method.alias("method"), path.alias("path"),
        _status(r["status"]).alias("status"),
        _bytes(r["body_bytes_sent"]).alias("bytes_sent"),
        _seconds(r["request_time"]).alias("response_time"),
        F.coalesce(agent, F.lit("")).alias("user_agent"),
        parse_user_agent(agent).alias("ua"),
        F.coalesce(is_bot(agent), F.lit(False)).alias("is_bot"),
        F.coalesce(r["country"], F.lit("")).alias("country"),
        *[F.coalesce(r[name], F.lit("")).alias(name) for name in _STRINGS],
    ).select(*keep, *HIT_COLUMNS)


def _json_record() -> Column:
    return F.from_json(trimmed("value"), RAW_JSON, {"columnNameOfCorruptRecord": "_corrupt_record"})


def _is_object() -> Column:
    text = trimmed("value")
    return text.startswith("{") & text.endswith("}")


def parse_json(lines: DataFrame, default_ts: Column | None = None, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """NDJSON lines to normalized records; blank and malformed lines are dropped."""
    # Exploding a one-element array keeps the check for malformed records above
    # the parse; as a plain projection it would be pushed down and parse twice.
    parsed = lines.where(_is_object()).select(*keep, F.explode(F.array(_json_record())).alias("record"))
    return normalize(parsed.where(F.col("record._corrupt_record").isNull()), default_ts=default_ts, keep=keep)


def rejected_json(lines: DataFrame) -> DataFrame:
    """Number of lines per file-independent outcome: ``accepted``, ``blank``, ``malformed``."""
    blank = trimmed("value") == ""
    good = _is_object() & _json_record()["_corrupt_record"].isNull()
    return lines.groupBy(F.when(blank, "blank").when(good, "accepted").otherwise("malformed").alias("outcome")).count()


def _plain(fields: dict[str, Column], keep) -> list[Column]:
    """A normalized projection in which unnamed columns are empty."""
    out = [F.col(k) for k in keep]
    for name in HIT_COLUMNS:
        if name in fields:
            out.append(fields[name].alias(name))
        elif name == "ua":
            out.append(F.lit(None).cast(UA).alias("ua"))
        elif name == "is_bot":
            out.append(F.lit(False).alias("is_bot"))
        elif name == "bytes_sent":
            out.append(F.lit(0).cast("bigint").alias(name))
        else:
            out.append(F.lit("").alias(name))
    return out


def _tsv_fields(default_ts: Column | None) -> dict[str, Column]:
    part = F.split(F.trim("value"), "\t", -1)

    def field(i: int) -> Column:
        return F.get(part, F.lit(i))

    ts, defaulted = _or_default(F.when(~field(0).rlike(r"^\s*[+-]?[0-9.]+\s*$") & field(0).contains("-"),
                                       parse_time(field(0))), default_ts)
    return {
        "ts": ts, "ts_defaulted": defaulted, "ip": F.col("_ip"),
        "method": field(2), "path": field(3), "status": _status(field(4)), "bytes_sent": _bytes(field(5)),
        "response_time": _seconds(field(6)), "user_agent": field(7), "is_bot": is_bot_short(field(7)),
        "country": field(8), "handler": field(9),
    }


def _single(text: Column) -> Column:
    """An address field that may not be a list."""
    return F.when(~text.contains(","), text).otherwise("")


def _tsv_address() -> Column:
    return _single(F.get(F.split(F.trim("value"), "\t", -1), F.lit(1)))


def _columns_address() -> Column:
    return _single(F.get(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+"), F.lit(3)))


def parse_tsv(lines: DataFrame, default_ts: Column | None = None, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Lines of at least 10 tab-separated fields: time, address, method, path, status,
    bytes, seconds, user agent, country, handler."""
    tabbed = lines.where(F.size(F.split(F.trim("value"), "\t", -1)) >= 10)
    return with_address(tabbed, _tsv_address(), "_ip").select(*_plain(_tsv_fields(default_ts), keep))


def _column_fields(default_ts: Column | None) -> dict[str, Column]:
    part = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    ts, defaulted = _or_default(F.lit(None).cast("timestamp"), default_ts)
    return {
        "ts": ts, "ts_defaulted": defaulted,
        "status": _status(F.get(part, F.lit(0))), "response_time": _seconds(F.get(part, F.lit(1))),
        "country": F.get(part, F.lit(2)), "ip": F.col("_ip"),
        "method": F.get(part, F.lit(4)), "path": F.coalesce(F.get(part, F.lit(5)), F.lit("")),
        "user_agent": F.lit(""),
    }


def parse_columns(lines: DataFrame, default_ts: Column | None = None, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Whitespace-separated ``status seconds country address method path`` lines.

    They carry no time, so ``ts`` is ``default_ts``.  Fewer than 5 fields: dropped.
    """
    whole = lines.where(F.size(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")) >= 5)
    return with_address(whole, _columns_address(), "_ip").select(*_plain(_column_fields(default_ts), keep))


def parse_mixed(lines: DataFrame, default_ts: Column | None = None, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Per line: JSON if it starts with ``{``, tab-separated if it has 10 fields, else columns.

    One scan and one projection; the format decides per row which branch runs.
    """
    text = trimmed("value")
    is_json = text.startswith("{")
    # A tab at the end of a line is an empty last field, so only blanks are trimmed here.
    is_tsv = ~is_json & (F.size(F.split(F.trim("value"), "\t", -1)) >= 10)
    is_columns = ~is_json & ~is_tsv & (F.size(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")) >= 5)
    tagged = lines.where((is_json & text.endswith("}")) | is_tsv | is_columns).select(
        *keep, "value", F.when(is_json, "json").when(is_tsv, "tsv").otherwise("columns").alias("_format"),
        F.explode(F.array(F.when(is_json, _json_record()))).alias("record"))
    tagged = tagged.where(F.col("record._corrupt_record").isNull())
    kind = F.col("_format")
    address = F.when(kind == "json", F.coalesce(F.col("record.remote_addr"), F.lit(""))).when(
        kind == "tsv", _tsv_address()).otherwise(_columns_address())
    tagged = with_address(tagged, address, "_ip")
    json_part = normalize(tagged, default_ts=default_ts, keep=(*keep, "value", "_format", "_ip"))
    tsv = _plain(_tsv_fields(default_ts), ())
    columns = _plain(_column_fields(default_ts), ())
    return json_part.select(*keep, *[
        F.col("_ip").alias("ip") if name == "ip" else
        F.when(kind == "json", F.col(name)).when(kind == "tsv", t).otherwise(c).alias(name)
        for name, t, c in zip(HIT_COLUMNS, tsv, columns)])


def read_access_log(spark: SparkSession, paths: str | list[str], fmt: str = "json",
                    default_ts: Column | None = None) -> DataFrame:
    """Normalized records of log files.  ``fmt``: json, tsv, columns or mixed."""
    parse = {"json": parse_json, "tsv": parse_tsv, "columns": parse_columns, "mixed": parse_mixed}[fmt]
    return parse(read_lines(spark, paths), default_ts=default_ts)
