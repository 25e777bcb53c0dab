"""Running totals per key in arrival order, split so that no key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

CHUNK_ROWS = 1_000_000
# What a line number of the reader counts inside its task.
_LINE_MASK = (1 << 33) - 1
# File splits up to this number are sent to all tasks.
_BROADCAST_SPLITS = 100_000


def chunk_of(df: DataFrame, seq: str = "seq", rows: int = CHUNK_ROWS) -> Column:
    """A coarse, order-preserving part of the arrival key.

    For a number: a range of ``rows`` consecutive values, so that a key has at
    most that many records in a chunk.  For the struct of the file reader: a
    range of ``rows`` lines inside the file split.  For a struct that begins
    with a time: the minute.
    """
    kind = df.schema[seq].dataType
    if not isinstance(kind, T.StructType):
        return F.floor(F.col(seq) / rows)
    names = kind.fieldNames()
    if names[-1] == "line":
        line = F.col(f"{seq}.line").bitwiseAND(_LINE_MASK)
        return F.struct(*[F.col(f"{seq}.{name}") for name in names[:-1]], F.floor(line / rows).alias("lines"))
    if isinstance(kind[names[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("minute", F.col(f"{seq}.{names[0]}"))
    return F.struct(*[F.col(f"{seq}.{name}") for name in names[:-1]])


def number_arrivals(df: DataFrame, seq: str = "seq") -> DataFrame:
    """The arrival struct of the file reader as one BIGINT of the same order.

    Numbers sort and combine faster than structs, so do this once, on a stored
    table, before running many reports.  The file splits are ranked (a short
    list, one entry per read task) and the line is put behind the rank.
    """
    parts = [f"{seq}.{name}" for name in df.schema[seq].dataType.fieldNames()[:-1]]
    keys = [f"_{name.split('.')[-1]}" for name in parts]
    names = df.schema[seq].dataType.fieldNames()
    if names[-1] != "line":
        raise ValueError("made for the arrival key of the file reader")
    ranked = df.select(*[F.col(p).alias(k) for p, k in zip(parts, keys)]).distinct().withColumn(
        "_rank", F.row_number().over(Window.orderBy(*keys)))
    if ranked.limit(_BROADCAST_SPLITS + 1).count() <= _BROADCAST_SPLITS:
        ranked = F.broadcast(ranked)
    line = F.col(f"{seq}.line").bitwiseAND(_LINE_MASK)
    keyed = df.withColumns({k: F.col(p) for p, k in zip(parts, keys)})
    return keyed.join(ranked, keys).withColumn(
        seq, F.shiftleft(F.col("_rank").cast("bigint"), 33) + line).drop(*keys, "_rank")
