"""Packing of token sequences into bins of fixed capacity.

Only the lengths decide which pieces share a sequence, and a length is a
number from 1 to the capacity.  So the plan is made on the histogram of
lengths, whose size is fixed by the capacity however many pieces there are:
sets of lengths that provably may be packed together (dominance reduction)
are fixed first, many copies at a time; what is left is packed best fit in
decreasing order, again many copies at a time.  The plan then deals the pieces
out by their rank among those of equal length, which is counted in parallel.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import codec
from .text import fresh, named, over_batches
from .workspace import stored

CAPACITY = 2_048


@dataclass
class Plan:
    """Patterns: how many sequences are made of these lengths, in order of offset."""
    capacity: int
    patterns: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)  # (sequences, ((length, how many), ...))

    def sequences(self) -> int:
        return sum(n for n, _ in self.patterns)


class _Stock:
    """How many pieces of each length are left, with the lengths present in order."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {k: int(v) for k, v in histogram.items() if v > 0}
        self.lengths = sorted(self.left)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def at_most(self, room: int) -> int | None:
        i = bisect.bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else None

    def below(self, length: int | None) -> int | None:
        return None if length is None else self.at_most(length - 1)

    def without_one(self, length: int) -> set[int] | dict[int, int]:
        """The lengths that are left when one piece of ``length`` is taken."""
        return self.left if self.left[length] > 1 else self.left.keys() - {length}

    def two_smallest(self, but: int) -> float:
        """The least two pieces together weigh, one piece of length ``but`` aside."""
        low = []
        for x in self.lengths[:3]:
            low += [x] * min(2, self.left[x] - (x == but))
        return sum(low[:2]) if len(low) > 1 else float("inf")


def reduce_by_dominance(stock: _Stock, plan: Plan) -> None:
    """Fixes sets that dominate every other set with their largest piece.

    Taken from the largest length j down, with room r left beside it:
    nothing fits in r: {j} alone; a piece of exactly r is left: {j, r}
    (whatever else shares a sequence with j weighs no more than r and can go
    where that piece was); or no two pieces fit in r together: {j, largest
    that fits}.  In each case some best packing has this set, so fixing it
    loses nothing.
    """
    for j in reversed(list(stock.lengths)):
        while (have := stock.left.get(j)):
            room = plan.capacity - j
            rest = stock.without_one(j)
            best = next((x for x in (stock.at_most(room), stock.below(stock.at_most(room))) if x is not None and x in rest), None)
            if best is None:  # nothing else fits; with more than one j, j itself doesn't
                plan.patterns.append((have, ((j, 1),)))
                stock.take(j, have)
                continue
            if best != room and stock.two_smallest(j) <= room:
                break
            # Taking pieces away only makes the smallest ones larger, so what holds for one copy holds for all.
            n = have // 2 if best == j else min(have, stock.left[best])
            plan.patterns.append((n, ((j, 2),) if best == j else ((j, 1), (best, 1))))
            stock.take(j, n)
            stock.take(best, n)


def best_fit(stock: _Stock, plan: Plan) -> None:
    """Best fit in decreasing order for what is left; equal lengths and equal rooms are handled together."""
    rooms: dict[int, list[list]] = {}  # room -> [sequences, contents]
    keys: list[int] = []

    def put(room: int, n: int, contents: tuple) -> None:
        if room not in rooms:
            rooms[room] = []
            bisect.insort(keys, room)
        rooms[room].append([n, contents])

    for length in sorted(stock.left, reverse=True):
        have = stock.left[length]
        while have:
            i = bisect.bisect_left(keys, length)
            if i == len(keys):
                fit = plan.capacity // length
                full, rest = divmod(have, fit)
                if full:
                    put(plan.capacity - fit * length, full, ((length, fit),))
                if rest:
                    put(plan.capacity - rest * length, 1, ((length, rest),))
                have = 0
                continue
            room = keys[i]
            n, contents = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(i)
            # best fit would return to the same sequence while it has room for more of this length
            each = min(room // length, have)
            used = min(n, max(1, have // each))
            if used < n:
                put(room, n - used, contents)
            put(room - each * length, used, contents + ((length, each),))
            have -= used * each
    for groups in rooms.values():
        for n, contents in groups:
            plan.patterns.append((n, contents))


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for a histogram of lengths from 1 to ``capacity``."""
    if any(not 0 < k <= capacity for k in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    plan, stock = Plan(capacity), _Stock(histogram)
    reduce_by_dominance(stock, plan)
    best_fit(stock, plan)
    return plan


def places(plan: Plan) -> dict[int, dict[str, np.ndarray]]:
    """For each length: from which rank on a pattern's pieces are used, and where they stand in it."""
    columns: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_sequence = 0
    for n, contents in plan.patterns:
        offset = 0
        for length, each in contents:
            columns.setdefault(length, []).append((used.get(length, 0), first_sequence, offset, each))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        first_sequence += n
    return {k: dict(zip(("rank", "sequence", "offset", "each"), np.array(v, np.int64).T)) for k, v in columns.items()}


def pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0,
           with_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, and ids if asked for.

    A document is its ids and then ``end_id``; only one longer than the
    capacity is cut, every piece but its last full.  A null text is empty, so
    its one piece is the end id alone.  Rows with equal or null keys each have
    their own pieces.
    """
    key_type = df.schema[key].dataType.simpleString()
    end, step = end_id.to_bytes(4, "little"), 4 * capacity
    schema = f"key {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def work(batch):
        c = codec(path)
        keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
        for at in range(0, len(texts), 256):
            out = {name: [] for name in ("key", "piece", "start", "length", "ids_crc32")}
            ids = []
            for k, t in zip(keys[at: at + 256], texts[at: at + 256]):
                raw = c.raw(t or b"") + end
                for i in range(0, len(raw), step):
                    part = raw[i: i + step]
                    for name, value in (("key", k), ("piece", i // step), ("start", i // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                        out[name].append(value)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            yield out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {})

    rows = named(df, key=key, text=F.col(text).cast("binary"))
    return over_batches(rows, work, schema, keep=True).withColumnRenamed("key", key)


def pack(df: DataFrame, length: str = "length", capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """``df`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity``, gapless from offset 0.

    The driver sees the histogram of lengths and the plan, both bounded by the
    capacity.  Ranks among equal lengths are counted within (length, salt)
    groups, so a length that a third of all pieces have is no single task.
    ``df`` is read more than once: hand in a stored table.  Columns named
    sequence_id and offset are replaced.  Which of several equal pieces comes
    first is not said.
    """
    spark = df.sparkSession
    base = df.drop("sequence_id", "offset")
    counted = base.groupBy(F.col(length).cast("bigint").alias("n")).agg(F.count("*").alias("c"))
    histogram = {r["n"]: r["c"] for r in counted.limit(capacity + 2).collect()}
    if any(k is None or not 0 < k <= capacity for k in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    table = places(make_plan(histogram, capacity))
    total = sum(histogram.values())
    salts = salts or max(total // 20_000, min(64, total // 500)) or 1
    salt, of, group, count, ahead, within, rank = (fresh(name, base.columns) for name in ("salt", "length", "group", "n", "before", "in", "rank"))
    salted = base.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in base.columns if base.schema[c].dataType.typeName() != "array"]), F.lit(salts)).cast("int"))
    groups = salted.groupBy(F.col(length).alias(of), F.col(salt).alias(group)).agg(F.count("*").alias(count))
    before = F.sum(count).over(Window.partitionBy(of).orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select(of, group, F.coalesce(before, F.lit(0)).alias(ahead))
    inner = F.row_number().over(Window.partitionBy(length, salt).orderBy(*[c for c in base.columns if base.schema[c].dataType.typeName() != "array"])) - 1
    ranked = (salted.withColumn(within, inner)
              .join(starts, (F.col(length) == F.col(of)) & (F.col(salt) == F.col(group)))
              .withColumn(rank, F.col(within) + F.col(ahead)).drop(within, ahead, of, group, salt))
    shared = spark.sparkContext.broadcast(table)
    schema = ranked.drop(rank).schema
    names = schema.fieldNames()

    def assign(batches):
        plan = shared.value
        for batch in batches:
            lengths = batch.column(names.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                p = plan[int(n)]
                row = np.searchsorted(p["rank"], ranks[at], "right") - 1
                rest, each = ranks[at] - p["rank"][row], p["each"][row]
                sequence[at] = p["sequence"][row] + rest // each
                offset[at] = p["offset"][row] + rest % each * n
            arrays = [batch.column(i) for i in range(len(names))] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + ["sequence_id", "offset"])

    from pyspark.sql import types as T
    return ranked.mapInArrow(assign, T.StructType(schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def packed(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents to placed pieces; the pieces are written once, as both the histogram and the placing read them."""
    return pack(stored(pieces(df, path, text, key, capacity, end_id, with_ids), "pieces"), capacity=capacity)
