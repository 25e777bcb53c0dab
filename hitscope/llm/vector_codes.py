"""Product codes of vectors, with Orchard's search for the nearest entry.

A vector's parts are each replaced by the number of the nearest entry in that
part's codebook, and the codebooks are moved to the means of what they stand
for, a fixed number of rounds.  All numbers are integers, so results don't
depend on how rows are dealt out.

Orchard's search: every entry has the others in order of their distance.  A
part starts at some entry and walks down its list; a closer one found there
becomes the current entry and its list is walked instead, entries measured
before are marked and passed over, and the walk ends at an entry more than
twice as far from the current one as the part is, for no entry behind it can be
closer.  All parts of an Arrow batch walk at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import bounded_batches, over_batches
from .workspace import stored

#: One is this many units.
UNITS = 4096
_LIMB = 32
_LONGEST = 2**63 - 1
#: Totals of so many labels are sent to all tasks (some tens of bytes each); more are joined.
LABELS_SENT = 100_000


@dataclass(frozen=True)
class Codebooks:
    """entries[part, entry, position], integers; a part's entries may repeat."""
    entries: np.ndarray

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    @property
    def size(self) -> int:
        return self.entries.shape[1]

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _squared(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


def _safe(dims: int) -> int:
    """Up to here distances of vectors, and sums of a batch's components, fit 64 bits; larger components are worked on as Python's integers."""
    return math.isqrt(2**60 // max(dims, 1))


def _narrow(values: np.ndarray, dims: int) -> np.ndarray:
    """Python's integers as 64-bit ones where that is safe."""
    if values.dtype == object and (not values.size or max(abs(int(values.max())), abs(int(values.min()))) <= _safe(dims)):
        return values.astype(np.int64)
    return values


class Orchard:
    """The neighbour lists of all codebooks, and the search over them."""

    def __init__(self, books: Codebooks):
        entries = books.entries
        gaps = _squared(entries[:, :, None, :] - entries[:, None, :, :])
        own = np.arange(books.size)
        # by distance, then number; the entry itself first
        ranked = np.empty(gaps.shape, np.int64)
        for p in range(books.parts):
            for e in range(books.size):
                ranked[p, e] = sorted(own.tolist(), key=lambda s: (s != e, gaps[p, e, s], s))
        self.books, self.neighbours = books, ranked[:, :, 1:]
        self.gaps = np.take_along_axis(gaps, self.neighbours, axis=2)

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """values[row, part, position] -> the number of each part's nearest entry (ties: the smallest) and the squared distance."""
        rows, parts, width = values.shape
        flat = values.reshape(rows * parts, width)
        part = np.tile(np.arange(parts), rows)
        entries = self.books.entries
        if entries.dtype == object and flat.dtype != object:
            flat = flat.astype(object)
        now = np.zeros(len(flat), np.int64)
        best = _squared(flat - entries[part, 0])
        seen = np.zeros((len(flat), self.books.size), bool)
        seen[:, 0] = True
        step = np.zeros(len(flat), np.int64)
        walking = np.arange(len(flat)) if self.books.size > 1 else np.zeros(0, np.int64)
        while len(walking):
            p, at, k = part[walking], now[walking], step[walking]
            on = ~(self.gaps[p, at, k] > 4 * best[walking]).astype(bool)  # squares: twice the distance
            walking, p, at, k = walking[on], p[on], at[on], k[on]
            other = self.neighbours[p, at, k]
            new = ~seen[walking, other]
            w, p, o = walking[new], p[new], other[new]
            seen[w, o] = True
            distance = _squared(flat[w] - entries[p, o])
            closer = ((distance < best[w]) | (distance == best[w]) & (o < now[w])).astype(bool)
            step[walking] = k + 1
            jump = w[closer]
            now[jump], best[jump], step[jump] = o[closer], distance[closer], 0
            walking = walking[step[walking] < self.books.size - 1]
        return now.reshape(rows, parts), best.reshape(rows, parts)


def quantised(column: pa.Array, dims: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(4096 x) of the vectors with ``dims`` components, as values[row, part, position], and which rows these are.

    Vectors are filled up with zeros to a multiple of ``parts``.
    """
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
    fits = np.flatnonzero(lengths == dims)
    flat = np.asarray(column.take(pa.array(fits)).flatten()) if dims and len(fits) else np.zeros(0)
    whole = np.floor(flat * UNITS)
    if np.abs(whole).max(initial=0.0) <= _safe(dims):
        values = whole.astype(np.int64)
    else:
        values = np.array([int(x) * UNITS if abs(x) >= 2.0**52 else math.floor(x * UNITS) for x in flat.tolist()], object)
    width = -(-dims // parts)
    out = np.zeros((len(fits), parts * width), values.dtype)
    out[:, :dims] = values.reshape(len(fits), dims)
    return out.reshape(len(fits), parts, width), fits


def finite(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is neither null nor holds a null, NaN or infinite component."""
    at = F.col(vector)
    bad = F.exists(at, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return df.where(at.isNotNull() & ~bad)


def _sums(vectors: DataFrame, books: Codebooks, dims: int) -> DataFrame:
    """(slot, position, limb, value): what each entry's parts add up to, 32 bits a row, and their number as position -1.

    A task adds up all its rows before anything is shuffled.
    """
    slots, search = books.parts * books.size, Orchard(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((slots, books.width), object)
        count = np.zeros(slots, np.int64)
        for batch in batches:
            values, _ = quantised(batch.column(0), dims, books.parts)
            if not len(values):
                continue
            code, _ = search.nearest(values)
            slot = (code + np.arange(books.parts) * books.size).ravel()
            flat = values.reshape(len(slot), books.width)
            for s in np.unique(slot).tolist():
                mine = flat[slot == s]
                total[s] += mine.sum(axis=0).astype(object)  # a batch's sum fits 64 bits: see _safe
                count[s] += len(mine)
        rows = [(s, -1, 0, int(count[s])) for s in range(slots) if count[s]]
        for s, position in np.argwhere(total != 0).tolist():
            value, limb = int(total[s, position]), 0
            while value not in (0, -1):
                rows.append((s, position, limb, value & (1 << _LIMB) - 1))
                value, limb = value >> _LIMB, limb + 1
            if value:
                rows.append((s, position, limb, -1))
        names = ("slot", "position", "limb", "value")
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)

    partial = bounded_batches(vectors).mapInArrow(run, "slot bigint, position bigint, limb bigint, value bigint")
    return partial.groupBy("slot", "position", "limb").agg(F.sum("value").alias("value"))


def _moved(books: Codebooks, sums: list) -> Codebooks:
    count = {r["slot"]: r["value"] for r in sums if r["position"] < 0}
    total = np.zeros((books.parts * books.size, books.width), object)
    for r in sums:
        if r["position"] >= 0:
            total[r["slot"], r["position"]] += r["value"] << _LIMB * r["limb"]
    entries = books.entries.astype(object).reshape(books.parts * books.size, books.width)
    for slot, n in count.items():
        entries[slot] = [int(t) // n for t in total[slot]]
    return Codebooks(_narrow(entries.reshape(books.entries.shape), books.parts * books.width))


def fit(df: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 8, size: int = 16, rounds: int = 6) -> tuple[Codebooks, int]:
    """Codebooks of ``size`` entries for each of ``parts`` parts, from all rows with a finite vector, and the number of components.

    They start as the parts of the ``size`` rows with the smallest keys (equal keys: by vector; null keys last; with
    fewer rows there are fewer entries).  A round gives every part to its nearest entry, ties to the smaller number,
    and moves every entry that has parts to the floor of their mean.  Only vectors as long as the first one count.
    One pass over the rows for each round; ``parts * size * width`` sums come to the driver.
    """
    rows = finite(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector")
    seeds = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(size).collect()
    dims = len(seeds[0]["vector"]) if seeds else 0
    vectors = rows.where(F.size("vector") == dims).select("vector")
    if seeds and any(len(r["vector"]) != dims for r in seeds):
        seeds = rows.where(F.size("vector") == dims).orderBy(F.col("key").asc_nulls_last(), "vector").limit(size).collect()
    start, _ = quantised(pa.array([r["vector"] for r in seeds], pa.large_list(pa.float64())), dims, parts)
    books = Codebooks(_narrow(np.ascontiguousarray(start.transpose(1, 0, 2)), dims))
    for _ in range(rounds if seeds else 0):
        books = _moved(books, _sums(vectors, books, dims).collect())
    return books, dims


def encode(df: DataFrame, books: Codebooks, dims: int, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, label, code, error) of every row with a finite vector.

    ``code`` has two hex digits (more, from 257 entries on) for each part, ``error`` is the sum of the squared
    distances, at most 2**63 - 1.  A vector of another length than ``dims`` has a null code and error.
    """
    key_type, label_type = (df.schema[c].dataType.simpleString() for c in (key, label))
    rows = finite(df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector")
    digits = max(2, -(-(books.size - 1).bit_length() // 4))
    search = Orchard(books)

    def work(batch):
        values, fits = quantised(batch.column("vector"), dims, books.parts)
        code, error = [None] * batch.num_rows, [None] * batch.num_rows
        if len(fits):
            near, distance = search.nearest(values)
            for i, row, total in zip(fits.tolist(), near.tolist(), distance.sum(axis=1).tolist()):
                code[i], error[i] = "".join(f"{e:0{digits}x}" for e in row), min(total, _LONGEST)
        yield {"key": batch.column("key"), "label": batch.column("label"), "code": code, "error": error}

    flat = over_batches(rows, work, f"key {key_type}, label {label_type}, code string, error bigint")
    return flat.withColumnsRenamed({"key": key, "label": label})


def decode(df: DataFrame, books: Codebooks, dims: int, code: str = "code", vector: str = "vector") -> DataFrame:
    """``df`` and the vector that each code stands for, in ones; a null code has a null vector."""
    table = [[[float(x) / UNITS for x in entry] for entry in part] for part in books.entries.tolist()]
    digits = max(2, -(-(books.size - 1).bit_length() // 4))
    lookup = F.array(*[F.array(*[F.array(*map(F.lit, entry)) for entry in part]) for part in table])
    pieces = [F.element_at(F.element_at(lookup, p + 1), F.conv(F.substring(code, 1 + p * digits, digits), 16, 10).cast("int") + 1)
              for p in range(books.parts)]
    return df.withColumn(vector, F.slice(F.concat(*pieces), 1, dims))


def product_codes(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = 8, size: int = 16, rounds: int = 6) -> DataFrame:
    """Per row with a finite vector: key, code, error, label_error (error summed over equal labels, nulls together) and
    codebooks_sha256 (all final entries' components by part, entry, position, joined by commas).

    Rows with a null vector or a null, NaN or infinite component are left out.  An empty table gives no row.  Repeated
    rows count each.  Sums beyond 64 bits are null.  Other columns are not read.
    """
    books, dims = fit(df, vector, key, parts, size, rounds)
    names = {"key": key, "label": label}
    coded = stored(encode(df, books, dims, vector, key, label).withColumnsRenamed({v: k for k, v in names.items()}), "vector-codes")
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    few = totals.limit(LABELS_SENT + 1).count() <= LABELS_SENT
    joined = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle(table: str = "embeddings", vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = 8, size: int = 16, rounds: int = 6) -> str:
    """The rows of ``product_codes`` in DuckDB, for vectors of one length that is a multiple of ``parts``; every entry is measured."""
    steps = [f"""rows_ AS (SELECT {key} AS key, {label} AS label, {vector} AS v, row_number() OVER (ORDER BY {key}) AS r FROM {table}
        WHERE {vector} IS NOT NULL AND len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      parts_ AS (SELECT r, p, list_transform(v[1 + p * len(v) // {parts}: (p + 1) * len(v) // {parts}], lambda x: floor({UNITS} * x::DOUBLE)::BIGINT) AS x
        FROM rows_, range({parts}) AS t(p)),
      book0 AS (SELECT p, r - 1 AS e, x AS y FROM parts_ WHERE r <= {size})"""]
    near = """near{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
        SELECT r, parts_.p, x, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts_ JOIN book{k} USING (p)) GROUP BY r, p)"""
    for k in range(rounds):
        steps.append(near.format(k=k))
        steps.append(f"""moved{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM (
            SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM near{k}, range(1, 1 + (SELECT max(len(x)) FROM parts_)) AS t(i) GROUP BY p, best.e, i) GROUP BY p, e),
          book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y::BIGINT[], b.y) AS y FROM book{k} b LEFT JOIN moved{k} m ON b.p = m.p AND b.e = m.e)""")
    steps.append(near.format(k=rounds))
    return f"""WITH {", ".join(steps)},
      coded AS (SELECT key, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error
        FROM near{rounds} JOIN rows_ USING (r) GROUP BY r, key, label),
      digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
      SELECT key AS {key}, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"""
