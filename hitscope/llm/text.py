"""Words, lines and n-grams of whole Arrow batches, as numpy arrays.

A batch's texts lie one after the other in one byte buffer, so words and
windows of all its documents are found by a few vector operations instead of
a loop over words.  Equal words have equal 64-bit hashes; different words or
windows share one with a chance of about 2**-64 for each pair, which the
operators that compare hashes accept.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bytes that end a word: space and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
#: The same codes, A to Z taken as a to z.
_FOLDED_CODES = _BYTE_CODES.copy()
_FOLDED_CODES[65:91] = _BYTE_CODES[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers = {}
#: Powers that a worker keeps from one block to the next, 8 bytes each; a longer text has its own table.
POWERS_KEPT = 1 << 22


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and, up to a bound, kept."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.ones(1, np.uint64)
        while len(table) < n:
            table = np.concatenate([table, table * np.uint64(pow(base, len(table), 2**64))])
        if len(table) <= POWERS_KEPT:
            _powers[base] = table
    return table[:n]


_remembered: list[Callable[[], None]] = []


def remembers(clear: Callable[[], None]) -> None:
    """``clear`` empties what this worker remembers for the next task of the same kind."""
    _remembered.append(clear)


def forget() -> None:
    """What tasks of another kind left in this worker goes, before a task begins."""
    for clear in _remembered:
        clear()


def give_back() -> None:
    """Hands free memory to the system: workers stay between tasks, what they no longer use should not."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = _BYTE_CODES) -> np.ndarray:
    """A hash of each byte span of ``buffer``, from one running sum over the buffer."""
    n = len(buffer)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[buffer] * _power_table(_BASE, n), out=running[1:])
    local = (running[ends] - running[starts]) * _power_table(_BASE_INVERSE, n + 1)[starts]
    return mix(local + (ends - starts).astype(np.uint64))


class Texts:
    """The texts of one Arrow column: bytes, and where each document begins and ends."""

    def __init__(self, column: pa.Array):
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary())
        column = column.cast(pa.large_binary()).fill_null(b"")
        self.n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.buffer = data[offsets[0]: offsets[-1]]
        self.bounds = offsets - offsets[0]

    def document(self, i: int) -> bytes:
        return self.buffer[self.bounds[i]: self.bounds[i + 1]].tobytes()

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


class Words:
    """All words of a batch, in order: byte spans, hashes, and their documents."""

    def __init__(self, texts: Texts, fold: bool = False):
        b = texts.buffer
        inside = ~IS_SPACE[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = texts.bounds[(texts.bounds > 0) & (texts.bounds < len(b))]
        first[edges] = inside[edges]  # a document's end ends its last word
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
        self.texts = texts
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.hashes = span_hashes(b, self.starts, self.ends, _FOLDED_CODES if fold else _BYTE_CODES)
        #: Where each document's words begin; one more entry than documents.
        self.bounds = np.searchsorted(self.starts, texts.bounds)
        self.counts = np.diff(self.bounds)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a window of ``length`` words begins, and the windows' hashes."""
        h, n = self.hashes, len(self.hashes)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = self.documents()
        total = np.zeros(n - length + 1, np.uint64)
        for k in range(length):
            total = total * np.uint64(_BASE_INVERSE) + h[k: n - length + 1 + k]
        at = np.flatnonzero(doc[: n - length + 1] == doc[length - 1:])
        return at, mix(total[at] + np.uint64(length))


class Lines:
    """The lines of a batch's documents: from a document's start and after each \\n, to the next \\n or the document's end."""

    def __init__(self, texts: Texts):
        breaks = np.flatnonzero(texts.buffer == 10)
        starts = np.concatenate([texts.bounds[:-1], breaks + 1])
        owner = np.concatenate([np.arange(texts.n), np.searchsorted(texts.bounds, breaks, "right") - 1])
        order = np.lexsort((owner, starts))  # an empty last line begins where the next document does
        self.starts, self.doc = starts[order], owner[order]
        self.ends = np.empty_like(self.starts)
        if len(self.starts):
            self.ends[:-1] = np.where(self.doc[1:] == self.doc[:-1], self.starts[1:] - 1, texts.bounds[self.doc[:-1] + 1])
            self.ends[-1] = texts.bounds[self.doc[-1] + 1]
        #: Numbers from 0 within a document.
        self.number = np.arange(len(self.starts)) - np.searchsorted(self.doc, self.doc)


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's bigint."""
    return h.view(np.int64)


def named(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the given columns, under names of our own."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def fresh(name: str, columns: list[str]) -> str:
    """``name``, made longer until none of ``columns`` is called so, in any case."""
    taken = {c.lower() for c in columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of text that are worked on at once.
BLOCK = 2 << 20


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices whose longest column holds about ``limit`` bytes; a longer row is a slice of its own."""
    for batch in batches:
        if batch.nbytes <= limit:
            yield batch
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                sizes = np.maximum(sizes, pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total + size > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "double": pa.float64(), "boolean": pa.bool_(),
          "string": pa.string(), "binary": pa.binary()}


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return _ARROW[kind.simpleString()]


def over_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, block: int = BLOCK,
                 keep: bool = False) -> DataFrame:
    """``work`` gives the columns of zero or more output batches for each input batch.  With ``keep`` it uses what its
    worker remembers of earlier tasks; else that is forgotten."""
    target = pa.schema([(f.name, _arrow_type(f.dataType)) for f in T.StructType.fromDDL(schema).fields])

    def run(batches):
        if not keep:
            forget()
        for batch in blocks(batches, block):
            for columns in work(batch):
                arrays = [a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type)
                          for f, a in ((f, columns[f.name]) for f in target)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
                del arrays, columns
            del batch
        give_back()

    return bounded_batches(df).mapInArrow(run, schema)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text (a null key: the empty text), modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


#: Bytes of an Arrow batch on its way to Python.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after a bound on Arrow batches is set for its session where it has none.

    Spark counts rows only, and ten thousand texts may be any number of bytes; both the executor and its Python
    worker hold a batch several times over.
    """
    if df.sparkSession.conf.get(_ARROW_LIMIT, None) is None:
        df.sparkSession.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    return df


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
