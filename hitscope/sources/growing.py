"""Following log files that still grow, and are rotated.

A stream source of complete lines whose offsets are the number of bytes read of
each file.  New bytes are cut into ranges, and each range is a task; the driver
reads no more of a file than its first line and its end.

A file is known by its first line and not by its name, so it may be renamed
(``access.log`` to ``access.log.1``) or copied and truncated at any time: what
was not read yet is read under its new name, and nothing is read twice.  Two
files of different content that begin with the same line are refused.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: At most so much of a first line tells a file.
_HEAD = 64 << 10
_BLOCK = 1 << 20
#: Bytes of a range, unless ``split_bytes`` says otherwise, and of an Arrow batch.
SPLIT_BYTES = 64 << 20
_BATCH_BYTES = 4 << 20
#: Offsets are given as two numbers, as the arrival key's last field holds 33 bits.
_FIELD = 1 << 30

_SCHEMA = "value string, file_path string, time bigint, split bigint, line bigint"
_ARROW = pa.schema([("value", pa.string()), ("file_path", pa.string()), ("time", pa.int64()), ("split", pa.int64()), ("line", pa.int64())])


@dataclass
class _Range(InputPartition):
    """Lines that begin in [start, end) of the file with this first line; its lines are complete up to ``limit``."""
    key: str
    name: str
    time: int
    origin: int
    start: int
    end: int
    limit: int


def _identity(file) -> str | None:
    """The first line's hash; None where there is no complete line yet."""
    head = file.read(_HEAD)
    line, newline, _ = head.partition(b"\n")
    return hashlib.sha256(line).hexdigest() if newline or len(head) == _HEAD else None


def _complete(file, size: int) -> int:
    """How far the complete lines of the first ``size`` bytes go."""
    while size > 0:
        start = max(0, size - _BLOCK)
        file.seek(start)
        found = file.read(size - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        size = start
    return 0


class GrowingFiles:
    """The files of a folder by their identity."""

    def __init__(self, folder: str, pattern: str):
        self.store, self.path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.pattern = pattern

    def infos(self) -> list[fs.FileInfo]:
        found = self.store.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        return [f for f in found if f.is_file and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name, self.pattern)]

    def listed(self) -> dict[str, dict]:
        """Identity -> name, time and complete bytes."""
        files: dict[str, dict] = {}
        for info in sorted(self.infos(), key=lambda f: f.path):
            try:
                with self.store.open_input_file(info.path) as file:
                    size = file.size()
                    key = _identity(file)
                    if key is None:
                        continue
                    entry = {"name": info.path, "time": (info.mtime_ns or 0) // 1000, "end": _complete(file, size)}
            except FileNotFoundError:  # renamed meanwhile: under its new name it is in this listing or the next
                continue
            if key in files:
                shorter, longer = sorted((files[key], entry), key=lambda e: e["end"])
                self._same(shorter, longer)
                entry = longer
            files[key] = entry
        return files

    def _same(self, shorter: dict, longer: dict) -> None:
        with self.store.open_input_file(shorter["name"]) as a, self.store.open_input_file(longer["name"]) as b:
            if a.read(min(shorter["end"], _BLOCK)) != b.read(min(shorter["end"], _BLOCK)):
                raise ValueError(f"{shorter['name']} and {longer['name']} begin with the same line and go on differently")

    def open(self, key: str, name: str, limit: int):
        """The file with this identity and at least ``limit`` bytes, under the expected name or another."""
        for path in dict.fromkeys([name, *(f.path for f in self.infos())]):
            try:
                file = self.store.open_input_file(path)
            except FileNotFoundError:
                continue
            if _identity(file) == key and file.size() >= limit:
                return file
            file.close()
        raise FileNotFoundError(f"{name} is gone, before all of it was read")


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, split_bytes: int):
        self.folder, self.pattern, self.split_bytes = folder, pattern, split_bytes

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": GrowingFiles(self.folder, self.pattern).listed()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for key, file in sorted(end["files"].items(), key=lambda kv: (kv[1]["time"], kv[1]["name"])):
            origin, limit = start["files"].get(key, {"end": 0})["end"], file["end"]
            for at in range(origin, limit, self.split_bytes):
                out.append(_Range(key, file["name"], file["time"], origin, at, min(at + self.split_bytes, limit), limit))
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with GrowingFiles(self.folder, self.pattern).open(partition.key, partition.name, partition.limit) as file:
            yield from _lines(file, partition)


def _lines(file, part: _Range) -> Iterator[pa.RecordBatch]:
    at = part.start
    if at > part.origin:  # a line that began before belongs to the range before
        file.seek(at - 1)
        at -= 1
        while True:
            block = file.read(min(_BLOCK, part.limit - at))
            found = block.find(b"\n")
            if found >= 0 or not block:
                at += found + 1 if found >= 0 else 0
                break
            at += len(block)
    while at < part.end:
        file.seek(at)
        block = file.read(min(_BATCH_BYTES, part.limit - at))
        last = block.rfind(b"\n")
        while last < 0 and at + len(block) < part.limit:  # a line longer than a block
            block += file.read(min(_BATCH_BYTES, part.limit - at - len(block)))
            last = block.rfind(b"\n")
        if last < 0:
            raise ValueError(f"{part.name}: its lines have changed")
        lines, places, place = [], [], at
        for line in block[:last].split(b"\n"):
            if place >= part.end:
                break
            lines.append(line.removesuffix(b"\r").decode(errors="replace"))
            places.append(place)
            place += len(line) + 1
        at = place
        n = len(lines)
        yield pa.RecordBatch.from_arrays([
            pa.array(lines, pa.string()), pa.array([part.name] * n, pa.string()), pa.array([part.time] * n, pa.int64()),
            pa.array([p // _FIELD for p in places], pa.int64()), pa.array([p % _FIELD for p in places], pa.int64())], schema=_ARROW)


class GrowingLog(DataSource):
    """Options: ``folder`` (a path or URI that Arrow can open on all machines), ``pattern`` of names, ``split_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["folder"], self.options.get("pattern", "*"), int(self.options.get("split_bytes", SPLIT_BYTES)))


def follow_lines(spark: SparkSession, folder: str, pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Stream of (value, file_path, seq): the complete lines of the files in ``folder``, as they grow.

    A line waits until its end is written.  Files that are compressed later should leave ``pattern``, and be compressed
    only once they are read.  ``seq`` is time of the file, file, and place in the file, the order within a
    micro-batch; a micro-batch takes all that is there, in tasks of ``split_bytes``.
    """
    spark.dataSource.register(GrowingLog)
    lines = spark.readStream.format("growing_log").option("folder", folder).option("pattern", pattern).option("split_bytes", split_bytes).load()
    return lines.select("value", "file_path", F.struct("time", F.col("file_path").alias("file"), "split", "line").alias("seq"))
