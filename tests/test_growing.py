"""Files that are appended to, renamed, truncated and cut into ranges while a stream follows them."""

import json
import random

import pytest

from hitscope import stream_access_log  # noqa: F401
from hitscope.sources import growing
from hitscope.streaming import sinks
from hitscope.streaming.sources import follow_access_log


def ranges(reader, start):
    end = reader.latestOffset()
    out = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            out += [(r["value"], r["file_path"], r["split"] * growing._FIELD + r["line"]) for r in batch.to_pylist()]
    return out, end


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_every_line_once_whatever_the_ranges(tmp_path, split):
    rng = random.Random(split)
    lines = ["first"] + ["".join(rng.choice("abé ") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    (tmp_path / "a.log").write_bytes("\n".join(lines).encode() + b"\nhalf a li")
    reader = growing._Reader(str(tmp_path), "*.log", split)
    got, end = ranges(reader, reader.initialOffset())
    assert [v for v, _, _ in got] == lines
    data = (tmp_path / "a.log").read_bytes()
    assert all(data[p:].startswith(v.encode() + b"\n") for v, _, p in got)
    assert ranges(reader, end)[0] == []
    with (tmp_path / "a.log").open("ab") as f:
        f.write(b"ne\r\nnext\n\n")
    assert [v for v, _, _ in ranges(reader, end)[0]] == ["half a line", "next", ""]


def test_rotation_by_name(tmp_path):
    log, old = tmp_path / "access.log", tmp_path / "access.log.1"
    reader = growing._Reader(str(tmp_path), "access.log*", 10)
    log.write_text("one\ntwo\n")
    got, end = ranges(reader, reader.initialOffset())
    with log.open("a") as f:
        f.write("three\n")  # not read before it is renamed
    old.write_bytes(log.read_bytes())
    log.write_text("four\n")
    more, end = ranges(reader, end)
    assert [v for v, _, _ in got + more] == ["one", "two", "three", "four"] and {p for _, p, _ in more} == {str(old), str(log)}
    # a range that was planned before the files changed names finds its file
    with log.open("a") as f:
        f.write("five\n")
    planned = reader.partitions(end, reader.latestOffset())
    (tmp_path / "access.log.2").write_bytes(old.read_bytes())
    old.write_bytes(log.read_bytes())
    log.write_text("six\n")
    assert [r for p in planned for b in reader.read(p) for r in b.column("value").to_pylist()] == ["five"]
    log.write_text("")
    old.write_text("other\n")
    with pytest.raises(FileNotFoundError):
        [list(reader.read(p)) for p in planned]


def test_copy_and_truncate(tmp_path):
    log = tmp_path / "access.log"
    reader = growing._Reader(str(tmp_path), "*", 10)
    log.write_text("one\ntwo\n")
    got, end = ranges(reader, reader.initialOffset())
    with log.open("a") as f:
        f.write("three\n")
    (tmp_path / "access.log.1").write_bytes(log.read_bytes())  # a copy is the same file
    more, end = ranges(reader, end)
    log.write_text("")
    log.write_text("four\n")
    last, _ = ranges(reader, end)
    assert [v for v, _, _ in got + more + last] == ["one", "two", "three", "four"]


def test_odd_files(tmp_path):
    reader = growing._Reader(str(tmp_path / "none"), "*", 10)
    assert reader.latestOffset() == {"files": {}} and reader.partitions({"files": {}}, {"files": {}}) == []
    (tmp_path / "empty").write_text("")
    (tmp_path / "open").write_text("no end yet")
    (tmp_path / "long").write_bytes(b"x" * (growing._HEAD + 5))
    (tmp_path / "bad").write_bytes(b"\xff\xfe\n")
    reader = growing._Reader(str(tmp_path), "*", 10)
    got, end = ranges(reader, reader.initialOffset())
    assert [v for v, _, _ in got] == ["��"]
    with (tmp_path / "long").open("ab") as f:
        f.write(b"y\nz\n")
    assert [len(v) for v, _, _ in ranges(reader, end)[0]] == [growing._HEAD + 6, 1]
    (tmp_path / "same").write_bytes(b"\xff\xfe\nmore\n")
    (tmp_path / "bad").write_bytes(b"\xff\xfe\nother\n")
    with pytest.raises(ValueError, match="same line"):
        reader.latestOffset()


def record(i):
    return json.dumps({"time": f"2024-01-01T00:00:{i:02d}Z", "remote_addr": "1.2.3.4", "request": f"GET /{i} HTTP/1.1", "status": "200"}) + "\n"


def test_a_stream_over_a_rotated_log_equals_a_batch(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()
    log = folder / "access.log"

    def run():
        stream = follow_access_log(spark, str(folder), pattern="access.log*", split_bytes=150).select("path", "seq")
        sinks.append_to_files(stream, out, str(tmp_path / "cp")).awaitTermination()

    log.write_text("".join(map(record, range(5))) + record(5)[:20])
    run()
    with log.open("a") as f:
        f.write(record(5)[20:] + record(6))
    (folder / "access.log.1").write_bytes(log.read_bytes())
    log.write_text("".join(map(record, range(7, 12))))
    run()
    run()  # nothing new
    got = spark.read.parquet(out).collect()
    assert sorted(r.path for r in got) == sorted(f"/{i}" for i in range(12))
    assert [r.path for r in sorted((r for r in got if r.path in ("/0", "/3", "/4")), key=lambda r: r.seq)] == ["/0", "/3", "/4"]
