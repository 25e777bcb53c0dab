"""The landed log: files of a bounded size, in order of arrival."""

from pathlib import Path

import __spark_entry__ as entry
from registry import streams
from registry.view import hits

SF = "/root/testdata/sf0.001"


def test_landed_files_do_not_grow_with_the_log(spark, monkeypatch):
    rows = hits(spark, SF).count()
    monkeypatch.setattr(streams, "LINES_A_FILE", rows // 12)
    files = sorted(Path(streams._land(spark, SF).removeprefix("file:")).rglob("part-*.txt"))
    sizes = [len(f.read_text().splitlines()) for f in files]
    assert sum(sizes) == rows and max(sizes) < rows // 6 and len(files) > 6
    assert [f.stat().st_mtime_ns for f in files] == sorted({f.stat().st_mtime_ns for f in files})
    arrived = [r["ip"] for r in hits(spark, SF, True).orderBy("seq").select("ip").collect()]
    landed = [line.split('"remote_addr":"')[1].split('"')[0] for f in files for line in f.read_text().splitlines()]
    assert landed == arrived


def test_threats_of_many_files_equal_the_batch_profile(spark, monkeypatch):
    monkeypatch.setattr(streams, "LINES_A_FILE", hits(spark, SF).count() // 12)
    got = {tuple(r) for r in entry.queries()["stream_log_threats"](spark, SF).collect()}
    assert got == {tuple(r) for r in entry.queries()["ip_profile_from_files"](spark, SF).collect()} and got
