"""Product codes with Orchard's search, against SQL and plain Python."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from hitscope.llm import vector_codes as vc
from hitscope.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, parts=8, size=16, rounds=6):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label) rows whose vectors have one length."""
    rows = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-len(rows[0][1]) // parts) if rows else 0

    def cut(v):
        whole = [int(x) * 4096 if abs(x) > 2**52 else math.floor(4096 * x) for x in v] + [0] * (parts * width - len(v))
        return [whole[p * width: (p + 1) * width] for p in range(parts)]

    cuts = [cut(v) for _, v, _ in rows]
    books = [[c[p] for c in cuts[:size]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cuts:
                groups.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(xs) // len(xs) for xs in zip(*groups[e])] if e in groups else y for e, y in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cuts]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, l), e in zip(rows, error):
        total[l] = total.get(l, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), err, total[l], digest) for (i, _, l), f, err in zip(rows, found, error)), key=str)


def got(df, **names):
    return sorted(map(tuple, vc.product_codes(df, **names).collect()), key=str)


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(ORACLES["op11_orchard_codes"]).fetchall()
    df = QUERIES["op11_orchard_codes"](spark, SF)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("kind", ["even", "ties", "few rows", "odd length", "large", "huge"])
def test_against_plain_python(spark, kind):
    rng = random.Random(kind)
    n, dims = {"few rows": 5, "large": 24}.get(kind, 120), (13 if kind == "odd length" else 16)
    scale = {"large": 4e5, "huge": 1e30}.get(kind, 1)
    value = (lambda: rng.randrange(-2, 3) / 4) if kind == "ties" else (lambda: rng.gauss(0, 0.2) * scale)
    rows = [(i, [float(np.float32(value())) for _ in range(dims)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(500, None, 1), (501, [None] * dims, 1), (502, [float("nan")] * dims, 1), (503, [float("-inf")] + [0.0] * (dims - 1), None), (3, rows[3][1], 1), (None, rows[4][1], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    want = plain(rows)
    if kind == "huge":  # sums of squares beyond 64 bits
        want = sorted(((i, c, min(e, 2**63 - 1), None, d) for i, c, e, _, d in want), key=str)
        assert all(r[3] is None or r[3] == 2**63 - 1 for r in got(df)) and [r[:3] + r[4:] for r in got(df)] == [r[:3] + r[4:] for r in want]
    else:
        assert got(df) == want


def test_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    assert got(spark.createDataFrame([], schema)) == [] == got(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], schema))
    assert [r[1] for r in got(spark.createDataFrame([(1, [], 1), (2, [], None)], schema))] == ["00" * 8] * 2
    other = got(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 9, 1), (3, [1.0] * 8, 2)], schema))
    assert [r[1:4] for r in other] == [("00" * 8, 0, 0), (None, None, 0), ("00" * 8, 0, 0)]
    clash = spark.createDataFrame([(i, [i / 9] * 8, i % 2, 0, 0, 0, 0, 0) for i in range(30)],
                                  "key bigint, vector array<double>, of int, vec_id int, code int, error int, label_error int, label int")
    assert got(clash, key="key", vector="vector", label="of") == plain([(i, [i / 9] * 8, i % 2) for i in range(30)])


def test_search_visits_few_and_is_exact():
    rng = np.random.default_rng(3)
    books = vc.Codebooks(rng.integers(-9, 10, (4, 32, 3)))
    values = rng.integers(-9, 10, (500, 4, 3))
    code, distance = vc.Orchard(books).nearest(values)
    every = ((values[:, :, None, :] - books.entries[None]) ** 2).sum(axis=-1)
    assert (code == every.argmin(axis=2)).all() and (distance == every.min(axis=2)).all()


def test_decode(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    books, dims = vc.fit(df)
    for r in vc.decode(vc.encode(df, books, dims).limit(5), books, dims).collect():
        entries = [int(r["code"][2 * p: 2 * p + 2], 16) for p in range(8)]
        assert r["vector"] == [x / 4096 for p, e in enumerate(entries) for x in books.entries[p, e].tolist()]
