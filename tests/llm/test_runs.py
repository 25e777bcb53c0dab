"""Periodic runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from hitscope.llm import runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and not any(q % p == 0 and all(w[t] == w[t + p] for t in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(key, text, made_periodic=True):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(b"" if key is None else str(key).encode())
    if made_periodic and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


ODD = [None, "", " \n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "a b c " * 4, "a b c " * 3 + "a b", "a a b " * 9 + "a a a a a a a", "naïve 日本語\x0b" * 8,
       "one two " * 6_000, "z " * 20_001 + "end", "tick tock tick tock tick tock tick tock boom " * 5, "a" * 300_000, "<a> " * 7 + "\x00 " * 7]


@pytest.mark.parametrize("table", ["odd", "given"])
def test_rows(spark, table):
    if table == "odd":
        rows = list(enumerate(ODD)) + [(12, ODD[12]), (12, ODD[12]), (None, "p q r s " * 40), (None, None)]
        rows += [(1000 + i, " ".join(f"w{(i * j) % 97}" for j in range(i))) for i in range(0, 260, 5)]  # some of them made periodic
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    else:
        df = spark.read.parquet(f"{SF}/documents.parquet")
        rows = [(r["doc_id"], r["text"]) for r in df.collect() if len(WORD.findall(r["text"] or "")) < 3_000]
        df = df.join(spark.createDataFrame([(k,) for k, _ in rows], "doc_id bigint"), "doc_id", "left_semi")
    done = runs.collapsed(df, made_periodic=True)
    small = [(k, t) for k, t in rows if len(WORD.findall(t or "")) < 3_000]
    got = [tuple(r) for r in done.collect()]
    assert len(got) == len(rows)
    keys = {k for k, _ in small}
    assert sorted((g for g in got if g[0] in keys), key=str) == sorted((plain_row(k, t) for k, t in small), key=str)
    if table == "odd":
        by_key = {g[0]: g for g in got}
        if zlib.crc32(b"12") % 10:
            assert by_key[12][1:6] == (1, 0, 20_001, 1, 20_001_000)
        assert {zlib.crc32(str(k).encode()) % 10 for k, _ in rows} >= {0}


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_many_shapes():
    rng = random.Random(1)
    for _ in range(600):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            n = rng.randrange(0, 120)
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 20))]
            nested = [0] * rng.randrange(1, 15) + [1] * rng.randrange(1, 4)
            docs.append(rng.choice([[rng.randrange(2) for _ in range(n)], [rng.randrange(50) for _ in range(n)], thue_morse(n), fibonacci(n),
                                    [5] * rng.randrange(5) + unit * rng.randrange(9) + [6] * rng.randrange(9), (nested * rng.randrange(1, 9))[rng.randrange(3):]]))
        bounds = np.cumsum([0] + [len(d) for d in docs])
        start, end, period = runs.find_runs(np.array([x for d in docs for x in d], np.uint64), bounds)
        want = [(s + int(bounds[i]), length, q) for i, d in enumerate(docs) for s, length, q in plain_runs(d)]
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == want, docs


def test_hashes_that_agree_by_chance_are_cut():
    text = np.array([1, 1, 1, 1, 1, 1, 2, 3, 9])
    cut = runs._confirmed(text, np.array([[0, 8, 1]]), np.array([0]), np.array([8]))
    assert cut.tolist() == [[0, 6, 1]]


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    values = rng.permutation(1000)
    tree = runs.WaveletMatrix(values.astype(np.int32), 10)
    lo = rng.integers(0, 900, 200)
    hi = lo + rng.integers(1, 100, 200)
    x, n = rng.integers(0, 1000, 200), rng.integers(0, hi - lo)
    assert tree.count_below(lo, hi, x).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]
    assert tree.nth(lo, hi, n).tolist() == [int(np.sort(values[a:b])[c]) for a, b, c in zip(lo, hi, n)]


def test_text_and_columns(spark):
    rows = [(7, "no " * 6 + "more of this " * 4, 1, 2, 3, "s", "t")]
    df = spark.createDataFrame(rows, "id int, words string, key int, h int, runs int, start string, text string")
    done = runs.collapsed(df, text="words", key="id", with_text=True).collect()
    assert [(r["id"], r["n_runs"], r["text_left"], [tuple(x) for x in r["runs"]]) for r in done] == [(7, 2, "no more of this", [(0, 6, 1), (6, 12, 3)])]
    assert runs.collapsed(spark.createDataFrame([], "doc_id int, text string")).collect() == []
