"""The pipeline: every stage against a brute-force version on its own input, and what the driver's contract says of it."""

from collections import Counter

import public_tokenizers
import pytest
from test_corpus_operators import plain_lines, reference_removal
from test_scan_operators import reference_quality
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from hitscope.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_registered():
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5
    assert {f"op{n}_" for n in range(1, 14)} == {name[: name.index("_") + 1] for name in entry.queries() if name.startswith("op") and name[2].isdigit()}


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes
        assert df.where("n_chars <> length(text)").count() == 0


def test_quality_stage(steps):
    judged = {r["doc_id"]: r for r in quality.clean_lines(steps[0]).collect()}
    base = {i: reference_quality(t)[-1] for i, t in texts(steps[0])}
    kept = dict(texts(steps[1]))
    assert kept == {i: r["cleaned"] for i, r in judged.items() if r["kept"]} and not any(base[i] for i in kept)
    assert 0 < len(kept) < len(base)


def test_line_stage(steps):
    want = Counter((i, t) for i, _, _, t in plain_lines(texts(steps[1])).elements())
    assert Counter(texts(steps[2])) == want and want != Counter(texts(steps[1]))


def test_copies_stage(steps):
    rows, sets, parent = texts(steps[2]), {}, {}
    for i, t in rows:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in (t or "").encode().decode().replace("\v", " ").replace("\f", " ").split(" ")]
        w = [y for x in w for y in x.replace("\t", "\n").replace("\r", "\n").split("\n") if y]
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k: k + 5]) for k in range(len(w) - 4)}
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    assert {i for i, _ in texts(steps[3])} == {i for i in ids if find(i) == i}
    assert dict(texts(steps[3])).items() <= dict(rows).items() and len(texts(steps[3])) < len(rows)


def test_passages_stage(steps):
    want = {i: (n, gone) for i, n, gone, _ in reference_removal(texts(steps[3]))}
    after = {i: len((t or "").split()) for i, t in texts(steps[4])}
    assert set(after) == set(want) and sum(g for _, g in want.values()) > 0
    assert all(after[i] == n - g for i, (n, g) in want.items())


def test_packing_stage(steps):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by, places = {}, {}
    for r in steps[5].orderBy("doc_id", "piece").collect():
        assert r["length"] == len(r["ids"]) and r["start"] == len(by.get(r["doc_id"], []))
        by[r["doc_id"]] = by.get(r["doc_id"], []) + r["ids"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by == {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in texts(steps[4])}
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(places) <= sum(map(len, by.values())) / 2048 * 1.02 + 1


def test_run_equals_the_stages(spark, steps):
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    got = Counter(tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter(tuple(r[c] for c in columns) for r in steps[5].collect())


def test_stages_on_odd_documents(spark):
    words = " ".join(f"word{i} is here." for i in range(30))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, words, "en", "a", 1), (3, words, "en", "a", 1), (4, words + " more", "en", "b", 2), (None, words, None, None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert (docs.count() > 0) == bool(table)
