"""Operators that compare documents with one another, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from hitscope.llm import brown, components, jaccard, language, line_templates, queries, substrings
from hitscope.llm.text import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def near_copies(seed, groups, size, words=60, vocabulary=400, edits=2):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(vocabulary)}"
            out.append(" ".join(copy))
    return out


SHARED = " ".join(f"s{i}" for i in range(30))
ODD = [None, "", " \n\t", "a", "A", "a b", "a b c", "a b c d", "A B C D", "a b c d e", "a b c d e"] + [SHARED + f" t{i} " * 3 for i in range(9)]
TEXTS = ODD + near_copies(1, 12, 6) + near_copies(2, 1, 60, words=50) + near_copies(3, 4, 10, words=24, edits=1) + [" ".join(f"u{i}_{k}" for k in range(40)) for i in range(20)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    ids = list(range(len(TEXTS)))
    rng.shuffle(ids)
    rows = [(i, t, "x") for i, t in zip(ids, TEXTS)]
    return spark.createDataFrame(rows + rows[:3] + rows[40:45], "doc_id bigint, text string, key string").repartition(5)


def pairs_of(df):
    return sorted({(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}, key=str)


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w)} if 0 < len(w) < 4 else set(zip(w, w[1:], w[2:], w[3:]))


def reference_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("crowded, pivots, sent", [(512, 8, 1 << 20), (3, 2, 1 << 20), (3, 2, 0)])
def test_jaccard(table, monkeypatch, crowded, pivots, sent):
    monkeypatch.setattr(jaccard, "SENT", sent)
    want = reference_classes(pairs_of(table))
    rows = [tuple(r) for r in jaccard.classes(table, crowded=crowded, pivots=pivots).collect()]
    assert set(rows) == want and len(rows) == table.count()
    assert len({c for _, n, c in want if n}) < len({i for i, n, _ in want if n}) - 50


def test_jaccard_on_documents(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        assert {tuple(r) for r in queries.op8_jaccard_join(spark, f"/root/testdata/{sf}").collect()} == reference_classes(pairs_of(docs))


def test_jaccard_odd_keys(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (4, "z"), (4, "a b c d"), (9, "z")], "doc_id bigint, text string")
    got = sorted(map(str, (tuple(r) for r in jaccard.classes(df).collect())))
    assert got == sorted(map(str, [(None, 1, None), (None, 1, None), (5, 1, 4), (4, 1, 4), (4, 1, 4), (9, 1, 4)]))
    assert jaccard.classes(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in jaccard.first_of_each(df.where("doc_id is not null")).collect()) == [4, 4]


def test_crowded_cell_of_few_links(spark, monkeypatch):
    """A cell in which the first pivots have no link: the group that a later pivot finds is settled all the same."""
    rng = np.random.default_rng(11)
    rare = " ".join(f"r{i}" for i in range(40))  # more words in common than a window skips, too few for a link
    texts = [f"{rare} " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 60)) for _ in range(80)]
    group = texts[7]
    near = [f"{group} tail{i}" for i in range(20)]
    measured = []
    settled = jaccard._settled
    monkeypatch.setattr(jaccard, "_settled", lambda state, links, chosen: measured.append(chosen.count()) or settled(state, links, chosen))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + near)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.classes(df, crowded=16, pivots=2).collect()}
    assert got == {(i, i) for i in range(80)} | {(i, 7) for i in range(80, 100)}
    assert measured  # the cell was joined by rounds


def test_links_within_connects_as_all_links():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 10_000, 40).astype(np.uint64)
        sets = []
        for _ in range(12):
            s = base.copy()
            k = rng.integers(0, 4)
            s[:k] = rng.integers(0, 10_000, k).astype(np.uint64)
            sets.append(np.unique(s if rng.random() < 0.8 else rng.integers(0, 10_000, 40).astype(np.uint64)))
        rows = [(i, set(s.tolist())) for i, s in enumerate(sets)]
        linked = {(i, j) for i, a in rows for j, b in rows if i < j and 100 * len(a & b) >= 85 * len(a | b)}
        got = jaccard.links_within(sets)
        assert set(got) <= linked

        def comps(edges):
            label = list(range(len(sets)))
            for _ in sets:
                for i, j in edges:
                    label[i] = label[j] = min(label[i], label[j])
            return label

        assert comps(got) == comps(linked)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges += [(7, 7), (None, 3), (3, 2)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    label = {x: x for e in edges for x in e if None not in e}
    for _ in range(100):
        for a, b in edges:
            if None not in (a, b):
                label[a] = label[b] = min(label[a], label[b])
    assert all(got.get(x, x) == c for x, c in label.items())


def reference_removal(rows, length=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: math.inf if r[0] is None else r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k: k + length]), i)
    out = Counter()
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - length + 1):
            f = first[tuple(w[k: k + length])]
            if f is not None and (i is None or f < i):
                gone.update(range(k, k + length))
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("start", [7, 3, 13, 1])
def test_substrings(table, start):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = Counter(tuple(r) for r in substrings.digests(table, start=start).collect())
    assert got == reference_removal(rows)
    assert sum(r[2] for r in got) > 1_000


def test_substrings_odd_keys(spark):
    rows = [(None, SHARED), (3, SHARED + " more"), (3, SHARED), (1, None), (None, SHARED), (8, " " + SHARED + "\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in substrings.digests(df).collect()) == reference_removal(rows)
    assert substrings.digests(df.limit(0)).count() == 0
    left = {(r["doc_id"], r["text"]) for r in substrings.dedup_passages(df).collect()}
    assert left == {(3, SHARED + " more"), (3, SHARED), (1, None), (8, " " + " " * 29 + "\n"), (None, " " * 29)}
    assert substrings.lengths(3, 13) == [3, 6, 12, 13] and substrings.lengths(7, 13) == [7, 13] and substrings.lengths(13, 13) == [13]


def test_substrings_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(tuple(r) for r in queries.op9_substring_dedup(spark, SF).collect()) == reference_removal([(r["doc_id"], r["text"]) for r in docs.collect()])


def plain_lines(rows, depth=3, min_docs=3, min_fixed=0.5, min_share=0.1, plain=False):
    """Line templates by dictionaries."""
    mask = lambda words: tuple("<*>" if re.search("[0-9]", t) else t for t in words)
    lines = [(i, n, tuple(WORD.findall(line))) for i, t in rows if t is not None for n, line in enumerate(t.split("\n")) if WORD.search(line)]
    leaf = lambda t: (len(t), t[:depth])
    docs = defaultdict(set)
    for i, _, w in lines:
        docs[leaf(mask(w))].add(i)
    kinds = defaultdict(set)
    for i, _, w in lines:
        if len(docs[leaf(mask(w))]) >= min_docs:
            kinds[mask(w)].add(i)
    support, groups = Counter(), defaultdict(list)

    def without(t):
        for k in range(depth, len(t)):
            others = [j for j, x in enumerate(t) if x != "<*>" and j != k]
            if any(j >= depth for j in others) and len(others) >= min_fixed * len(t):
                yield k, (leaf(t), k, t[:k] + t[k + 1:])

    for t, ids in kinds.items():
        for k, x in enumerate(t):
            support[leaf(t), k, x] += len(ids)
        for _, g in without(t):
            groups[g].append(len(ids))
    form = {}
    for t in kinds:
        need = max(min_docs, min_share * len(docs[leaf(t)]))
        fixed = [x != "<*>" and support[leaf(t), k, x] >= need for k, x in enumerate(t)]
        if any(fixed[depth:]) and sum(fixed) >= min_fixed * len(t):
            form[t] = ("share", leaf(t), tuple(x if f else "<*>" for x, f in zip(t, fixed)))
        else:
            wide = [(sum(groups[g]), -k, g) for k, g in without(t) if len(groups[g]) > 1 and sum(groups[g]) >= min_docs]
            if wide:
                form[t] = ("one", max(wide, key=lambda x: x[:2])[2])
    template = lambda w: form.get(mask(w)) or ("alone", w if plain else mask(w))
    have = defaultdict(set)
    for i, _, w in lines:
        if mask(w) in kinds:
            have[template(w)].add(i)
    gone = defaultdict(set)
    for i, n, w in lines:
        if mask(w) in kinds and len(have[template(w)]) >= min_docs and i != min(have[template(w)]):
            gone[i].add(n)
    return Counter((i, 0 if t is None else t.count("\n") + 1, len(gone[i]), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])) for i, t in rows)


def test_line_templates(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(["Posted by user%d on day %d in the forum" % (i, i * 3), "", f"own words of document number{i} " + " ".join(f"q{rng.randrange(9999)}" for _ in range(9)),
                           rng.choice(["the cat sat on a red mat", "the cat sat on a blue mat", "the cat sat on a green mat", "All pages of this site"])])) for i in range(20)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "All pages of this site\nAll pages of this site")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, template int").repartition(3)
    done = line_templates.dedup_lines(df)
    assert done.columns == ["doc_id", "text", "template", "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in done.collect())
    assert got == plain_lines(rows)
    assert "Posted" in next(t for i, *_, t in got if i == 0) and "Posted" not in next(t for i, *_, t in got if i == 5)
    assert line_templates.dedup_lines(df.limit(0)).count() == 0


def test_line_templates_oracle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_templates.dedup_lines(docs).collect())
    assert got == plain_lines([(r["doc_id"], r["text"]) for r in docs.collect()]) and sum(r[2] for r in got) > 100
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = Counter(con.execute(queries.ORACLES["op4_line_templates"]).fetchall())
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op4_line_templates(spark, "/root/testdata/sf0.01").collect()) == want


def forward(word, p):
    """Probability of a word, summed over all segmentations, the slow way."""
    total = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - language.LONGEST_PIECE), e):
            total[e] += total[s] * p.get(tuple(word[s:e]), 0.0)
    return total[-1]


def test_language_forward_sums():
    import pyarrow as pa

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = language.pieces_of(path)
    rng = np.random.default_rng(1)
    p = rng.random((2, pieces.n))
    p /= p.sum(axis=1, keepdims=True)
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            t = model.id_to_piece(i)
            c = (int(t[3:5], 16),) if model.is_byte(i) else ((language._BLANK,) if t[0] == "▁" else ()) + tuple(t.lstrip("▁").encode() if t[0] == "▁" else t.encode())
            if "▁" not in t[1:] and 0 < len(c) <= language.LONGEST_PIECE:
                numbers.setdefault(c, len(numbers))
    for b in range(257):
        numbers.setdefault((b,), len(numbers))
    assert len(numbers) == pieces.n
    texts = language.Texts(pa.array(["the THE été", "internationalisation " + "x" * 70]))
    runs = language.Runs(texts)
    got = language.log_probabilities(pieces, runs, p)
    for k in range(2):
        by = {c: p[k, i] for c, i in numbers.items()}
        for word in ("the", "été", "internationalisation"):
            codes = [language._BLANK, *word.encode()]
            at = next(i for i in range(runs.n) if bytes(runs.buffer[runs.words.starts[runs.first[i]]: runs.words.ends[runs.first[i]]]).decode() == word)
            assert got[at, k] == pytest.approx(math.log(forward(codes, by)), rel=1e-9)
    # expected counts: as many bytes in the expected pieces as in the words
    counts = language.expected_counts(pieces, runs, np.zeros(runs.n, np.int64), runs.counts.astype(float), p)
    assert (counts[0] * pieces.lengths).sum() == pytest.approx(sum(len(w.encode()) + 1 for w in ("the", "the", "été", "internationalisation")) + 71)


def test_language(spark):
    got = queries.op7_language(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)


def test_language_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    train = spark.createDataFrame([("the house and the tree", "en"), ("das haus und der baum", "de"), (None, "de"), ("x", None)], "text string, lang string")
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "12 34 !", "k"), (4, "the tree", "k"), (4, "der baum", "k"), (None, "é", "k"), (6, "y" * 9_000, "k")], "doc_id bigint, text string, key string")
    got = sorted(((r[0] or 0, r[1]) for r in language.predict(df, language.fit(train, path), path).collect()))
    assert got[1:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "de")] and got[5] == (4, "en") and got[0][1] != "und" and got[6][1] != "und"
    nothing = language.fit(train.limit(0), path)
    assert {r["lang_pred"] for r in language.predict(df, nothing, path).collect()} == {"und"}
    assert language.predict(df.limit(0), nothing, path).count() == 0


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(text or "")]


def test_brown_base_and_gain(spark):
    got = {r["doc_id"]: r for r in queries.op3_brown_lm(spark, "/root/testdata/sf0.01").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    counts = Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words_of(t) + [""])
    total, distinct = sum(counts.values()), len(counts)
    gain = known = 0
    for i, t in docs.items():
        tokens, r = words_of(t) + [""], got[i]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        if r["held_out"]:
            gain += r["score"] - base
            known += len(tokens)
    assert gain / known > 0.05, gain / known


def test_brown_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["the", "a"]) + " " + rng.choice(["cat", "dog", "Bird1", "été"]) + " " + rng.choice(["sat", "ran", f"z{rng.randrange(50)}"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    train = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id bigint, text string")
    old = brown.CLUSTERED
    brown.CLUSTERED = 0.02
    try:
        model, vocabulary = brown.fit(train)
    finally:
        brown.CLUSTERED = old
    assert np.allclose((10 ** model.log_transition).sum(axis=1), 1)
    # one-word texts: P(w, end | start) over the vocabulary and one unseen word of each shape
    known = sorted({w for t in lines for w in words_of(t)})
    df = spark.createDataFrame([(i, w) for i, w in enumerate(known)], "doc_id bigint, text string")
    scores = [r["score"] for r in brown.score(df, model, vocabulary).collect()]
    emission = defaultdict(float)
    end = brown.CLASSES + brown.SHAPES
    import pyarrow as pa
    words = brown.Words(brown.Texts(pa.array(known)), fold=True)
    at = model.clustered.find(words.hashes)
    c = np.where(at >= 0, model.clustered.values[1][at], brown.CLASSES + brown._shapes(words))
    got = {r["doc_id"]: r["score"] for r in brown.score(df, model, vocabulary).collect()}
    for i, k in enumerate(c):
        emission[k] += 10 ** (got[i] - model.log_transition[end, k] - model.log_transition[k, end])
    for k, e in emission.items():
        unseen = 10 ** -model.log_mass[k] if k >= brown.CLASSES else 0.0
        assert e + unseen == pytest.approx(1)
    assert len(scores) == len(known) and len(set(c[at >= 0])) > 1


def test_brown_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "a b", 5), (2, "a b", 5), (None, "c", 5)], "doc_id bigint, text string, row int")
    held = remainder("doc_id", 7) == 2
    for train in (df.where(~held), df.limit(0)):
        model, vocabulary = brown.fit(train)
        rows = brown.score(df, model, vocabulary).collect()
        assert sorted(r["n_tokens"] for r in rows) == [1, 1, 2, 3, 3] and all(math.isfinite(r["score"]) for r in rows)
        assert brown.score(df.limit(0), model, vocabulary).count() == 0


def brown_corpus(spark):
    """Four kinds of words that only their neighbours tell apart, each word rarer than the marks; and words that occur once."""
    rng = random.Random(4)
    kinds = [[f"{rng.randrange(10**6):06d}{k}e" for _ in range(30)] for k in range(4)]
    marks = ["ab", "cd", "ef", "gh"]
    lines = []
    for i in range(400):
        words = []
        for _ in range(12):
            k = rng.randrange(4)
            words += [marks[k], rng.choice(kinds[k]), marks[(k + 1) % 4]]
        lines.append(" ".join(words + [f"once{i}e"]))
    return kinds, spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string").repartition(3)


def test_brown_rare_words_are_clustered(spark, monkeypatch):
    import pyarrow as pa
    kinds, train = brown_corpus(spark)
    monkeypatch.setattr(brown, "CLUSTERED", 0.05)
    monkeypatch.setattr(brown, "PIECE", 1000)
    scores = []
    for listed in (1e-6, 0.05):  # all words looked up from the broadcast table, or all but the marks by the join
        monkeypatch.setattr(brown, "LISTED", listed)
        model, vocabulary = brown.fit(train)
        c = {r["w"]: r["c"] for r in vocabulary.collect()}
        of = [{c[int(h)] for h in brown.Words(brown.Texts(pa.array(k)), fold=True).hashes.view(np.int64)} for k in kinds]
        assert max(max(x) for x in of) < brown.CLASSES and sum(map(len, of)) == len(set.union(*of)), of
        scores.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in brown.score(train, model, vocabulary).collect()})
    for i, row in scores[0].items():
        assert row == pytest.approx(scores[1][i])
    at_once = brown.fit_and_score(train, brown.F.lit(True)).collect()
    assert {r["doc_id"]: r["score"] for r in at_once} == pytest.approx({i: row[2] for i, row in scores[1].items()})


def test_brown_rounds_raise_the_likelihood(spark, monkeypatch):
    import pyarrow as pa
    kinds, train = brown_corpus(spark)
    monkeypatch.setattr(brown, "HELD", 100)
    first = brown.Words(brown.Texts(pa.array([" ".join(w for k in kinds for w in k[:2])])), fold=True).hashes
    start = brown.Lookup(first, np.full(8, 40), np.arange(8))
    contexts = brown.count_contexts(train.select(brown.F.col("text").cast("binary").alias("text")), start)
    counts = {r["w"]: r for r in contexts.collect()}
    words = Counter(w for r in train.collect() for w in words_of(r["text"]))
    assert sorted(r["n"] for r in counts.values()) == sorted(words.values())
    likelihood = []
    for rounds in range(4):
        by_class = defaultdict(Counter)
        classes = {r["w"]: r["c"] for r in brown.exchange(contexts, start, rounds)[0].collect()}
        for w, r in counts.items():
            by_class[classes[w]].update(dict(zip(r["cells"], r["counts"])))
        totals = {c: sum(x.values()) / 2 for c, x in by_class.items()}
        likelihood.append(sum(n * math.log((n + brown.PRIOR) / (totals[c] + brown.PRIOR * brown.CONTEXTS)) for c, x in by_class.items() for n in x.values()))
        assert all(classes[w] >= brown.CLASSES for w, r in counts.items() if r["n"] == 1)
    assert likelihood[1] > likelihood[0] and likelihood[3] >= likelihood[2] >= likelihood[1] - 1e-6, likelihood
