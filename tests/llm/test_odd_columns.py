"""Extra columns of any name, repeated keys and templates that must not take what is unique."""

import random
from collections import Counter

import duckdb
import pytest

from hitscope.llm import jaccard, line_templates, packing, queries, quality, substrings
from tests.llm.test_corpus_operators import plain_lines

CLASH = ("gone", "gone_key", "_gone", "_gone_key", "_dropped", "_key", "key", "_later", "line_no", "template", "n", "s", "t", "cell", "first", "rest", "row", "leaf")
PACK = ("_rank", "_salt", "_in", "_before", "_length", "_group", "_n", "rank")


def long_text(i):
    return " ".join(f"w{(i * k) % 41}x{k}" for k in range(60))


@pytest.mark.parametrize("stage", [quality.accepted, lambda d: line_templates.dedup_lines(d, plain=True), lambda d: jaccard.first_of_each(d), substrings.dedup_passages])
def test_clashing_columns_are_kept(spark, stage):
    rows = [(i, f"Line one of it {i}\n{long_text(i // 2)}.", *[f"{c}{i}" for c in CLASH]) for i in range(6)] + [(None, None, *CLASH)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in CLASH))
    out = stage(df)
    assert out.columns[: len(df.columns)] == df.columns
    for r in out.collect():
        assert all(r[c] == (c if r["doc_id"] is None else f"{c}{r['doc_id']}") for c in CLASH)


def test_packing_keeps_columns(spark):
    df = spark.createDataFrame([(i, 1 + i % 7, *[f"{c}{i}" for c in PACK]) for i in range(40)], "doc_id int, length bigint, " + ", ".join(f"{c} string" for c in PACK))
    out = packing.pack(df, capacity=9).collect()
    assert len(out) == 40 and all(r[c] == f"{c}{r['doc_id']}" for r in out for c in PACK)


def test_rows_of_one_key_with_different_texts(spark):
    a, b = long_text(1), " ".join(f"other{k}" for k in range(31))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (8, "alone in the world of words"), (9, None), (None, a), (9, ""), (5, a)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = Counter((r["doc_id"], r["component_id"]) for r in jaccard.classes(df).collect())
    assert found == Counter({(5, 5): 3, (6, 5): 1, (7, 5): 1, (8, 8): 1, (9, 9): 2, (None, None): 1})


def dropped(spark, texts, plain=True):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_templates.dedup_lines(df, plain=plain).collect())
    assert got == plain_lines(rows, plain=plain)
    if plain:
        con = duckdb.connect()
        pandas = df.toPandas()  # noqa: F841
        con.execute("CREATE VIEW documents AS SELECT * FROM pandas")
        assert Counter(con.execute(f"WITH {line_templates.oracle()} SELECT doc_id, n_lines, n_dropped, text FROM deduped").fetchall()) == got
    return sum(r[2] * n for r, n in got.items())


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_a_common_opening_is_no_template(spark):
    assert dropped(spark, [f"There is a {word(3 * i)} {word(3 * i + 1)} {word(3 * i + 2)}" for i in range(500)]) == 0


def test_many_templates_in_one_leaf(spark):
    texts = [f"It was the {' '.join(word(1000 * (i % 20) + k) for k in range(3))} {word(90_000 + i)} {word(500 + i % 20)} end{word(i % 20)}" for i in range(2_000)]
    assert dropped(spark, texts) == 1_980


def test_a_leading_field_without_digits_is_not_found(spark):
    """The stated limit: 0 of 500; with digits it is a field."""
    assert dropped(spark, [f"{word(i)} posted this message to the public board today" for i in range(500)]) == 0
    assert dropped(spark, [f"user{i} posted this message to the public board today" for i in range(500)]) == 499


def test_short_lines(spark):
    assert dropped(spark, [f"{word(i)} {word(i + 1)}\nsee also" for i in range(300)]) == 299
    assert dropped(spark, [f"{i}.5 {3 * i}.1 2019" for i in range(50)]) == 0 < dropped(spark, [f"{i}.5 {3 * i}.1 2019" for i in range(50)], plain=False)


@pytest.mark.parametrize("seed", range(3))
def test_random_lines_in_three_ways(spark, seed):
    rng = random.Random(seed)
    texts = ["\n".join(" ".join(rng.choice(["the", "a", "cat", "dog", "sat", "ran", f"n{rng.randrange(5)}", "x"]) for _ in range(rng.randrange(0, 8))) for _ in range(rng.randrange(0, 6)))
             for _ in range(120)] + [None, ""]
    assert dropped(spark, texts) > 0 and dropped(spark, texts, plain=False) > 0


def test_null_and_repeated_keys_of_lines(spark):
    rows = [(None, "Same line in all"), (None, "Same line in all"), (1, "Same line in all"), (1, "Same line in all"), (2, "Same line in all"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["n_dropped"]) for r in line_templates.dedup_lines(df, plain=True).collect())
    assert got == Counter({(None, 1): 2, (1, 0): 2, (2, 1): 1, (3, 0): 1, (4, 0): 1})
    assert set(queries.ORACLES) >= {"op4_line_templates"}
