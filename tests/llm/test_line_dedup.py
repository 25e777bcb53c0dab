"""Line templates at several sizes and on numeric rows."""

import hashlib
import random

import pytest

import corpus_pipeline
from hitscope.llm import line_templates, queries


def shares(spark, rows, **options):
    """Dropped lines by document."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return {r["doc_id"]: r["n_dropped"] for r in line_templates.dedup_lines(df, **options).collect()}


@pytest.mark.parametrize("size", [50, 2_000])
def test_a_template_is_found_at_every_size(spark, size):
    rng = random.Random(5)
    word = lambda k: chr(97 + k // 10) + chr(97 + k % 10)
    rows = [(i, f"Last updated by name{word(rng.randrange(100))} in topic{word(rng.randrange(100))}") for i in range(size)]
    dropped = sum(shares(spark, rows).values())
    assert dropped >= 0.9 * size


def test_numeric_rows_of_their_own_stay(spark, tmp_path):
    rows = [(i, f"{i}.5 {3 * i}.1 2019\n{i} of 7\n1.5 2.5 2020") for i in range(20)]
    want = {i: "\n".join(t.split("\n")[: 2 + (i == 0)]) for i, t in rows}
    spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_line_templates(spark, docs, str(tmp_path)).collect()} == want
    digests = {r["doc_id"]: r["kept_sha256"] for r in queries.op4_line_templates(spark, str(tmp_path)).collect()}
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_no_task_of_line_dedup_has_two_python_processes(spark, monkeypatch):
    """Processes stay between tasks, so two in one task are four for every two cores in all that follows."""
    plans, stored = [], line_templates.stored

    def seen(df, purpose):
        plans.append(df._jdf.queryExecution().analyzed().toString().count("MapInArrow"))
        return stored(df, purpose)

    monkeypatch.setattr(line_templates, "stored", seen)
    line_templates.dedup_lines(spark.createDataFrame([(i, f"same line {i % 2}") for i in range(9)], "doc_id bigint, text string"), plain=True).collect()
    assert len(plans) > 3 and max(plans) == 1
