"""The corpus pipeline: from documents to packed training sequences.

Each stage works on what the one before it kept, written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hitscope.llm import jaccard, line_templates, packing, quality, substrings
from hitscope.llm.queries import ORACLES, QUERIES, TOKENIZER
from hitscope.llm.text import documents
from hitscope.llm.workspace import stored

#: Near copies share five-word shingles to 80 % or more.
WIDTH, PERCENT = 5, 80


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; in the others failing lines go."""
    return quality.with_char_count(quality.accepted(docs))


def drop_line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur go, but for the first document that has them; every document stays."""
    return quality.with_char_count(line_templates.dedup_lines(docs, plain=True).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest doc_id stays."""
    return jaccard.first_of_each(docs, width=WIDTH, percent=PERCENT)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has too go; every document stays."""
    return quality.with_char_count(substrings.dedup_passages(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their places in sequences of at most 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", clean_lines),
    ("line dedup", drop_line_templates),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Tokenizing and packing can't be said in SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs


QUERIES["pipeline"] = run
__all__ = ["ORACLES", "ORACLE_SQL", "QUERIES", "STAGES", "run"]
