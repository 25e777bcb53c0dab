"""The registered queries of these operators, each over its whole table, and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, brown, jaccard, language, line_templates, media, packing, quality, runs, secrets, sharding, substrings, vector_codes
from .text import documents, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot and shard of every document, over 256 shards."""
    return sharding.place(documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS)


def _placement_sql() -> str:
    """The look-up in SQL; the filled table is given as text, its filling is tested by brute force."""
    table = ",".join(map(str, sharding.fill(SHARDS).tolist()))
    return f"""WITH filled AS (SELECT string_split('{table}', ',') AS t),
      keyed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
      SELECT doc_id, slot, 'shard-' || lpad(t[slot + 1], 3, '0') AS shard FROM keyed, filled"""


ORACLES["op1_shard_placement"] = _placement_sql()


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


@query
def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(documents(spark, sf_dir)))


@query
def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 7) == 2
    scored = brown.fit_and_score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines, and a digest of the text that is left."""
    done = line_templates.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), plain=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op4_line_templates"] = f"WITH {line_templates.oracle()} SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM deduped"


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = documents(spark, sf_dir), public_tokenizers.path(PIECES)
    held_out = remainder("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out), path)
    return language.predict(docs, model, path).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(documents(spark, sf_dir))


@query
def op11_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLES["op11_orchard_codes"] = vector_codes.oracle()


@query
def op12_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, a document a repository."""
    return secrets.scan(documents(spark, sf_dir), owner="source")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapsed(documents(spark, sf_dir), made_periodic=True)
