"""Line deduplication by a fixed-depth tree of line templates, as for logs.

A line is parsed by its number of tokens and then by its leading tokens; both
together are its leaf.  Tokens with a digit count as a variable field from the
start.  Within a leaf, a token that a share of the leaf's documents have at the
same place, and enough of them, is fixed, any other is a variable field.  That
must fix a token beyond the leading ones, which the leaf fixes anyway.  Where
many templates share a leaf, none of their tokens has such a share; lines are
then compared with the others of the leaf, one place left out at a time, and
those that agree everywhere else share a template with one field.  Any other
line stands for itself.  Templates that occur in many documents are dropped.

All of it is grouping and joining: no leaf is ever held by one task.  Leaves
that too few documents reach fall away before any token is looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Lines, Texts, Words, fresh, mix, named, over_batches, signed
from .workspace import stored

DEPTH = 3
MIN_DOCS = 3
#: A fixed token is in this share of its leaf's documents; values that are spread wider are a field's.
MIN_SHARE = 0.1
#: A template needs this share of fixed tokens; else the line stands for itself.
MIN_FIXED = 0.5
FIELD = "<*>"
_BLANKS = r"[\x20\x09-\x0D]+"
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIELD_HASH = np.uint64(0x46494C44)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Parsed:
    """Tokens of a batch's lines; those with a digit have the hash of a field, as the token ``<*>`` itself has."""

    def __init__(self, column: pa.Array, lines: bool):
        texts = Texts(column)
        words = Words(texts)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[texts.buffer])])
        field = digits[words.ends] > digits[words.starts]
        mark = Words(Texts(pa.array([FIELD.encode()]))).hashes[0]
        self.plain = words.hashes
        self.tokens = np.where(field | (words.hashes == mark), _FIELD_HASH, words.hashes)
        self.lines = Lines(texts) if lines else None
        starts = self.lines.starts if lines else texts.bounds[:-1]
        ends = self.lines.ends if lines else texts.bounds[1:]
        self.first, past = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
        self.size = past - self.first
        self.texts = texts

    def leaves(self, depth: int) -> np.ndarray:
        """By number of tokens and leading tokens."""
        h = mix(self.size.astype(np.uint64))
        padded = np.append(self.tokens, np.uint64(0))
        for k in range(depth):
            token = padded[np.minimum(self.first + k, len(padded) - 1)]
            h = np.where(self.size > k, mix(h * _STEP + token), h)
        return h

    def kinds(self, tokens: np.ndarray) -> np.ndarray:
        """By all of ``tokens``: those with fields, or the plain ones."""
        line = np.repeat(np.arange(len(self.size)), self.size)
        place = (np.arange(len(line)) - np.repeat(np.cumsum(self.size) - self.size, self.size)).astype(np.uint64)
        at = np.repeat(self.first, self.size) + place.astype(np.int64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens[at] + place * _STEP), dtype=np.uint64)])
        ends = np.cumsum(self.size)
        return mix(total[ends] - total[ends - self.size])


def template_lines(df: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED, min_share: float = MIN_SHARE, plain: bool = False) -> DataFrame:
    """(key, line_no, template, n_docs, first_key) of every line whose template occurs in ``min_docs`` documents or more.

    ``line_no`` counts from 0; lines without a token have no template.
    ``template`` is a number, equal for lines of one template.  Rows with the
    same key are one document.  Null texts have no lines; documents with a null
    key together count as one.  Tokens are told apart by 64-bit hashes.
    A line that no template of the leaf fits shares its own only with equal lines; without ``plain``, also with lines
    that differ in tokens with digits.  A field among the leading ``depth`` tokens is found only where it has a digit.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = named(df, key=key, text=F.col(text).cast("binary")).where("text is not null")

    def leaves(batch):
        parsed = _Parsed(batch.column("text"), True)
        real = parsed.size > 0
        doc, leaf = parsed.lines.doc[real], parsed.leaves(depth)[real]
        order = np.lexsort((leaf, doc))
        doc, leaf = doc[order], leaf[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (leaf[1:] != leaf[:-1])
        yield {"leaf": signed(leaf[new]), "key": batch.column("key").take(pa.array(doc[new]))}

    reached = over_batches(rows, leaves, f"leaf bigint, key {key_type}").distinct().groupBy("leaf").agg(F.count("*").alias("n"))
    busy_leaves = stored(reached.where(F.col("n") >= min_docs).select("leaf", F.col("n").alias("leaf_docs")), "leaves")

    def lines(batch):
        parsed = _Parsed(batch.column("text"), True)
        real = np.flatnonzero(parsed.size > 0)
        at = parsed.lines
        raw = parsed.texts.buffer.tobytes()
        kind = signed(parsed.kinds(parsed.tokens)[real])
        yield {"leaf": signed(parsed.leaves(depth)[real]), "kind": kind, "alone": signed(parsed.kinds(parsed.plain)[real]) if plain else kind, "key": batch.column("key").take(pa.array(at.doc[real])), "line_no": at.number[real],
               "line": [raw[s:e] for s, e in zip(at.starts[real].tolist(), at.ends[real].tolist())]}

    # Kinds are told in the same pass: a second one after the join would have a Python process of its own in each task, where the join is a broadcast.
    found = over_batches(rows, lines, f"leaf bigint, kind bigint, alone bigint, key {key_type}, line_no int, line binary")
    busy = stored(found.join(busy_leaves.select("leaf"), "leaf"), "template-lines")

    # how many documents have each different line; only leaves with several of them, or with fields, need a look at their tokens
    kinds = stored(busy.groupBy("leaf", "kind", "key").agg(F.first("line").alias("line"), F.bool_or(F.col("kind") != F.col("alone")).alias("fields"))
                   .groupBy("leaf", "kind").agg(F.count("*").alias("docs"), F.first("line").alias("line"), F.bool_or("fields").alias("fields")), "kinds")
    several = kinds.groupBy("leaf").agg(F.count("*").alias("n"), F.bool_or("fields").alias("fields")).where("n > 1 or fields").select("leaf").join(busy_leaves, "leaf")

    def tokens(batch):
        parsed = _Parsed(batch.column("line"), False)
        row = np.repeat(np.arange(len(parsed.size)), parsed.size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(parsed.size) - parsed.size, parsed.size)
        take = pa.array(row)
        # the line without this token, where enough of it is left: one token beyond the leading ones at least
        said = parsed.tokens != _FIELD_HASH
        others = np.bincount(row, said, len(parsed.size))[row] - said
        beyond = np.bincount(row, said & (at >= depth), len(parsed.size))[row] - said
        parts = mix(parsed.tokens + at.astype(np.uint64) * _STEP)
        total = np.zeros(len(parsed.size), np.uint64)
        np.add.at(total, row, parts)
        fits = (at >= depth) & (beyond > 0) & (others >= min_fixed * parsed.size[row])
        yield ({name: batch.column(name).take(take) for name in ("leaf", "kind", "docs", "leaf_docs")}
               | {"at": at, "token": signed(parsed.tokens), "rest": pa.array(signed(mix(total[row] - parts)), mask=~fits)})

    spread = stored(over_batches(kinds.join(several, "leaf").select("leaf", "kind", "docs", "leaf_docs", "line"), tokens,
                                 "leaf bigint, kind bigint, docs bigint, leaf_docs bigint, at int, token bigint, rest bigint"), "tokens")
    fixed_tokens = (spread.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support"), F.first("leaf_docs").alias("leaf_docs"))
                    .where((F.col("support") >= min_docs) & (F.col("support") >= min_share * F.col("leaf_docs")) & (F.col("token") != int(_FIELD_HASH))).select("leaf", "at", "token", F.lit(True).alias("fixed")))
    told = spread.join(fixed_tokens, ["leaf", "at", "token"], "left")
    shown = F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(int(_FIELD_HASH)).cast("bigint"))
    # a sum over places, so that no list of tokens is needed; shortened to stay within a bigint
    part = F.shiftright(F.xxhash64("at", shown), 20)
    general = told.groupBy("leaf", "kind").agg(
        F.sum(part).alias("general"), F.count("fixed").alias("n_fixed"), F.count(F.when(F.col("at") >= depth, F.col("fixed"))).alias("beyond"), F.count("*").alias("n"))
    by_share = general.where((F.col("beyond") > 0) & (F.col("n_fixed") >= min_fixed * F.col("n"))).select("leaf", "kind", F.lit(0).alias("form"), "general")
    groups = (spread.where("rest is not null").groupBy("leaf", "at", "rest").agg(F.sum("docs").alias("group_docs"), F.count("*").alias("lines"))
              .where((F.col("lines") > 1) & (F.col("group_docs") >= min_docs)).drop("lines"))
    widest = spread.join(groups, ["leaf", "at", "rest"]).groupBy("leaf", "kind").agg(
        F.max_by(F.xxhash64("at", "rest"), F.struct("group_docs", -F.col("at"))).alias("general"))
    by_one = widest.join(by_share, ["leaf", "kind"], "left_anti").select("leaf", "kind", F.lit(1).alias("form"), "general")
    templates = by_share.unionByName(by_one)

    named_lines = stored(busy.select("leaf", "kind", "alone", "key", "line_no").join(templates, ["leaf", "kind"], "left")
                         .select("leaf", F.xxhash64("leaf", F.coalesce("form", F.lit(2)), F.coalesce("general", "alone")).alias("template"), "key", "line_no"), "named-lines")
    often = (named_lines.select("template", "key").distinct().groupBy("template")
             .agg(F.count("*").alias("n_docs"), F.min("key").alias("first_key")).where(F.col("n_docs") >= min_docs))
    return named_lines.join(often, "template").select(F.col("key").alias(key), "line_no", "template", "n_docs", "first_key")


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", depth: int = DEPTH, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED, min_share: float = MIN_SHARE, plain: bool = False) -> DataFrame:
    """``df`` with lines of recurring templates dropped from the text, and columns ``n_lines`` and ``n_dropped``.

    The document with the smallest key that has a template keeps its lines, so
    no content leaves the corpus as a whole: of documents that are copies, the
    first stays complete.  Blank lines stay.  A null text stays null, with no lines.
    Columns called n_lines or n_dropped are replaced; all others are kept.
    """
    found = template_lines(df, text, key, depth, min_docs, min_fixed, min_share, plain)
    later = found.where(~F.col(key).eqNullSafe(F.col("first_key")))
    base = df.drop("n_lines", "n_dropped")
    key_name, gone = fresh("key", base.columns), fresh("gone", base.columns)
    dropped = later.groupBy(F.col(key).alias(key_name)).agg(F.collect_set("line_no").alias(gone))
    lines = F.split(F.col(text), "\n")
    keep = F.filter(lines, lambda _, i: ~F.array_contains(gone, i))
    joined = base.join(dropped, F.col(key).eqNullSafe(F.col(key_name)), "left")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(keep, "\n"))
    out = [kept.alias(c) if c == text else F.col(c) for c in base.columns]
    n_dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("bigint")
    return joined.select(*out, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def oracle(depth: int = DEPTH, min_docs: int = MIN_DOCS, min_fixed: float = MIN_FIXED, min_share: float = MIN_SHARE) -> str:
    """DuckDB text: a table ``deduped`` of doc_id, n_lines, n_dropped and text, to be put before a SELECT; the rows of ``dedup_lines`` with ``plain``."""
    return f"""
lines AS (
  SELECT doc_id, line_no - 1 AS line_no, [t FOR t IN string_split_regex(line, '{_BLANKS}') IF t <> ''] AS plain
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)),
masked AS (SELECT *, [CASE WHEN regexp_matches(t, '[0-9]') THEN '{FIELD}' ELSE t END FOR t IN plain] AS tokens FROM lines WHERE len(plain) > 0),
keyed AS (SELECT doc_id, line_no, concat_ws(' ', len(tokens), array_to_string(tokens[1:{depth}], ' ')) AS leaf, array_to_string(tokens, ' ') AS line,
  array_to_string(plain, ' ') AS alone FROM masked),
leaves AS (SELECT leaf, count(DISTINCT doc_id) AS leaf_docs FROM keyed GROUP BY leaf HAVING count(DISTINCT doc_id) >= {min_docs}),
busy AS (SELECT * FROM keyed JOIN leaves USING (leaf)),
kinds AS (SELECT leaf, line, any_value(leaf_docs) AS leaf_docs, count(DISTINCT doc_id) AS docs FROM busy GROUP BY leaf, line),
spread AS (SELECT leaf, line, leaf_docs, docs, unnest(string_split(line, ' ')) AS token, generate_subscripts(string_split(line, ' '), 1) AS place FROM kinds),
support AS (SELECT leaf, place, token, sum(docs) >= {min_docs} AND sum(docs) >= {min_share} * any_value(leaf_docs) AND token <> '{FIELD}' AS fixed
  FROM spread GROUP BY leaf, place, token),
told AS (SELECT leaf, line, place, docs, token, fixed, token <> '{FIELD}' AS said, hash(place, token)::HUGEINT AS part FROM spread JOIN support USING (leaf, place, token)),
general AS (SELECT leaf, line, 'share ' || string_agg(CASE WHEN fixed THEN token ELSE '{FIELD}' END, ' ' ORDER BY place) AS template
  FROM told GROUP BY leaf, line HAVING count(*) FILTER (fixed) >= {min_fixed} * count(*) AND count(*) FILTER (fixed AND place > {depth}) > 0),
without AS (SELECT leaf, line, place, docs, sum(part) OVER w - part AS rest, count(*) FILTER (said) OVER w - said::INTEGER AS others,
    count(*) FILTER (said AND place > {depth}) OVER w - said::INTEGER AS beyond, count(*) OVER w AS n FROM told WINDOW w AS (PARTITION BY leaf, line)),
candidates AS (SELECT *, count(*) OVER g AS group_lines, sum(docs) OVER g AS group_docs FROM without
  WHERE place > {depth} AND beyond > 0 AND others >= {min_fixed} * n WINDOW g AS (PARTITION BY leaf, place, rest)),
one AS (SELECT leaf, line, arg_max('one ' || place || ' ' || rest, struct_pack(d := group_docs, p := -place)) AS template
  FROM candidates WHERE group_lines > 1 AND group_docs >= {min_docs} GROUP BY leaf, line),
named_lines AS (SELECT leaf, coalesce(general.template, one.template, 'alone ' || alone) AS template, doc_id, line_no
  FROM busy LEFT JOIN general USING (leaf, line) LEFT JOIN one USING (leaf, line)),
often AS (SELECT leaf, template, min(doc_id) AS first_id FROM named_lines GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= {min_docs}),
dropped AS (SELECT doc_id, list(DISTINCT line_no) AS gone FROM named_lines JOIN often USING (leaf, template) WHERE doc_id <> first_id GROUP BY doc_id),
deduped AS (
  SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
         CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda t, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
  FROM documents LEFT JOIN dropped USING (doc_id))"""
