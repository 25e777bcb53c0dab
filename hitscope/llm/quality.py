"""Line-first quality rules.

Every line is judged alone: symbol and navigation lines, shouting, words said
over and over, text without sentence marks, and boilerplate phrases fail.  The
failing lines are removed; a document that so loses more than a given part of
its words is rejected.  All of it is one pass over the rows without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .text import IS_SPACE, Lines, Texts, Words, blocks, bounded_batches, forget, give_back, named, over_batches, span_hashes

#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

#: Phrases of pages, not of prose; compared without regard to case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "enable javascript",
    "we use cookies", "accept all cookies", "click here to", "sign up for our", "subscribe to our", "lorem ipsum",
    "skip to content", "back to top", "released under the", "licensed under the",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules; shares are of the words of the line."""
    symbols_per_word: float = 0.3
    shouted_letters: float = 0.6
    shouted_words: int = 4
    exclamations_per_word: float = 0.4
    same_as_before: float = 0.3
    repetition_words: int = 8
    words_per_sentence: int = 200
    #: A line of so many words needs a sentence mark; shorter ones may be a heading or a wrapped line.
    unmarked_words: int = 20
    #: Menus: so many lines in a row, blank ones aside, of at most so many words each without a mark.
    menu_lines: int = 4
    menu_words: int = 5
    #: Link lists: so many words without a mark, of which this share begin with a capital.
    link_words: int = 5
    link_capitals: float = 0.8
    #: A document goes if failing lines hold more than this share of its words.
    max_lost: float = 0.5


COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean, n_failed_lines bigint, n_lost_words bigint")


def _flags(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_SYMBOL, _STOP, _BANG = _flags(SYMBOLS), _flags(b".!?:;"), _flags(b"!")
_UPPER, _LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_CLOSING = _flags(b"\"')]}")


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _repeated(group: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags: found twice or more in its group; found earlier in its group."""
    order = np.lexsort((hashes, group))  # stable: equal ones stay in order of place
    g, h = group[order], hashes[order]
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (h[1:] == h[:-1])
    later, often = np.zeros(len(g), bool), np.zeros(len(g), bool)
    later[order] = same
    both = same.copy()
    both[:-1] |= same[1:]
    often[order] = both
    return often, later


def judge(column: pa.Array, rules: LineRules) -> dict:
    """Base counts and verdicts of a batch, and which lines fail."""
    texts = Texts(column)
    words = Words(texts)
    b, doc_words = texts.buffer, words.documents()
    n = len(b)
    continuation = (b & 0xC0) == 0x80
    space = IS_SPACE[b]
    symbol = _SYMBOL[b]

    lines = Lines(texts)
    line_starts, line_ends, line_doc = lines.starts, lines.ends, lines.doc
    first_word, past_word = np.searchsorted(words.starts, line_starts), np.searchsorted(words.starts, line_ends)
    line_words = past_word - first_word
    real = np.flatnonzero(line_words > 0)
    _, again = _repeated(line_doc[real], span_hashes(b, line_starts[real], line_ends[real]))
    n_dup = np.bincount(line_doc[real][again], minlength=texts.n)

    at, grams = words.windows(3)
    often, _ = _repeated(doc_words[at], grams)
    covered = np.zeros(len(words.starts) + 3, bool)
    for k in range(3):
        covered[at[often] + k] = True
    n_repeat = np.bincount(doc_words[covered[: len(doc_words)]], minlength=texts.n)

    # rules, one flag for each line
    failed = np.zeros(len(line_starts), bool)
    w = np.maximum(line_words, 1)
    failed |= _sums(symbol, line_starts, line_ends) >= rules.symbols_per_word * w
    latin = np.zeros(n, bool)
    latin[1:] = b[:-1] == 0xC3  # Latin-1 letters in UTF-8
    upper = _sums(_UPPER[b] | latin & (b >= 0x80) & (b <= 0x9E), line_starts, line_ends)
    lower = _sums(_LOWER[b] | latin & (b >= 0x9F) & (b <= 0xBF), line_starts, line_ends)
    failed |= (line_words >= rules.shouted_words) & (upper > rules.shouted_letters * (upper + lower))
    failed |= _sums(_BANG[b], line_starts, line_ends) > rules.exclamations_per_word * w
    echo = np.zeros(len(words.hashes), bool)
    echo[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc_words[1:] == doc_words[:-1])
    failed |= (line_words >= rules.repetition_words) & (_sums(echo, first_word, past_word) > rules.same_as_before * w)
    # sentence marks at word ends, closing quotes and brackets aside
    mark = np.zeros(len(words.starts), bool)
    if len(words.starts):
        tail = words.ends - 1
        tail = np.where(_CLOSING[b[tail]] & (tail > words.starts), tail - 1, tail)
        wide = (b[tail] >= 0x80)  # other scripts have marks of their own
        mark = _STOP[b[tail]] | wide & (b[np.maximum(tail - 2, 0)] >= 0xE2)
    failed |= (line_words > rules.words_per_sentence) & (_sums(mark, first_word, past_word) * rules.words_per_sentence < line_words)
    failed |= _unmarked(b, words, lines, line_words, first_word, past_word, mark, upper + lower, _sums(~space & ~continuation, line_starts, line_ends), rules)
    lowered = b.tobytes().lower()
    for found in _PHRASES.finditer(lowered):
        k = np.searchsorted(line_starts, found.start(), "right") - 1
        failed[k] |= found.end() <= line_ends[k]
    failed &= line_words > 0

    n_words = words.counts
    lost = np.bincount(line_doc, np.where(failed, line_words, 0), minlength=texts.n).astype(np.int64)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": texts.per_document(~space & ~continuation), "n_symbols": texts.per_document(symbol),
        "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed,
        "kept": ~base_failed & (lost <= rules.max_lost * n_words),
        "n_failed_lines": np.bincount(line_doc[failed], minlength=texts.n), "n_lost_words": lost,
        "_lines": (texts, line_doc, line_starts, line_ends, failed),
    }


def _unmarked(b, words, lines, line_words, first_word, past_word, mark, letters, characters, rules: LineRules) -> np.ndarray:
    """Lines of Latin letters that lack sentence marks and are too long for that, menus, or link lists; marks of other scripts are not all known."""
    bare = (line_words > 0) & (2 * letters > characters) & (_sums(mark, first_word, past_word) == 0)
    comma, capital = np.zeros(len(words.starts), bool), np.zeros(len(words.starts), bool)
    if len(words.starts):
        comma = b[words.ends - 1] == ord(",")
        second = b[np.minimum(words.starts + 1, len(b) - 1)]
        head = b[words.starts]
        capital = _UPPER[head] | (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    plain = bare & (_sums(comma, first_word, past_word) == 0)
    out = bare & (line_words >= rules.unmarked_words)
    out |= plain & (line_words >= rules.link_words) & (_sums(capital, first_word, past_word) >= rules.link_capitals * np.maximum(line_words, 1))
    real = np.flatnonzero(line_words > 0)
    if len(real):
        item, doc = (plain & (line_words <= rules.menu_words))[real], lines.doc[real]
        run = np.cumsum(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])])) - 1
        out[real] |= item & (np.bincount(run)[run] >= rules.menu_lines)
    return out


_PHRASES = re.compile("|".join(re.escape(p) for p in BOILERPLATE).encode())


def _cleaned(texts: Texts, line_doc, line_starts, line_ends, failed) -> list[bytes]:
    first = np.searchsorted(line_doc, np.arange(texts.n + 1))
    hit = np.bincount(line_doc[failed], minlength=texts.n) > 0
    out = []
    for i in range(texts.n):
        text = texts.document(i)
        if hit[i]:
            at = texts.bounds[i]
            text = b"\n".join(text[line_starts[k] - at: line_ends[k] - at] for k in range(first[i], first[i + 1]) if not failed[k])
        out.append(text)
    return out


def clean_lines(df: DataFrame, text: str = "text", key: str = "doc_id", rules: LineRules = LineRules()) -> DataFrame:
    """One row for each row of ``df``: the key, the counts and verdicts of ``COLUMNS``, and the text without its failing lines.

    A null text counts as having no words: it fails, and its cleaned text is
    null.  A null key is passed on.  Lines without a word never fail.
    """
    key_type = df.schema[key].dataType.simpleString()

    def work(batch):
        column = batch.column("text")
        out = judge(column, rules)
        cleaned = pa.array(_cleaned(*out.pop("_lines")), pa.binary()).cast(pa.string())
        empty = pa.nulls(len(column), pa.string())
        yield out | {"key": batch.column("key"), "cleaned": pa.compute.if_else(column.is_null(), empty, cleaned)}

    return over_batches(named(df, key=key, text=text), work, f"key {key_type}, {COLUMNS}, cleaned string").withColumnRenamed("key", key)


def verdicts(df: DataFrame, text: str = "text", key: str = "doc_id", rules: LineRules = LineRules()) -> DataFrame:
    """As ``clean_lines`` without the cleaned text."""
    key_type = df.schema[key].dataType.simpleString()

    def work(batch):
        out = judge(batch.column("text"), rules)
        out.pop("_lines")
        yield out | {"key": batch.column("key")}

    return over_batches(named(df, key=key, text=text), work, f"key {key_type}, {COLUMNS}").withColumnRenamed("key", key)


def accepted(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``df`` whose document is kept, with failing lines removed from the text; columns as before."""
    schema = df.schema
    if text not in schema.fieldNames():
        raise ValueError(f"no column {text}")

    def run(batches):
        forget()
        for batch in blocks(batches):
            column = batch.column(schema.fieldNames().index(text))
            out = judge(column, rules)
            cleaned = pa.array(_cleaned(*out["_lines"]), pa.binary()).cast(column.type)
            arrays = [cleaned if f.name == text else batch.column(i) for i, f in enumerate(schema.fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).filter(pa.array(out["kept"]))
            del out, cleaned, arrays, column, batch
        give_back()

    return bounded_batches(df).mapInArrow(run, schema)


def with_char_count(df: DataFrame, text: str = "text", count: str = "n_chars") -> DataFrame:
    """Brings the character count up to date where the table has one."""
    return df.withColumn(count, F.length(text).cast(df.schema[count].dataType)) if count in df.columns else df
