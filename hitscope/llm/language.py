"""Language identification by unigrams over pieces, summed over all segmentations.

Each language gives every piece of a fixed public vocabulary a probability.
The probability of a word is the sum over all ways to cut it into pieces,
found by the forward algorithm; a text is its words.  The probabilities are
learned by expectation maximisation: expected piece counts of all training
words, over all segmentations, by forward and backward sums.

Words are taken in blocks: equal words are worked on once, words of equal
length together, so the loops run over positions and not over words.  What
leaves a task is one count for each (language, piece), bounded by the
vocabulary; the words themselves are never shuffled.
"""

from __future__ import annotations

from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Texts, Words, blocks, named, over_batches

#: Longest piece in bytes, the blank before a word counted as one.
LONGEST_PIECE = 16
#: Words are read in runs of this many bytes; a longer word is cut there for certain.
LONGEST_RUN = 32
#: Probabilities are multiplied by e**SCALE for each byte, so that products stay within double precision.
SCALE = 2.5
#: Bytes of text whose different words are worked on at once.
BLOCK = 4 << 20
UNDECIDED = "und"
#: Bound on the number of languages; the model's size is this times the vocabulary's.
MOST_LANGUAGES = 1_000
_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = 256  # stands before the first run of a word
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = np.array([pow(_BASE, k, 2**64) for k in range(LONGEST_RUN + 2)], np.uint64)
_INVERSES = np.array([pow(_INVERSE, k, 2**64) for k in range(LONGEST_RUN + 2)], np.uint64)


class Pieces:
    """The pieces of a sentencepiece file as byte sequences, found by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            text = model.id_to_piece(i)
            codes = (int(text[3:5], 16),) if model.is_byte(i) else tuple(text[1:].encode() if text[0] == "▁" else text.encode())
            if not model.is_byte(i) and text[0] == "▁":
                codes = (_BLANK, *codes)
            if "▁" not in text[1:] and 0 < len(codes) <= LONGEST_PIECE:
                found.setdefault(codes, len(found))
        for b in range(257):  # every byte, and the blank, can stand alone
            found.setdefault((b,), len(found))
        self.n = len(found)
        self.lengths = np.array([len(c) for c in found])
        hashes = np.array([sum(int(_CODES[b]) * int(_POWERS[k]) for k, b in enumerate(c)) % 2**64 for c in found], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        #: Which leading bits any piece's hash has: most spans that are no piece are told by one look-up.
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, piece numbers) of the hashes that are pieces."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        some = hashes[at]
        place = np.minimum(np.searchsorted(self.sorted, some), self.n - 1)
        good = self.sorted[place] == some
        return at[good], self.order[place[good]]

    def spans(self, runs: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For runs of equal length (rows of byte codes): at every (start, end) the rows that have a piece there, and the pieces."""
        n, length = runs.shape
        total = np.zeros((length + 1, n), np.uint64)
        for k in range(length):
            total[k + 1] = total[k] + _CODES[runs[:, k]] * _POWERS[k]
        found = {(s, e): self.find((total[e] - total[s]) * _INVERSES[s]) for e in range(1, length + 1) for s in range(max(0, e - LONGEST_PIECE), e)}
        return {at: x for at, x in found.items() if len(x[0])}


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _folded(buffer: np.ndarray) -> np.ndarray:
    """A to Z, and the capital Latin-1 letters, in lower case."""
    b = buffer.copy()
    b[(b >= 65) & (b <= 90)] += 32
    after = np.zeros(len(b), bool)
    after[1:] = b[:-1] == 0xC3
    b[after & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)] += 32
    return b


class Runs:
    """The different words of a block, as runs of at most LONGEST_RUN bytes grouped by length."""

    def __init__(self, texts: Texts, keys: np.ndarray | None = None):
        """``keys``: a number for each document; equal words of documents with other numbers are told apart."""
        texts.buffer = _folded(texts.buffer)
        self.words = words = Words(texts)
        self.doc = words.documents()
        h = words.hashes if keys is None else words.hashes ^ (keys[self.doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, self.inverse, self.counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.n = len(first)
        self.first = first
        starts, lengths = words.starts[first], words.ends[first] - words.starts[first]
        parts = -(-lengths // LONGEST_RUN)
        self.word = np.repeat(np.arange(self.n), parts)
        nth = np.arange(len(self.word)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = starts[self.word] + nth * LONGEST_RUN
        self.length = np.minimum(lengths[self.word] - nth * LONGEST_RUN, LONGEST_RUN)
        self.opens = nth == 0
        self.buffer = texts.buffer

    def only(self, chosen: np.ndarray) -> Runs:
        """The runs of some of the words, which are numbered anew."""
        number = np.full(self.n, -1)
        number[chosen] = np.arange(len(chosen))
        keep = number[self.word] >= 0
        part = copy(self)
        part.n, part.word = len(chosen), number[self.word][keep]
        part.start, part.length, part.opens = self.start[keep], self.length[keep], self.opens[keep]
        return part

    def groups(self):
        """(numbers of runs, their byte codes) for each length; first runs of words have the blank before them."""
        kind = self.length * 2 + self.opens
        order = np.argsort(kind, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
            n, opens = self.length[at[0]], self.opens[at[0]]
            codes = self.buffer[self.start[at][:, None] + np.arange(n)].astype(np.int16)
            yield at, np.hstack([np.full((len(at), 1), _BLANK, np.int16), codes]) if opens else codes


def _scaled(pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """With e**SCALE for each byte, and a last column of zeros for "no piece"."""
    return np.hstack([probabilities * np.exp(SCALE * pieces.lengths), np.zeros((len(probabilities), 1))])


def log_probabilities(pieces: Pieces, runs: Runs, probabilities: np.ndarray) -> np.ndarray:
    """Of each different word in each language: the forward sums over all segmentations."""
    p = np.ascontiguousarray(_scaled(pieces, probabilities).T)
    out = np.zeros((runs.n, len(probabilities)))
    for at, codes in runs.groups():
        spans, length = pieces.spans(codes), codes.shape[1]
        forward = [np.ones((len(at), p.shape[1]))]
        for e in range(1, length + 1):
            total = np.zeros((len(at), p.shape[1]))
            for s in range(max(0, e - LONGEST_PIECE), e):
                if (s, e) in spans:
                    hit, piece = spans[s, e]
                    total[hit] += forward[s][hit] * p[piece]
            forward.append(total)
        np.add.at(out, runs.word[at], np.log(forward[length]) - SCALE * length)
    return out


def expected_counts(pieces: Pieces, runs: Runs, language: np.ndarray, counts: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Expected piece counts by language, for words of given languages and counts."""
    p = _scaled(pieces, probabilities)
    width = p.shape[1]
    flat, out = p.ravel(), np.zeros(p.size)
    for at, codes in runs.groups():
        spans, length = pieces.spans(codes), codes.shape[1]
        base = language[runs.word[at]] * width
        forward, backward = [np.ones(len(at))], {length: np.ones(len(at))}
        for e in range(1, length + 1):
            total = np.zeros(len(at))
            for s in range(max(0, e - LONGEST_PIECE), e):
                if (s, e) in spans:
                    hit, piece = spans[s, e]
                    total[hit] += forward[s][hit] * flat[base[hit] + piece]
            forward.append(total)
        weight = counts[runs.word[at]] / forward[length]
        cells, parts = [], []
        for s in range(length - 1, -1, -1):
            total = np.zeros(len(at))
            for e in range(s + 1, min(length, s + LONGEST_PIECE) + 1):
                if (s, e) not in spans:
                    continue
                hit, piece = spans[s, e]
                cell = base[hit] + piece
                part = flat[cell] * backward[e][hit]
                total[hit] += part
                cells.append(cell)
                parts.append(part * forward[s][hit] * weight[hit])
            backward[s] = total
        out += np.bincount(np.concatenate(cells), np.concatenate(parts), minlength=p.size)
    return out.reshape(p.shape)[:, : pieces.n]


class Model:
    """Piece probabilities (languages x pieces) of named languages."""

    #: Words whose log-probabilities a Python worker remembers.
    REMEMBERED = 400_000

    def __init__(self, languages: list[str], probabilities: np.ndarray):
        self.languages, self.probabilities = languages, probabilities
        self.hashes, self.logs = np.zeros(0, np.uint64), np.zeros((0, len(languages)))

    def words(self, pieces: Pieces, runs: Runs) -> np.ndarray:
        """``log_probabilities`` of the words of a block; of words met before, from memory."""
        own = runs.words.hashes[runs.first]
        at = np.minimum(np.searchsorted(self.hashes, own), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == own if len(self.hashes) else np.zeros(len(own), bool)
        out = np.empty((len(own), len(self.languages)))
        out[known] = self.logs[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = log_probabilities(pieces, runs.only(new), self.probabilities)
            if len(self.hashes) + len(new) > self.REMEMBERED:
                self.hashes, self.logs = own, out
            else:
                self.hashes, self.logs = np.concatenate([self.hashes, own[new]]), np.concatenate([self.logs, out[new]])
            order = np.argsort(self.hashes)
            self.hashes, self.logs = self.hashes[order], self.logs[order]
        return out


def fit(df: DataFrame, path: str, text: str = "text", lang: str = "lang", rounds: int = 2, smoothing: float = 0.1) -> Model:
    """Learns from all rows with a text and a language.

    Round one starts from equal piece probabilities.  Every round adds
    ``smoothing`` to each expected count.  The driver gets languages x pieces
    numbers, however long the corpus is.
    """
    rows = named(df, text=F.col(text).cast("binary"), lang=lang).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    n = pieces_of(path).n
    number = {name: i for i, name in enumerate(languages)}
    probabilities = np.full((len(languages), n), 1.0 / n)
    for _ in range(rounds if languages else 0):
        now = df.sparkSession.sparkContext.broadcast(probabilities)

        def count(batches):
            pieces, total = pieces_of(path), np.zeros((len(languages), n))
            for batch in blocks(batches, BLOCK):
                doc_lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                runs = Runs(Texts(batch.column("text")), doc_lang)
                if runs.n:
                    total += expected_counts(pieces, runs, doc_lang[runs.doc[runs.first]], runs.counts.astype(float), now.value)
            cell = np.flatnonzero(total)
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], names=["cell", "n"])

        cells = rows.mapInArrow(count, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(len(languages) * n, smoothing)
        counts[cells["cell"].to_numpy(np.int64)] += cells["n"].to_numpy(float)
        counts = counts.reshape(len(languages), n)
        probabilities = counts / counts.sum(axis=1, keepdims=True)
    return Model(languages, probabilities)


def predict(df: DataFrame, model: Model, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, lang_pred and score (the language's share of the likelihood, all languages equally likely before).

    ``und`` with score 0 if the text is null or has no letter, or if the model
    knows no language.  Equal texts get equal results; of languages with equal
    likelihood the first by name is taken.
    """
    key_type = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        m, pieces = shared.value, pieces_of(path)
        column = batch.column("text")
        texts = Texts(column)
        plain = (texts.buffer >= 65) & (texts.buffer <= 90) | (texts.buffer >= 97) & (texts.buffer <= 122)
        letters = texts.per_document(plain) > 0
        for i in np.flatnonzero(~letters):
            letters[i] = any(c.isalpha() for c in texts.document(i).decode())
        names, scores = np.full(texts.n, UNDECIDED, object), np.zeros(texts.n)
        if m.languages:
            runs = Runs(texts)
            by_word = m.words(pieces, runs)
            totals = np.zeros((texts.n, len(m.languages)))
            for k in range(len(m.languages)):
                totals[:, k] = np.bincount(runs.doc, by_word[runs.inverse, k], minlength=texts.n)
            best = totals.argmax(axis=1)
            share = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            names[letters] = np.array(m.languages, object)[best[letters]]
            scores[letters] = share[letters]
        yield {"key": batch.column("key"), "lang_pred": names.tolist(), "score": scores}

    rows = named(df, key=key, text=F.col(text).cast("binary"))
    return over_batches(rows, work, f"key {key_type}, lang_pred string, score double", BLOCK).withColumnRenamed("key", key)
