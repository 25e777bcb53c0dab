"""A class-based bigram language model in the manner of Brown et al.

All training words go to classes by exchange: each word moves to the class in
which the likelihood is highest, given its neighbours' classes.  A text's
probability is then the product of class transitions and of words within their
classes, both smoothed.

Every word's neighbouring classes are counted once, as they are at first; rounds
then move all words at once.  That can't lower the likelihood of the neighbours
so counted.  What a class gives a word is taken with one of the word's
occurrences left out.  A word that occurs once is then unseen, and unseen words
have a class by their shape, as no text tells their neighbours.

What of the vocabulary may travel is bounded by shares, not by counts: at most
1/s words can each make up a share s of all tokens.  Words that make up
CLUSTERED of the training tokens, and the CLASSES most frequent ones, begin in
the classes without a shape (at most some 10,000), others in their shape's.  Words that make up LISTED are looked up from
a broadcast table (at most a million); all others, their counts and classes, by
a join, once for transitions and scores, where every word has its class.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import Texts, Words, blocks, named, signed
from .workspace import stored

CLASSES = 64
CLUSTERED = 1e-4
LISTED = 1e-6
ROUNDS = 3
#: Added to a class's count of each neighbour.
PRIOR = 0.1
#: Classes of words by shape: last byte, and whether there is a byte above 127.
SHAPES = 64
#: Words that a task holds before it hands on its counts.
HELD = 2_000_000
#: Tokens of a piece, and words whose counts are a matrix at once.
PIECE, AT_ONCE = 1 << 18, 4096

END, CONTEXTS = CLASSES + SHAPES, CLASSES + SHAPES + 1
#: A word's counts: of the classes after it, then of those before it.
SIDES = 2 * CONTEXTS
#: Both neighbours of one occurrence as one number, with the word's shape.
PAIRS = SHAPES * CONTEXTS * CONTEXTS

_LAST = np.zeros(256, np.int64)
_LAST[:] = 29
_LAST[97:123] = np.arange(26)
_LAST[65:91] = np.arange(26)
_LAST[ord(".")], _LAST[ord(",")] = 26, 27
_LAST[48:58] = 28
_LAST[128:] = 30 + np.arange(128) % 2


def _shapes(words: Words) -> np.ndarray:
    b = words.texts.buffer
    high = np.concatenate([[0], np.cumsum(b > 127)])
    return _LAST[b[words.ends - 1]] + 32 * (high[words.ends] > high[words.starts])


def _blocks_of_words(batches):
    for batch in blocks(batches):
        yield batch, Words(Texts(batch.column("text")), fold=True)


def count_words(rows: DataFrame) -> DataFrame:
    """(w, shape, n) of all texts; ``w`` is a word's hash."""
    def run(batches):
        held, size = [], 0

        def out():
            h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            s = np.concatenate([x[2] for x in held])
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(s[first].astype(np.int32)),
                                               pa.array(np.bincount(inverse, n).astype(np.int64))], names=["w", "shape", "n"])

        for _, words in _blocks_of_words(batches):
            if not len(words.hashes):
                continue
            keys, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
            held.append((keys, counts, _shapes(words)[first]))
            size += len(keys)
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    parts = rows.mapInArrow(run, "w bigint, shape int, n bigint")
    return parts.groupBy("w").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"))


class Lookup:
    """Numbers by word hash."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = [v[order] for v in values]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions; -1 where the word isn't listed."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def _classes(words: Words, known: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's class, by its shape where the word isn't listed; its position in the list, or -1; and its shape."""
    at, shapes = known.find(words.hashes), _shapes(words)
    found, classes = at >= 0, CLASSES + shapes
    classes[found] = known.values[1][at[found]]
    return classes, at, shapes


def _sequence(words: Words, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, an end after each document's words; and where the words stand in it."""
    place = np.arange(len(classes)) + words.documents()
    out = np.full(len(classes) + words.texts.n, end, np.int64)
    out[place] = classes
    return out, place


class Model:
    """Class transitions and what is needed for emissions; fixed in size by CLASSES, SHAPES and the shares."""

    def __init__(self, clustered: Lookup, tokens: int, distinct: int, class_tokens: np.ndarray, class_types: np.ndarray, transitions: np.ndarray):
        self.clustered = clustered  # counts and classes of the listed words
        self.ends = int(class_tokens[END])
        self.tokens, self.distinct = tokens, distinct
        types = class_types.astype(float)
        types[CLASSES: END] += 1  # a shape also has words not seen in training, as one type
        mass = class_tokens + types
        before = mass / mass.sum()
        followers = (transitions > 0).sum(axis=1, keepdims=True)
        total = transitions.sum(axis=1, keepdims=True)
        weight = np.where(total > 0, followers / np.maximum(followers + total, 1), 1.0)  # Witten-Bell
        self.log_transition = np.log10((1 - weight) * transitions / np.maximum(total, 1) + weight * np.maximum(before, 1e-300))
        self.log_mass = np.log10(np.maximum(mass, 1))


def _learned(rows: DataFrame, rounds: int) -> tuple[Lookup, DataFrame, Callable[[DataFrame], Model]]:
    """The listed words, the table of all words' counts and classes, and what makes the model of the texts in pieces."""
    words = stored(count_words(rows), "words")
    texts = rows.count()
    found = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = found[0] + texts, found[1] + (texts > 0)
    often = words.where(F.col("n") >= max(1, math.ceil(CLUSTERED * tokens))).unionByName(words.orderBy(F.desc("n"), "w").limit(CLASSES)).distinct().toPandas()
    keys, n = often["w"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.lexsort((keys, -n))  # most frequent first; they have classes of their own at first
    start = Lookup(keys[order], n[order], np.minimum(np.arange(len(order)), CLASSES - 1))
    vocabulary = stored(exchange(stored(count_contexts(rows, start), "contexts"), start, rounds)[0], "vocabulary")
    often = vocabulary.where(F.col("n") >= max(1, math.ceil(LISTED * tokens))).select("w", "n", "c").toPandas()
    known = Lookup(often["w"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64), often["c"].to_numpy(np.int64))

    def model(pieces: DataFrame) -> Model:
        members = vocabulary.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
        class_tokens, class_types = np.zeros(CONTEXTS), np.zeros(CONTEXTS)
        class_tokens[members["c"].to_numpy(np.int64)] = members["n"].to_numpy(float)
        class_types[members["c"].to_numpy(np.int64)] = members["types"].to_numpy(float)
        class_tokens[END], class_types[END] = texts, texts > 0
        return Model(known, tokens, distinct, class_tokens, class_types, _transitions(pieces))

    return known, vocabulary, model


def _plain(df: DataFrame, text: str, key: str | None = None, training: Column | None = None) -> DataFrame:
    key, training = F.lit(0) if key is None else F.col(key), F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    return named(df, key=key, training=training, text=F.coalesce(F.col(text), F.lit("")).cast("binary"))


def fit(df: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the table of all words' counts and classes (w, shape, c, n), from all rows of ``df``; null texts are empty texts."""
    rows = _plain(df, text)
    known, vocabulary, model = _learned(rows, rounds)
    return model(_resolved(rows, known, vocabulary)), vocabulary


def fit_and_score(df: DataFrame, training: Column, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """``score`` of all rows of ``df`` by the model of those that are ``training``; their words are looked up once."""
    rows = _plain(df, text, key, training)
    known, vocabulary, model = _learned(rows.where("training"), rounds)
    pieces = _resolved(rows, known, vocabulary)
    return _scores(pieces, model(pieces), key)


def _summed(w: np.ndarray, cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` added up by word and cell, in their order."""
    order = np.lexsort((cell, w))
    w, cell = w[order], cell[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (cell[1:] != cell[:-1])]))
    return w[first], cell[first], np.add.reduceat(n[order], first)


def count_contexts(rows: DataFrame, known: Lookup) -> DataFrame:
    """Each word of all texts once: (w, shape, n, cells, counts), how often which class stands after and before it."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches):
        held, size = [], 0

        def out():
            w, cell, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(cell.astype(np.int32)), pa.array(n)], names=["w", "cell", "n"])

        for _, words in _blocks_of_words(batches):
            if not len(words.hashes):
                continue
            classes, at, shapes = _classes(words, shared.value)
            sequence, place = _sequence(words, classes, END)
            # every document ends with an end, so there is a next token
            after, before = sequence[place + 1], np.concatenate([[END], sequence[:-1]])[place]
            w, number = np.unique(signed(words.hashes), return_inverse=True)
            size, frequent = PAIRS + SHAPES * SIDES, at >= 0
            # a frequent word has fewer cells side by side than in pairs, any other fewer rows in pairs
            single = (number * size + PAIRS + shapes * SIDES)[frequent]
            pairs = (number * size + (shapes * CONTEXTS + before) * CONTEXTS + after)[~frequent]
            keys, n = np.unique(np.concatenate([pairs, single + after[frequent], single + CONTEXTS + before[frequent]]), return_counts=True)
            held.append((w[keys // size], keys % size, n))
            size += len(keys)
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def gather(batches):
        rest = None
        for batch in batches:
            w, cell, n = (batch.column(name).to_numpy() for name in ("w", "cell", "n"))
            pair = cell < PAIRS
            own, both = cell[pair] // (CONTEXTS * CONTEXTS) * SIDES, cell[pair] % (CONTEXTS * CONTEXTS)
            columns = [np.concatenate([w[pair], w[pair], w[~pair]]), np.concatenate([own + both % CONTEXTS, own + CONTEXTS + both // CONTEXTS, cell[~pair] - PAIRS]),
                       np.concatenate([n[pair], n[pair], n[~pair]])]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            if not len(columns[0]):
                continue
            columns = _summed(*columns)
            whole = np.searchsorted(columns[0], columns[0][-1])  # the last word may go on in the next batch
            rest = [x[whole:] for x in columns]
            if whole:
                yield out(*(x[:whole] for x in columns))
        if rest is not None:
            yield out(*rest)

    def out(w, cell, n):
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        offsets = pa.array(np.append(first, len(w)).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            pa.array(w[first]), pa.array((cell[first] // SIDES).astype(np.int32)), pa.array(np.add.reduceat(n, first) // 2),
            pa.ListArray.from_arrays(offsets, pa.array((cell % SIDES).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(n))],
            names=["w", "shape", "n", "cells", "counts"])

    parts = rows.mapInArrow(count, "w bigint, cell int, n bigint")
    return parts.repartition("w").sortWithinPartitions("w").mapInArrow(gather, "w bigint, shape int, n bigint, cells array<int>, counts array<bigint>")


def _batches_of_counts(batches, known: Lookup, rounds: list[np.ndarray]):
    """Words, their classes after ``rounds``, and their counts, some words at once."""
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            shape, n = (batch.column(name).to_numpy().astype(np.int64) for name in ("shape", "n"))
            cells, counts = (batch.column(name).flatten().to_numpy() for name in ("cells", "counts"))
            word = np.repeat(np.arange(len(n)), np.diff(batch.column("cells").offsets.to_numpy()))
            position = known.find(batch.column("w").to_numpy().view(np.uint64))
            c = CLASSES + shape
            c[position >= 0] = known.values[1][position[position >= 0]]
            if rounds:
                c[n == 1] = CLASSES + shape[n == 1]  # as they would come out below
                some = np.flatnonzero(n > 1)
                row = np.zeros(len(n), np.int64)
                row[some] = np.arange(len(some))
                inside = n[word] > 1
                matrix = np.zeros((len(some), SIDES))
                matrix[row[word[inside]], cells[inside]] = counts[inside]
                for log in rounds:
                    c[some] = _best(matrix, n[some], shape[some], c[some], log)
            yield batch, c, word, cells, counts


def _best(counts: np.ndarray, n: np.ndarray, shape: np.ndarray, now: np.ndarray, log: np.ndarray) -> np.ndarray:
    """The class in which each word is likeliest: one without a shape, or its own shape's; ties keep the present one, else the lower one."""
    at, likely = np.arange(len(n)), counts @ log.T
    # Without one occurrence a word makes up n - 1 of n of what it does; a shape has a share for unseen words.
    options = np.column_stack([likely[:, :CLASSES] + (n * np.log((n - 1) / n))[:, None], likely[at, CLASSES + shape]])
    best, present = options.argmax(axis=1), np.minimum(now, CLASSES)
    return np.where(options[at, best] > options[at, present], np.where(best < CLASSES, best, CLASSES + shape), now)


def exchange(contexts: DataFrame, known: Lookup, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """All words' classes (w, shape, c, n) after some rounds, from the looked up ones or shapes; and by round
    the log probabilities of a class's neighbours."""
    session, logs = contexts.sparkSession, []

    def sums(shared):
        def run(batches):
            lookup, done = shared.value
            total = np.zeros(END * SIDES)
            for _, c, word, cells, counts in _batches_of_counts(batches, lookup, done):
                total += np.bincount(c[word] * SIDES + cells, counts, minlength=len(total))
            cell = np.flatnonzero(total)
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell].astype(np.int64))], names=["cell", "n"])
        return run

    def classes(shared):
        def run(batches):
            for batch, c, *_ in _batches_of_counts(batches, *shared.value):
                yield pa.RecordBatch.from_arrays([batch.column("w"), batch.column("shape"), pa.array(c.astype(np.int32)), batch.column("n")],
                                                 names=["w", "shape", "c", "n"])
        return run

    for _ in range(rounds):
        shared = session.sparkContext.broadcast((known, list(logs)))
        found = contexts.mapInArrow(sums(shared), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(END * SIDES)
        total[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(float)
        total = total.reshape(END, SIDES)
        logs.append(np.log(total + PRIOR) - np.log(total[:, :CONTEXTS].sum(axis=1) + PRIOR * CONTEXTS)[:, None])
    shared = session.sparkContext.broadcast((known, logs))
    return contexts.mapInArrow(classes(shared), "w bigint, shape int, c int, n bigint"), logs


def _pieces(rows: DataFrame, known: Lookup) -> tuple[DataFrame, DataFrame]:
    """The classes of all texts' tokens (and of the one before) by pieces of a bounded length, with what is known of the listed
    words; and the words to be looked up, one row for each in a piece."""
    shared = rows.sparkSession.sparkContext.broadcast(known)
    kind = rows.schema["key"].dataType.simpleString()
    schema = (f"piece bigint, row bigint, keys array<{kind}>, training binary, lengths binary, n_known binary, logs binary, codes binary, places binary, "
              "slots binary, w bigint, slot int")

    def run(batches):
        from pyspark import TaskContext

        lookup = shared.value
        log_counts = np.log10(lookup.values[0] + 1)
        piece = TaskContext.get().partitionId() << 40
        row = piece
        for batch, words in _blocks_of_words(batches):
            docs = words.documents()
            classes, at, _ = _classes(words, lookup)
            sequence, place = _sequence(words, classes, END)
            owner = np.repeat(np.arange(batch.num_rows), words.counts + 1)
            number = np.full(len(sequence), -1)  # of the word in the block
            number[place] = np.arange(len(place))
            training = batch.column("training").to_numpy(zero_copy_only=False)
            for start in range(0, len(sequence), PIECE):
                end = min(start + PIECE, len(sequence))
                low, high = int(owner[start]), int(owner[end - 1]) + 1
                inside = number[start:end]
                inside = inside[inside >= 0]
                listed = inside[at[inside] >= 0]
                mine = docs[listed] - low
                # the token before the first may be a word to look up, too
                codes = np.concatenate([[END], sequence[:end]]) if start == 0 else sequence[start - 1: end]
                shown = np.concatenate([[-1], number[:end]]) if start == 0 else number[start - 1: end]
                places = np.flatnonzero(shown >= 0)
                places = places[at[shown[places]] < 0]
                w, slots = np.unique(words.hashes[shown[places]], return_inverse=True)
                keys = batch.column("key").slice(low, high - low)
                keys = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), pa.concat_arrays([keys]))
                arrays = [training[low:high], np.bincount(owner[start:end] - low, minlength=high - low), np.bincount(mine, minlength=high - low),
                          np.bincount(mine, log_counts[at[listed]], minlength=high - low), codes.astype(np.uint8), places.astype(np.int32), slots.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([row + low]), keys, *(pa.array([a.tobytes()], pa.binary()) for a in arrays),
                                                  pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32())], names=names)
                if len(w):
                    none = [pa.nulls(len(w), pa.binary())] * len(arrays)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), piece)), pa.nulls(len(w), pa.int64()), pa.nulls(len(w), keys.type), *none,
                                                      pa.array(signed(w)), pa.array(np.arange(len(w), dtype=np.int32))], names=names)
                piece += 1
            row += batch.num_rows

    names = ["piece", "row", "keys", "training", "lengths", "n_known", "logs", "codes", "places", "slots", "w", "slot"]
    # Written once: the numbers must not change when a part is computed again.
    parts = stored(rows.mapInArrow(run, schema), "pieces")
    return parts.where("w is null").drop("w", "slot"), parts.where("w is not null").select("piece", "w", "slot")


def _resolved(rows: DataFrame, known: Lookup, vocabulary: DataFrame) -> DataFrame:
    """The texts in pieces: all their tokens' classes, and per text of a piece its tokens, known words and the logarithms of their counts."""
    pieces, words = _pieces(rows, known)
    found = words.join(vocabulary.select("w", "c", "n"), "w").select(F.col("piece").alias("of"), "slot", "c", "n")
    kept = ["row", "keys", "training", "lengths"]

    def run(left, right):
        lengths, n_known, logs, codes, places, slots = (
            np.frombuffer(left.column(name)[0].as_py(), kind) for name, kind in
            (("lengths", np.int64), ("n_known", np.int64), ("logs", float), ("codes", np.uint8), ("places", np.int32), ("slots", np.int32)))
        size = int(slots.max()) + 1 if len(slots) else 0
        classes, n = np.full(size, -1), np.zeros(size, np.int64)
        slot = right.column("slot").to_numpy()
        classes[slot], n[slot] = right.column("c").to_numpy(), right.column("n").to_numpy()
        seen = classes[slots] >= 0  # others have not been in training
        codes = codes.copy()
        codes[places[seen]] = classes[slots[seen]]
        seen &= places > 0
        mine = np.repeat(np.arange(len(lengths)), lengths)[places[seen] - 1]
        n_known = n_known + np.bincount(mine, minlength=len(lengths))
        logs = logs + np.bincount(mine, np.log10(n[slots[seen]] + 1), minlength=len(lengths))
        done = [pa.chunked_array([pa.array([a.tobytes()], pa.binary())]) for a in (n_known, logs, codes)]
        return pa.table([*(left.column(name) for name in kept), *done], names=[*kept, "n_known", "logs", "codes"])

    kind = pieces.schema["keys"].dataType.simpleString()
    schema = f"row bigint, keys {kind}, training binary, lengths binary, n_known binary, logs binary, codes binary"
    return stored(pieces.groupBy("piece").cogroup(found.groupBy("of")).applyInArrow(run, schema), "resolved")


def _parts(batches):
    """Every piece's keys, its texts' numbers, and their arrays."""
    kinds = {"training": bool, "lengths": np.int64, "n_known": np.int64, "logs": float, "codes": np.uint8}
    for batch in batches:
        for i in range(batch.num_rows):
            arrays = {name: np.frombuffer(batch.column(name)[i].as_py(), kind) for name, kind in kinds.items() if name in batch.schema.names}
            arrays["codes"] = arrays["codes"].astype(np.int64)
            yield batch, i, arrays


def _transitions(pieces: DataFrame) -> np.ndarray:
    def run(batches):
        total = np.zeros(CONTEXTS * CONTEXTS, np.int64)
        for _, _, a in _parts(batches):
            trained = np.repeat(a["training"], a["lengths"])
            total += np.bincount((a["codes"][:-1] * CONTEXTS + a["codes"][1:])[trained], minlength=len(total))
        cell = np.flatnonzero(total)
        if len(cell):
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], names=["cell", "n"])

    cells = pieces.select("training", "lengths", "codes").mapInArrow(run, "cell bigint, n bigint")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(CONTEXTS * CONTEXTS)
    total[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    return total.reshape(CONTEXTS, CONTEXTS)


def score(df: DataFrame, model: Model, vocabulary: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10.

    A null text is empty: one token, its end.  Repeated rows are scored one by
    one.  Without training text every word is unknown.
    """
    return _scores(_resolved(_plain(df, text, key), model.clustered, vocabulary), model, key)


def _scores(pieces: DataFrame, model: Model, key: str) -> DataFrame:
    ends, log_base, log_transition, log_mass = model.ends, math.log10(model.tokens + model.distinct + 1), model.log_transition, model.log_mass
    key_type = pieces.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        for batch, i, a in _parts(batches):
            lengths, previous, codes = a["lengths"], a["codes"][:-1], a["codes"][1:]
            size = len(lengths)
            owner, end = np.repeat(np.arange(size), lengths), codes == END
            ended = np.bincount(owner[end], minlength=size)
            steps = log_transition[previous, codes] - np.where(end, 0.0, log_mass[codes])
            yield pa.RecordBatch.from_arrays([
                pa.array(batch.column("row")[i].as_py() + np.arange(size)), batch.column("keys").slice(i, 1).flatten(), pa.array(lengths),
                pa.array(a["n_known"] + ended * (ends > 0)), pa.array(a["logs"] - lengths * log_base + ended * math.log10(ends + 1)),
                pa.array(a["logs"] + np.bincount(owner, steps, minlength=size))], names=["row", "key", "n_tokens", "n_known", "base", "score"])

    parts = pieces.mapInArrow(run, f"row bigint, key {key_type}, n_tokens bigint, n_known bigint, base double, score double")
    # A long text is in several pieces.
    whole = parts.groupBy("row").agg(F.first("key").alias("key"), *(F.sum(name).alias(name) for name in ("n_tokens", "n_known", "base", "score")))
    return whole.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(int(model.tokens)).cast("bigint").alias("train_tokens"),
                        F.col("base").alias("base_score"), "score")
