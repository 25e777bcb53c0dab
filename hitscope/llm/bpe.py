"""BPE encoding and decoding, with tree concatenation for long unsplit text.

A long text is cut in halves, and these again, until every leaf is short.  The
leaves are rows of their own, so the leaves of one text are encoded in parallel
by different tasks.  Going back up the tree, two neighbours are joined by
re-encoding a window around the join; the window grows until what it gives
agrees with both sides at both of its ends.  In a BPE encoding every pair of
neighbouring tokens is one that encoding their text would give, and a sequence
with that property is the encoding; so once the ends agree, the joined
sequence is the one that encoding the whole would give.

No token reaches over white space, so where there is some near the middle the
cut is made there and the join agrees at once.  Only text without white space
("unsplit") is cut inside a token, and there the windows do their work.
"""

from __future__ import annotations

import array
import json
import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import named, over_batches, remembers

#: Longest leaf, in characters.  Longer texts are dealt out as several rows.
LEAF = 16_384
#: Tokens on either side of a join in its first window.
FIRST_WINDOW = 8
#: Words, and pieces of words, whose ids a Python worker remembers in each of two generations.
REMEMBERED = 100_000
PIECES_REMEMBERED = 75_000
#: Ids that are spelled out at once.
SPELLED = 65_536

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class Remembered(dict):
    """What ``make`` gives for a key, kept in two generations so that frequent keys survive."""

    def __init__(self, make, size):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


#: Marks that often follow a word; as a run they are one piece.
_MARKS = ".,!?;:*$&%#|)]}\""
#: Printable characters up to U+00FF: they are normalised by lower case alone, and bytes of theirs are what the fast way below maps.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]+\Z")


def byte_symbols() -> dict[int, str]:
    """The symbol of each byte in byte-level BPE: printable ones stand for themselves, the others for the characters from U+0100 on."""
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    return {b: chr(b) for b in itself} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class Codec:
    """One tokenizers file, read once for each Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        self.whole = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        self.whole.no_truncation()
        self.whole.no_padding()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.path = path
        self.added = sorted(self.whole.get_added_tokens_decoder().items())
        self.specials = [t.content for _, t in self.added]
        self.tokens = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        if self.whole.decoder is not None or any(re.search(r"\s", t) for t in self.specials):
            raise ValueError("made for tokenizers that drop white space and join tokens by spaces")
        self.ids = {t: i for i, t in self.tokens.items()}
        #: An unsplit word longer than this is encoded as a tree.
        self.leaf = LEAF
        self.symbols = byte_symbols()
        self.split = self._plain_split(spec)
        self.known: dict[str, Remembered] = {}

    @cached_property
    def spelled(self) -> tuple[list[bytes], list[bytes]]:
        """By id: the id in decimal, and the token."""
        numbers = range(max(self.tokens, default=-1) + 1)
        return [b"%d" % i for i in numbers], [self.tokens.get(i, "").encode() for i in numbers]

    @cached_property
    def inner(self):
        """The same model for parts that don't end a word; only long unsplit text needs it."""
        from tokenizers import Tokenizer

        spec = json.loads(open(self.path, encoding="utf-8").read())
        spec["model"]["end_of_word_suffix"] = None
        return Tokenizer.from_str(json.dumps(spec)) if self.suffix else self.whole

    @staticmethod
    def _plain_split(spec: dict):
        """The pattern that splits plain words, if the file's steps before BPE are those that the fast way knows."""
        import regex

        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in before] != ["Split", "ByteLevel"]:
            return None
        split, bytes_ = before
        if split["behavior"] != "Removed" or not split["invert"] or bytes_["use_regex"] or bytes_["add_prefix_space"]:
            return None
        return regex.compile(split["pattern"]["Regex"]).findall

    # words ------------------------------------------------------------------------------------

    def word_ids(self, word: str) -> list[int]:
        if len(word) > self.leaf:
            return self.tree(word)
        return self.whole.encode(word, add_special_tokens=False).ids

    def remembered(self) -> Remembered:
        """Ids of words by their bytes, as little-endian numbers."""
        if "raw" not in self.known:
            self.model = self.whole.model
            split = self.split

            def shape(ids):
                return array.array("I", ids).tobytes()

            glue = b"".join
            model, symbols = self.model, self.symbols

            def of_mapped(piece: str):
                mapped = piece if piece.isascii() else piece.encode().decode("latin-1").translate(symbols)
                return shape([t.id for t in model.tokenize(mapped)])

            of_piece = Remembered(of_mapped, PIECES_REMEMBERED)
            specials = self.specials

            def of_word(word: bytes):
                text = word.decode()
                plain = text.isprintable() if text.isascii() else _PLAIN.match(text)
                if split is None or not plain or len(text) > self.leaf:
                    return shape(self.word_ids(text))
                low = text.lower()
                if low.isalpha():
                    return of_piece[low]
                stem = low.rstrip(_MARKS)
                if stem.isalpha():
                    parts = [of_piece[stem], of_piece[low[len(stem):]]]
                elif any(x in text for x in specials):
                    return shape(self.word_ids(text))
                else:
                    parts = [of_piece[p] for p in split(low)]
                return glue(parts)

            self.known["raw"] = Remembered(of_word, REMEMBERED)
        return self.known["raw"]

    def raw(self, text: bytes) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        known = self.remembered()
        return b"".join([known[w] for w in text.split()])

    def spell(self, raw: bytes) -> Iterator[tuple[bytes, bytes]]:
        """The ids as text and their tokens, each joined by a space, in stretches that together give the whole."""
        numbers, tokens = self.spelled
        gap = b""
        for at in range(0, len(raw), 4 * SPELLED):
            ids = array.array("I", raw[at: at + 4 * SPELLED])
            yield gap + b" ".join([numbers[i] for i in ids]), gap + b" ".join([tokens[i] for i in ids])
            gap = b" "

    # one long word ----------------------------------------------------------------------------

    def pieces(self, word: str) -> list[tuple[str, str]]:
        """What the tokenizer's own steps before BPE make of a word: ("special", token) or ("piece", symbols)."""
        out = []
        rest = re.split("(" + "|".join(map(re.escape, self.specials)) + ")", word) if self.specials else [word]
        for k, part in enumerate(rest):
            if k % 2:
                out.append(("special", part))
            elif part:
                plain = self.whole.normalizer.normalize_str(part) if self.whole.normalizer else part
                split = self.whole.pre_tokenizer.pre_tokenize_str(plain) if self.whole.pre_tokenizer else [(plain, None)]
                out += [("piece", s) for s, _ in split]
        return out

    def fragment(self, symbols: str, last: bool) -> list[str]:
        """BPE of part of a piece; only the last part of a piece carries the mark of a word's end."""
        model = self.whole.model if last else self.inner.model
        return [t.value for t in model.tokenize(symbols)] if symbols else []

    def width(self, tokens: list[str], last: bool) -> int:
        """The symbols that the tokens stand for."""
        n = sum(map(len, tokens))
        return n - len(self.suffix) if last and tokens else n

    def join(self, left: list[str], right: list[str], left_text: str, right_text: str, last: bool, window: int = FIRST_WINDOW) -> list[str]:
        """Encodings of neighbouring parts to the encoding of both; ``last`` if the right part ends its piece."""
        if not left or not right:
            return left + right
        k = window
        while True:
            a, b = left[-k:] if k < len(left) else left, right[:k]
            ends = last and len(b) == len(right)
            text = left_text[len(left_text) - self.width(a, False):] + right_text[: self.width(b, ends)]
            got = self.fragment(text, ends)
            if len(a) == len(left) and len(b) == len(right):
                return got
            # the token at an inner end of the window must be the side's own; an end of the whole text needs no check
            agree_left = len(a) == len(left) or got[:1] == a[:1]
            agree_right = len(b) == len(right) or got[-1:] == b[-1:]
            if agree_left and agree_right:
                return left[: len(left) - len(a)] + got + right[len(b):]
            k *= 2

    def tree_tokens(self, symbols: str, last: bool) -> list[str]:
        if len(symbols) <= self.leaf:
            return self.fragment(symbols, last)
        half = len(symbols) // 2
        a, b = symbols[:half], symbols[half:]
        return self.join(self.tree_tokens(a, False), self.tree_tokens(b, last), a, b, last)

    def tree(self, word: str) -> list[int]:
        return [self.ids[t] for kind, s in self.pieces(word) for t in ([s] if kind == "special" else self.tree_tokens(s, True))]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _forget_codecs() -> None:
    for made in _codecs.values():
        made.known.clear()  # its words refer to the codec, which would outlive this otherwise
    _codecs.clear()


remembers(_forget_codecs)


def cut(text: bytes, leaf: int = LEAF) -> list[bytes]:
    """Halves of halves, none longer than ``leaf`` bytes, cut at the white space nearest the middle.

    A part without white space stays whole here; its words are trees of their own.
    """
    done, todo = [], [text]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            done.append(part)
            continue
        half = len(part) // 2
        after = _BLANK.search(part, half)
        before = max(part.rfind(c, 0, half) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        at = after.start() if after else len(part)
        at = before if before > 0 and (half - before < at - half or at == len(part)) else at
        if at <= 0 or at >= len(part) - 1:
            done.append(part)
            continue
        todo += [part[at + 1:], part[:at]]
    return done


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """The ids of every text: the key, ``n_tokens`` and ``ids`` (an array of int).

    The ids are those of the tokenizers library without special tokens added,
    truncation or padding.  A null text has no ids.  Rows with equal or null
    keys each get a row of their own.  Texts up to ``leaf`` characters are
    encoded where they are; the parts of longer ones are dealt over all tasks
    and gathered again, so only those are shuffled.
    """
    return _run(df, path, text, key, leaf, "n_tokens bigint, ids array<int>", _ids_out)


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", leaf: int = LEAF) -> DataFrame:
    """Per row the key, ``n_tokens``, ``ids_sha256`` (of the decimal ids, joined by a space) and ``decoded_sha256`` (of ``decode``'s text)."""
    return _run(df, path, text, key, leaf, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digests_out)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """The key and ``text`` for each row's ids, special tokens included; null ids give an empty text."""
    key_type = df.schema[key].dataType.simpleString()

    def work(batch):
        tokens = codec(path).tokens
        yield {"key": batch.column("key"), "text": [" ".join([tokens[i] for i in row or ()]) for row in batch.column("ids").to_pylist()]}

    return over_batches(named(df, key=key, ids=ids), work, f"key {key_type}, text string").withColumnRenamed("key", key)


def _ids_out(c, rows):
    import numpy as np

    values = [np.frombuffer(r, "<u4").astype(np.int32) for r in rows]
    return {"n_tokens": [len(v) for v in values], "ids": pa.array(values, pa.list_(pa.int32()))}


def _digests_out(c, rows):
    import hashlib

    ids_sha, decoded_sha = [], []
    for raw in rows:
        ids, decoded = hashlib.sha256(), hashlib.sha256()
        for numbers, tokens in c.spell(raw):
            ids.update(numbers)
            decoded.update(tokens)
        ids_sha.append(ids.hexdigest())
        decoded_sha.append(decoded.hexdigest())
    return {"n_tokens": [len(r) // 4 for r in rows], "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}


def _run(df, path, text, key, leaf, schema, out):
    """Short texts in one pass; long ones as leaves, gathered by a row number of their own.  Only ids travel; ``out`` spells them where they end."""
    key_type = df.schema[key].dataType.simpleString()
    rows = named(df, key=key, text=F.col(text).cast("binary"))

    def encoded(c: Codec, part: bytes):
        c.leaf = leaf
        return c.raw(part)

    def short(batch):
        c = codec(path)
        texts = batch.column("text").to_pylist()
        for at in range(0, len(texts), 512):
            part = slice(at, at + 512)
            yield {"key": batch.column("key").slice(at, 512)} | out(c, [encoded(c, t or b"") for t in texts[part]])

    def leaves(batch):
        for k, t, row in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("row").to_pylist()):
            parts = cut(t, leaf)
            yield {"key": [k] * len(parts), "row": [row] * len(parts), "at": range(len(parts)), "part": parts}

    def leaf_forms(batch):
        c = codec(path)
        yield {name: batch.column(name) for name in ("key", "row", "at", "copies")} | {
               "ids": [encoded(c, p.as_py()) for p in batch.column("part")]}

    def joined(batch):
        whole = (b"".join([p["ids"] for p in sorted(parts.as_py(), key=lambda p: p["at"])]) for parts in batch.column("parts"))
        for at in range(0, batch.num_rows, 64):
            rows = [x for _, x in zip(range(min(64, batch.num_rows - at)), whole)]
            yield {name: batch.column(name).slice(at, 64) for name in ("key", "copies")} | out(codec(path), rows)

    size = F.length("text")
    here = over_batches(rows.where(F.coalesce(size, F.lit(0)) <= leaf), short, f"key {key_type}, {schema}", keep=True)
    long = rows.where(size > leaf).withColumn("row", F.xxhash64("key", "text"))
    dealt = over_batches(long, leaves, f"key {key_type}, row bigint, at int, part binary", keep=True)
    # Equal rows of one key have equal leaves: these are encoded once, and the result is given as often as the row was there.
    once = dealt.groupBy("key", "row", "at").agg(F.first("part").alias("part"), F.count("*").alias("copies"))
    done = over_batches(once, leaf_forms, f"key {key_type}, row bigint, at int, copies bigint, ids binary", keep=True)
    gathered = done.groupBy("key", "row").agg(F.collect_list(F.struct("at", "ids")).alias("parts"), F.max("copies").alias("copies"))
    whole = over_batches(gathered, joined, f"key {key_type}, copies bigint, {schema}", keep=True)
    again = whole.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies")
    return here.unionByName(again).withColumnRenamed("key", key)
