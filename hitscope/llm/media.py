"""Media columns: stored payloads, signature sniffing and carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one
pass over the bytes; a validator of the format then walks its structure and
says where the file ends.  What is confirmed at the first byte and fills the
value is its type, whatever was declared; what is confirmed elsewhere is an
embedded file and can be carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import named, over_batches

#: Magic bytes, where they stand from the file's start, and the format: fixed values of the formats.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"BM", 0, "bmp"),
    (b"OggS\x00", 0, "ogg"),
    (b"fLaC", 0, "flac"),
    (b"ftyp", 4, "mp4"),
)

UNKNOWN = "application/octet-stream"
_TYPES = {"png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip",
          "bmp": "image/bmp", "ogg": "audio/ogg", "flac": "audio/flac", "mp4": "video/mp4"}
_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, at, kind in SIGNATURES:
        found.add_word(magic.decode("latin-1"), (len(magic), at, kind))
    found.make_automaton()
    return found


# Validators: the end of the file that starts at ``at``, or None.  They never read beyond the value.

def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13):
            return None
        if zlib.crc32(memoryview(b)[p + 4: p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p):
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1
        if kind == 0x21:
            p = blocks(p + 2)
        elif kind == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 10 + (3 << (local & 7) + 1 if local & 0x80 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if kind == 0xDA:
            while True:  # coded data: up to the next marker that is neither stuffing nor a restart
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0xD9:
                    return p + 2
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b) or b[at + 8: at + 12] not in _RIFF:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p = at + 12
    while p + 8 <= end <= len(b):
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + n % 2
    return end if p in (end, end + 1) and end <= len(b) else None


def _pdf(b: bytes, at: int) -> int | None:
    end = b.find(b"%%EOF", at)
    return end + 5 if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


def _zip(b: bytes, at: int) -> int | None:
    end = b.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    ok = at + start + size == end and (b[at + start: at + start + 4] == b"PK\x01\x02" or size == 0)
    return end + 22 + note if ok and end + 22 + note <= len(b) else None


def _gzip(b: bytes, at: int) -> int | None:
    unpack, p, step = zlib.decompressobj(31), at, 1 << 16
    try:
        while p < len(b) and not unpack.eof:
            part = b[p: p + step]
            unpack.decompress(part, 1 << 20)
            while unpack.unconsumed_tail and not unpack.eof:  # never holds more than a megabyte of what it unpacks
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            p += len(part)
    except zlib.error:
        return None
    return p - len(unpack.unused_data) if unpack.eof else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    ok = zero == 0 and header in (40, 52, 56, 108, 124) and 14 + header <= start <= size and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if ok and at + size <= len(b) else None


def _ogg(b: bytes, at: int) -> int | None:
    p = at
    while b[p: p + 5] == b"OggS\x00" and p + 27 <= len(b):
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27: p + 27 + n])
        if p + 27 + n > len(b) or end > len(b):
            return None
        last, p = b[p + 5] & 4, end
        if last:
            return p
    return None


def _flac(b: bytes, at: int) -> int | None:
    p = at + 4
    if len(b) < p + 4 or b[p] & 0x7F or int.from_bytes(b[p + 1: p + 4], "big") != 34:  # the stream's own block comes first
        return None
    while p + 4 <= len(b):
        last, n = b[p] >> 7, int.from_bytes(b[p + 1: p + 4], "big")
        p += 4 + n
        if last:
            return len(b) if p < len(b) and b[p: p + 1] == b"\xff" else None  # frames carry no length: to the end
    return None


def _mp4(b: bytes, at: int) -> int | None:
    p, seen = at, set()
    while p + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if not all(32 <= c < 127 for c in kind):
            break
        if n == 1 and p + 16 <= len(b):
            n = struct.unpack_from(">Q", b, p + 8)[0]
        if n < 8 or p + n > len(b):
            break
        seen.add(kind)
        p += n
    return p if {b"ftyp", b"moov"} <= seen or {b"ftyp", b"mdat"} <= seen else None


_VALIDATORS = {"png": _png, "gif": _gif, "jpeg": _jpeg, "riff": _riff, "pdf": _pdf, "zip": _zip, "gzip": _gzip, "bmp": _bmp, "ogg": _ogg,
               "flac": _flac, "mp4": _mp4}


def find_media(value: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, type) of every confirmed file in ``value``, by start; one inside another is found too."""
    found = set()
    for last, (n, at, kind) in _automaton().iter(value.decode("latin-1")):
        start = last + 1 - n - at
        if start >= 0 and (end := _VALIDATORS[kind](value, start)) is not None:
            found.add((start, end, _RIFF[value[start + 8: start + 12]] if kind == "riff" else _TYPES[kind]))
    return iter(sorted(found))


def sniff(df: DataFrame, media: str, declared: str | None = None, key: str = "doc_id") -> DataFrame:
    """Per row: key, detected_type, file_bytes, corrected (the declared type was another), and embedded: start, length and type of files inside.

    ``file_bytes`` is how far the file at the first byte goes.  Without one the
    type is ``application/octet-stream`` and file_bytes null; a null value has
    a null type and no embedded files.  Equal values give equal results; null
    and repeated keys are passed on.
    """
    key_type = df.schema[key].dataType.simpleString()
    rows = named(df, key=key, media=media, declared=F.col(declared) if declared else F.lit(None).cast("string"))

    def work(batch):
        out = {n: [] for n in ("detected_type", "file_bytes", "corrected", "starts", "lengths", "types")}
        for value, said in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist()):
            kind, size, inside = None, None, []
            if value is not None:
                kind, found = UNKNOWN, list(find_media(value))
                for start, end, what in found:
                    if start == 0 and size is None:
                        kind, size = what, end
                    else:
                        inside.append((start, end - start, what))
            out["detected_type"].append(kind)
            out["file_bytes"].append(size)
            out["corrected"].append(kind is not None and said is not None and kind != said)
            for i, name in enumerate(("starts", "lengths", "types")):
                out[name].append([x[i] for x in inside])
        yield out | {"key": batch.column("key")}

    flat = over_batches(rows, work, f"key {key_type}, detected_type string, file_bytes bigint, corrected boolean, starts array<bigint>, lengths array<bigint>, types array<string>")
    embedded = F.arrays_zip("starts", "lengths", "types").cast("array<struct<start:bigint,length:bigint,type:string>>")
    return flat.select(F.col("key").alias(key), "detected_type", "file_bytes", "corrected", embedded.alias("embedded"))


def carve(df: DataFrame, media: str, key: str = "doc_id") -> DataFrame:
    """One row for each confirmed file inside a value (not at its first byte): key, start, length, type, media."""
    key_type = df.schema[key].dataType.simpleString()

    def work(batch):
        for k, value in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist()):
            found = [x for x in find_media(value or b"") if x[0]]
            if found:
                yield {"key": [k] * len(found), "start": [s for s, _, _ in found], "length": [e - s for s, e, _ in found],
                       "type": [t for _, _, t in found], "media": [value[s:e] for s, e, _ in found]}

    flat = over_batches(named(df, key=key, media=media), work, f"key {key_type}, start bigint, length bigint, type string, media binary")
    return flat.withColumnRenamed("key", key)


# Storing text bytes as sound -----------------------------------------------------------------------

RATE = 8_000
UNIT = 64


def padded(raw: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples: a WAV file whose samples are the payload's bytes."""
    return (struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload)


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    p = 12
    while p + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, p)
        if kind == b"data":
            return media[p + 8: p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no samples")


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_bytes, media (the stored form) and declared_type.  A null text is empty."""
    key_type = df.schema[key].dataType.simpleString()

    def work(batch):
        texts = batch.column("text").to_pylist()
        for at in range(0, len(texts), 512):
            part = [t or b"" for t in texts[at: at + 512]]
            yield {"key": batch.column("key").slice(at, 512), "n_bytes": [len(t) for t in part], "media": [to_wav(padded(t)) for t in part],
                   "declared_type": [UNKNOWN] * len(part)}

    rows = named(df, key=key, text=F.col(text).cast("binary"))
    return over_batches(rows, work, f"key {key_type}, n_bytes bigint, media binary, declared_type string").withColumnRenamed("key", key)


def read_back(df: DataFrame, media: str = "media", key: str = "doc_id", declared: str = "declared_type") -> DataFrame:
    """Sniffs every stored value and reads its samples.

    Per row: the key, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, and feature: the confirmed type, whether the
    declared one was corrected, embedded files, mean and deviation of the samples.
    """
    key_type = df.schema[key].dataType.simpleString()

    def work(batch):
        rows = zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist())
        out = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for value, said in rows:
            found = list(find_media(value))
            kind = next((t for s, e, t in found if s == 0 and e == len(value)), UNKNOWN)
            if kind != "audio/wav":
                raise ValueError(f"a stored value was sniffed as {kind}")
            payload = from_wav(value)
            inside = ",".join(f"{t}@{s - 44}+{e - s}" for s, e, t in found if s)
            samples = np.frombuffer(payload, np.uint8)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
            out["media_bytes"].append(len(value))
            out["media_sha256"].append(hashlib.sha256(value).hexdigest())
            out["feature"].append(f"{kind};corrected={int(kind != said)};embedded={inside};mean={samples.mean():.4f};deviation={samples.std():.4f}")
        yield out | {"key": batch.column("key"), "n_bytes": batch.column("n_bytes")}

    flat = over_batches(named(df, key=key, n_bytes="n_bytes", media=media, declared=declared), work,
                        f"key {key_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return flat.withColumnRenamed("key", key)
