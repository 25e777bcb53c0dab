"""Operators that judge each row alone, against plain Python versions."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hitscope.llm import bpe, media, packing, quality, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b c a b c", "naïve 日本語 <|endoftext|> don't 12345 !!!\x00x", "x" * 70_000 + " y", "Été ÇA  z",
       "one two three\none two three\n\none two three", "퟿￿ 👍🏽 é", "<|startoftext|>" * 3, "word " * 9_000, "#" * 300 + "\t\x0b\x0c\r"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", None) for i, t in enumerate(ODD)] + [(4, "a", None, 1), (4, "a", None, 1), (None, "null key", None, 2), (7, "x" * 70_000 + " y", "x", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, row string, copies int").repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def reference_quality(text):
    words = [(m.start(), m.group()) for m in WORD.finditer(text or "")]
    only = [w for _, w in words]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(only, only[1:], only[2:]))
    covered = {i + k for i, g in enumerate(zip(only, only[1:], only[2:])) if grams[g] > 1 for k in range(3)}
    return len(only), sum(map(len, only)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(only) < 50 or 100 * len(covered) > 50 * len(only)


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_quality_counts(request, table):
    df = request.getfixturevalue(table)
    texts = sorted(((r["doc_id"] or -1, r["text"]) for r in df.collect()), key=str)
    got = sorted(((r["doc_id"] or -1, *r[1:7]) for r in quality.verdicts(df).collect()), key=str)
    assert got == sorted(((i, *reference_quality(t)) for i, t in texts), key=str)


def test_quality_lines(spark):
    prose = " ".join(f"The hill{i} was green and the river{i} ran below{i} it, as it{i} had." for i in range(6))
    lines = {"prose": prose, "nav": "Home | About | News | Contact | Help | Map", "shout": "BUY!! NOW!! TODAY!! CHEAP!! GOODS!! HERE!!", "echo": "of " * 40,
             "phrase": "Copyright by the owner. All Rights Reserved."}
    text = "\n".join(lines.values())
    row = quality.clean_lines(spark.createDataFrame([(1, text), (2, prose), (3, lines["nav"] * 9), (4, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert row[0]["cleaned"] == prose and row[0]["n_failed_lines"] == 4 and row[0]["kept"]
    assert row[1]["kept"] and row[1]["cleaned"] == prose
    assert not row[2]["kept"] and row[3]["cleaned"] is None and not row[3]["kept"]
    kept = quality.accepted(spark.createDataFrame([(2, prose, 7)], "doc_id int, text string, kept int")).collect()
    assert [tuple(r) for r in kept] == [(2, prose, 7)]


def test_quality_keeps_clean_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    judged = quality.verdicts(docs).join(labels, "doc_id").where("not base_failed")
    assert judged.where("not kept").count() == 0 < judged.count()


@pytest.mark.parametrize("table", ["odd", "docs"])
def test_bpe_equals_the_library(request, table):
    df = request.getfixturevalue(table)
    t = Tokenizer.from_file(PATH)

    def expected(r):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        return (r["doc_id"] or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    want = sorted(map(expected, df.collect()))
    for leaf in (bpe.LEAF, 100):
        assert sorted((r[0] or -1, *r[1:]) for r in bpe.digests(df, PATH, leaf=leaf).collect()) == want


def test_bpe_round_trip(docs):
    ids = bpe.encode(docs, PATH)
    text = {r["doc_id"]: r["text"] for r in bpe.decode(ids, PATH).collect()}
    t = Tokenizer.from_file(PATH)
    for r in ids.collect():
        assert text[r["doc_id"]] == t.decode(r["ids"], skip_special_tokens=False) and r["n_tokens"] == len(r["ids"])


def test_tree_concatenation_of_unsplit_text():
    import random

    c, t, rng = bpe.Codec(PATH), Tokenizer.from_file(PATH), random.Random(5)
    c.leaf = 16
    for _ in range(400):
        alphabet = rng.choice(["ab", "abc", "theranion", "éèêabc", "!?.-", "aA1<|endoftext|>", "日本語a"])
        word = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400)))
        assert c.tree(word) == t.encode(word, add_special_tokens=False).ids, word


def test_cut_keeps_everything_but_one_blank():
    text = b"ab cd\tef " * 50 + b"x" * 500 + b" end"
    parts = bpe.cut(text, 40)
    assert b" ".join(b" ".join(parts).split()) == b" ".join(text.split())


def test_media(odd):
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    stored = media.store(odd)
    for r in stored.collect():
        assert media.from_wav(r["media"])[: r["n_bytes"]] in {(t or "").encode() for _, t in rows}
    for r in media.read_back(stored).collect():
        texts = [(t or "").encode() for i, t in rows if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]]
        payload = next(p for p in map(media.padded, texts) if hashlib.sha256(p).hexdigest() == r["payload_sha256"])
        assert len(payload) == r["payload_bytes"] > 0 == len(payload) % 64 and zlib.crc32(payload[-64:]) == r["tail_crc32"]
        assert hashlib.sha256(media.to_wav(payload)).hexdigest() == r["media_sha256"] and r["feature"].startswith("audio/wav;corrected=1;")
    assert media.read_back(stored).count() == odd.count()


def small_files():
    import gzip
    import io
    import struct
    import zipfile

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "text")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    mp4 = struct.pack(">I4s4sI", 16, b"ftyp", b"isom", 0) + struct.pack(">I4s", 8, b"moov")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03\x01\x12\xff\x00\x34\xff\xd9"
    ogg = b"OggS\x00\x06" + bytes(20) + b"\x01\x02ab"
    pdf = b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF"
    flac = b"fLaC\x80\x00\x00\x22" + bytes(34) + b"\xff\xf8"
    return {"image/png": png, "image/gif": gif, "application/zip": box.getvalue(), "application/gzip": gzip.compress(b"hello"), "image/bmp": bmp,
            "video/mp4": mp4, "image/jpeg": jpeg, "audio/ogg": ogg, "application/pdf": pdf, "audio/wav": media.to_wav(b"\x80" * 64)} | {"_flac": flac}


def test_sniffing_and_carving(spark):
    files = small_files()
    flac = files.pop("_flac")
    rows = [(i, bytes(f), "text/plain") for i, f in enumerate(files.values())] + [(90, None, None), (91, b"", "x"), (92, b"BM and PK\x03\x04 but no file", UNK := media.UNKNOWN)]
    rows += [(93, b"..." + files["image/png"] + b"--" + files["application/gzip"], UNK), (94, files["image/png"][:-3], "image/png")]
    df = spark.createDataFrame(rows, "doc_id int, media binary, declared string")
    got = {r["doc_id"]: r for r in media.sniff(df, "media", "declared").collect()}
    for i, (kind, f) in enumerate(files.items()):
        assert (got[i]["detected_type"], got[i]["file_bytes"], got[i]["corrected"]) == (kind, len(f), True)
    assert got[90]["detected_type"] is None and got[91]["detected_type"] == UNK and got[92]["detected_type"] == UNK and not got[92]["corrected"]
    assert [(e["start"], e["type"]) for e in got[93]["embedded"]] == [(3, "image/png"), (5 + len(files["image/png"]), "application/gzip")]
    assert got[94]["detected_type"] == UNK and got[94]["corrected"]  # cut short: not confirmed
    carved = [bytes(r["media"]) for r in media.carve(df, "media").where("doc_id = 93").orderBy("start").collect()]
    assert carved == [files["image/png"], files["application/gzip"]]
    assert next(media.find_media(flac))[2] == "audio/flac"


def brute_fill(names, slots):
    place = [int(hashlib.md5(f"offset/{n}".encode()).hexdigest()[:15], 16) % slots for n in names]
    skip = [int(hashlib.md5(f"skip/{n}".encode()).hexdigest()[:15], 16) % (slots - 1) + 1 for n in names]
    prefer = [[(p + j * s) % slots for j in range(slots)] for p, s in zip(place, skip)]
    owner, turn = {}, 0
    while len(owner) < slots:
        i = turn % len(names)
        slot = next(x for x in prefer[i] if x not in owner)
        owner[slot], turn = i, turn + 1
    return [owner[x] for x in range(slots)]


def test_sharding(spark, odd):
    names = [f"s{i}" for i in range(7)]
    assert list(sharding.fill(names, 211)) == brute_fill(names, 211)
    with pytest.raises(ValueError):
        sharding.fill(names, 210)
    with pytest.raises(ValueError):
        sharding.fill(["a", "a"], 211)
    placed = sharding.place(odd.withColumnRenamed("copies", "slot"), "doc_id", names, 211)
    table = sharding.fill(names, 211)
    for r in placed.collect():
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["slot"] == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 211 and r["shard"] == names[table[r["slot"]]]
    assert placed.count() == odd.count() and placed.columns == ["doc_id", "text", "row", "slot", "shard"]
    assert sharding.place(odd.limit(0), "doc_id", names, 211).count() == 0
    assert sharding.moved_slots(names, names[:-1], 211) < 0.35
    big = Counter(sharding.fill([f"n{i}" for i in range(256)]).tolist())
    assert max(big.values()) - min(big.values()) <= 1


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(odd.select("doc_id", "text"), "doc_id", ["a", "b"], str(tmp_path / "out"), files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()


def exact_bins(items, capacity):
    best = [len(items)]

    def search(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= items[i]}.values()):
            rooms[k] -= items[i]
            search(i + 1, rooms)
            rooms[k] += items[i]
        search(i + 1, rooms + [capacity - items[i]])

    items = sorted(items, reverse=True)
    search(0, [])
    return best[0]


def test_plans_are_sound_and_near_the_best():
    import random

    rng = random.Random(3)
    for trial in range(300):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 11))]
        plan = packing.make_plan(Counter(items), capacity)
        used = Counter()
        for n, contents in plan.patterns:
            assert n > 0 and sum(length * each for length, each in contents) <= capacity
            for length, each in contents:
                used[length] += n * each
        assert used == Counter(items)
        assert plan.sequences() <= exact_bins(items, capacity) + 1
        # what the reduction alone fixes never costs a sequence
        stock, fixed = packing._Stock(Counter(items)), packing.Plan(capacity)
        packing.reduce_by_dominance(stock, fixed)
        rest = [k for k, v in stock.left.items() for _ in range(v)]
        assert fixed.sequences() + exact_bins(rest, capacity) == exact_bins(items, capacity)


def test_packing(spark, odd):
    t = Tokenizer.from_file(PATH)
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = packing.packed(df, PATH, with_ids=True).collect()
        want = Counter()
        for r in df.collect():
            ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 2048):
                part = ids[k: k + 2048]
                want[(r["doc_id"], k // 2048, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        by = {}
        for r in rows:
            assert len(r["ids"]) == r["length"]
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in by.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048
        assert len(by) <= sum(r["length"] for r in rows) / 2048 * 1.02 + 2
    assert packing.packed(odd.limit(0), PATH).count() == 0


def test_empty_tables(odd):
    none = odd.limit(0)
    for df in (quality.verdicts(none), quality.clean_lines(none), bpe.digests(none, PATH), bpe.encode(none, PATH), media.read_back(media.store(none)),
               quality.accepted(none)):
        assert df.count() == 0


def test_placement_oracle(spark):
    import duckdb

    from hitscope.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = Counter(con.execute(queries.ORACLES["op1_shard_placement"]).fetchall())
    assert Counter((r["doc_id"], r["slot"], r["shard"]) for r in queries.op1_shard_placement(spark, SF).collect()) == want


def test_bpe_sends_only_ids_and_spells_them_in_stretches(spark, monkeypatch):
    """The parts of long texts meet as ids, not as their texts; a long row is spelled a stretch at a time."""
    monkeypatch.setattr(bpe, "SPELLED", 7)
    t, text = Tokenizer.from_file(PATH), "Some words, and more of them: " * 40
    c = bpe.Codec(PATH)
    stretches = list(c.spell(c.raw(text.encode())))
    ids = t.encode(text, add_special_tokens=False).ids
    assert len(stretches) > 10 and b"".join(x for x, _ in stretches).decode() == " ".join(map(str, ids))
    assert b"".join(x for _, x in stretches).decode() == t.decode(ids, skip_special_tokens=False)
    assert list(c.spell(b"")) == []
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    plan = bpe.digests(df, PATH, leaf=100)._jdf.queryExecution().analyzed().toString()
    met = [line for line in plan.splitlines() if "collect_list" in line]
    assert met and all("struct(at, at#" in line and line.count("ids#") == 1 for line in met)


def test_other_tasks_make_a_worker_forget_its_tokenizer():
    from hitscope.llm import text

    bpe.codec(PATH).raw(b"some words")
    assert PATH in bpe._codecs
    text.forget()
    assert not bpe._codecs
