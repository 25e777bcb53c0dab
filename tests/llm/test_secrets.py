"""Secret spans against a scanner without regular expressions, and verdicts by ownership."""

import hashlib
import string

import pytest

from hitscope.llm import secrets
from hitscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
VALUE = string.ascii_letters + string.digits + "+/_.=-"
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
LONG = "Zx9" + "aB3dE6gH1jK4" * 3


def run_of(text, at, allowed):
    end = at
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def assign_at(text, at):
    """End and value of an assignment that begins at ``at``, of any length, or None."""
    name = next((n for n in NAMES if text[at: at + len(n)].translate(LOWER) == n), None)
    if name is None:
        return None
    p = at + len(name)
    p += text[p: p + 1] in ('"', "'")
    p = run_of(text, p, " ")
    if text[p: p + 1] not in (":", "=") or p >= len(text):
        return None
    p = run_of(text, p + 1, " ")
    p += text[p: p + 1] in ('"', "'")
    end = run_of(text, p, VALUE)
    return (end, text[p:end]) if end > p else None


LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_base(text):
    out, at = [], 0
    while at < len(text):
        found = assign_at(text, at)
        if found and len(found[1]) >= 12:
            out.append((at, 0, found[0]))
        at = found[0] if found else at + 1
    for number, allowed, shortest, head in ((1, string.ascii_uppercase + string.digits, 18, "AKIA"), (2, "0123456789abcdef", 16, "")):
        at = 0
        while at < len(text):
            end = run_of(text, at + len(head), allowed) if text.startswith(head, at) else at
            if end > at + len(head) and end - at >= shortest:
                out.append((at, number, end))
            at = end if end > at + len(head) else at + 1
    return sorted(out)


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


ODD = [None, "", "token", 'token = "' + "a1" * 10 + '" é password:short secret: "' + "x" * 12, "TOKEN='abcdefghijkl' Api_Key : 0123456789abcdef0123",
       "toKen=aaaaaaaaaaaaaaa", "ſecret=aaaaaaaaaaaaaaaa paſſword=aaaaaaaaaaaaaa", "apikey=password=token=abcdefghijkl", "secret:\ntoken=abcdefghijklm", "AKIA" * 9 + " AKIAB AKIA" + "1" * 13 + " AKIA" + "1" * 14,
       "0123456789abcdef 0123456789abcde F0123456789abcdef0é", "日本 token  :  'abcdefghijkl日本", "token " * 400 + "=" * 30, " " * 70_000 + "secret" + " " * 70_000 + "= abcdefghijkl", "token=token=token=a token=bbbbbbbbbbbb"]


@pytest.mark.parametrize("table", ["odd", "given"])
def test_base_spans(spark, table):
    if table == "odd":
        df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[4])], "doc_id bigint, text string").repartition(3)
    else:
        df = spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in df.collect():
        base = plain_base(r["text"] or "")
        want.append((r["doc_id"], *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base)))
    rows = secrets.scan(df, owner=None).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted((w[:5] for w in want), key=str)
    for r in rows:
        kept = [s for s in r["spans"].split(",") if s and s.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r["base_sha256"]


def forms():
    return {"private_key": "-----BEGIN RSA PRIVATE KEY-----\n" + "QUJD" * 9 + "\n-----END RSA PRIVATE KEY-----", "signed_token": "eyJhbGciOiJI.eyJzdWIiOiI." + "c2lnbmF0",
            "url_login": "maria:s3cretly", "prefixed": "ghp_" + "abcDEF123" * 4, "random": LONG}


def test_ownership_tells_examples_from_live_ones(spark):
    rows, expected = [], {}
    for n, (kind, value) in enumerate(forms().items()):
        text = f"é see postgres://{value}@host now" if kind == "url_login" else f"é see {value} now"
        live, copied = text, text.replace("1", "2").replace("QUJD", "QUJE").replace("c2ln", "c3ln").replace("s3cretly", "hunter22")
        assert kind in ("private_key", "signed_token", "url_login") or live != copied
        rows += [(10 * n, live, "alone"), (10 * n + 1, live, "alone")] + [(10 * n + 2 + k, copied, f"owner {k}") for k in range(5)]
        start = text.index(value)
        if kind == "random":
            end = start + len(value)
        else:
            end = start + len(value) + (1 if kind == "url_login" else 0)
        expected |= {10 * n: f"{kind}:{start}:{end}", 10 * n + 1: f"{kind}:{start}:{end}"} | {10 * n + 2 + k: "" for k in range(5)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    assert {r["doc_id"]: r["spans"] for r in secrets.scan(df, owner="source").collect()} == expected
    everyone = {r["doc_id"]: r["n_added"] for r in secrets.scan(df, owner="source", max_owners=5).collect()}
    assert set(everyone.values()) == {1}
    told = {(r["key_"], r["kind"]): (r["n_owners"], r["n_repositories"]) for r in secrets.owned(df.withColumnRenamed("doc_id", "key_"), key="key_", owner="source").collect()}
    assert told[0, "private_key"] == (1, 2) and told[2, "private_key"] == (5, 5)


def test_base_stays_and_seldom_values_are_joined(spark, monkeypatch):
    text = f"token = '{'a1' * 8}' and {LONG}"
    rows = [(i, text, None) for i in range(4)] + [(9, "x " + LONG.replace("9", "8"), "s"), (9, "x " + LONG.replace("9", "8"), "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for share in (2.0, 0.0):  # all values joined, all values sent
        monkeypatch.setattr(secrets, "FREQUENT", share)
        found = sorted((r["doc_id"], r["n_assign"], r["n_hex"], r["n_added"]) for r in secrets.scan(df, owner="source").collect())
        assert found == [(i, 1, 1, 1) for i in range(4)] + [(9, 0, 0, 1)] * 2


def test_columns_and_empty_tables(spark):
    none = secrets.scan(spark.createDataFrame([], "doc_id int, text string, source string"), owner="source")
    assert none.collect() == [] and none.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]
    clash = spark.createDataFrame([(1, "token=abcdefghijkl", "a", "b", "c", 1, 2, "d")], "key int, found string, owner string, value string, few string, row int, start int, text string")
    assert [tuple(r)[:2] for r in secrets.scan(clash, text="found", key="key", owner="owner", repository="value").collect()] == [(1, 1)]
    assert QUERIES["op12_owned_secrets"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
