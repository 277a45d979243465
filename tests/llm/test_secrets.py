"""Secret scanning against plain finditer over whole texts."""

import base64
import hashlib
import json
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import secrets as sc

BASE = [("assign", sc.ASSIGN, lambda m: len(m[2]) >= 8), ("access", sc.ACCESS, lambda m: len(m[0]) >= 16), ("hex", sc.HEX, lambda m: len(m[0]) >= 32)]


def brute(text):
    out = [(m.start(), m.end(), k) for k, p, good in BASE for m in p.finditer(text) if good(m)]
    return sorted(out, key=lambda s: (s[0], sc.KINDS.index(s[2])))


def base(text):
    return [s for s in sc.find_secrets(text) if s[2] in sc.KINDS[:3]]


PIECES = ["password", "PassWd", "ſecret", "secret", "TOKEN", "api_key", "apikey", "APIKey", "=", ":", " ", "'", '"', "AKIA", "akia", "ABCDEFGH0123", "0a1b2c3d", "f" * 31, "é", "İ", "K", "x", "\n", "abcdefgh", "-._/", "passwordpassword=", "deadbeef" * 4]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_base(text):
    assert base(text) == brute(text)


def test_hex_edges():
    for pad in range(20):
        for n in (31, 32, 33, 40, 64):
            text = "g" * pad + "a" * n + "G" + "0" * n
            assert base(text) == brute(text), (pad, n)


def jwt():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{part({'alg': 'none'})}.{part({'sub': 1})}.c2ln"


def test_validated_kinds():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{sc.base62_crc(body)}"
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    key = "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----"
    text = f"{good} {bad} {jwt()} eyJhbGci.eyJub3Q.x {key} -----BEGIN PRIVATE KEY----- postgres://bob:hunter22@db/x"
    kinds = [(k, text[s:e]) for s, e, k in sc.find_secrets(text)]
    assert kinds == [("checked_token", good), ("jwt", jwt()), ("private_key", key), ("url_password", "://bob:hunter22")]
    assert sc.redacted("a token = abcdefgh1 b", sc.find_secrets("a token = abcdefgh1 b")) == "a [ASSIGN] b"


def test_linear_time():
    units = ["eyJ", "-----BEGIN PRIVATE KEY-----", "-----BEGIN A1 PRIVATE KEY-----x", "token = ", "AKIA", "password", "ab12" * 7 + "g", "xoxb-", "://a:", "-----END PRIVATE KEY-----"]
    units += ["".join(f"-----BEGIN K{i} PRIVATE KEY-----" for i in range(500))]
    for unit in units:
        took = []
        for n in (200_000, 800_000):
            text = unit * (n // len(unit))
            began = time.perf_counter()
            sc.find_secrets(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 9 * took[0] + 0.3, (unit[:40], took)  # four times the text


def test_nested_keys():
    key = "-----BEGIN PRIVATE KEY-----"
    end = "-----END PRIVATE KEY-----"
    text = f"{end} {key} a {key} b {end} {key} c"
    at = text.index(key)
    assert sc.find_secrets(text) == [(at, text.index(end, at) + len(end), "private_key")]


def test_redact(spark):
    rows = [(1, "a token = abcdefgh1 b", {"k": 1}), (2, None, None), (3, "", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>")
    out = sc.redact(df)
    assert out.columns == df.columns and [r.text for r in out.orderBy("doc_id").collect()] == ["a [ASSIGN] b", None, ""]


def test_operator(spark):
    texts = ["token = 'abcdefghij'", None, "", "é " * 40000 + "AKIA" + "Q" * 16, "secret: short", "token = 'abcdefghij'"]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = sc.scan_secrets(df).collect()
    assert [[(s.start, s.end, s.kind) for s in r.spans] for r in rows] == [sc.find_secrets(t or "") for t in texts]
    assert sc.scan_secrets(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sc.op1_secret_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for *_, k in want) for x in sc.KINDS[:3])
        assert not want or re.search(joined.split(",")[0], r.spans)
