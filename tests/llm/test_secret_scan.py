import hashlib
import random
import re
import string

import public_tokenizers
import pytest

from priorframe.llm import queries
from priorframe.llm import secret_scan as S

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ORDER = ["assign", "access", "hex"]


@pytest.fixture(scope="module")
def vocab():
    return S.vocabulary(PATH, PATTERN)


def plain_base(text):
    """The three patterns as stated, letter by letter and without shortcuts."""
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    stated = [("assign", rf"({key})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]
    out = []
    for kind, pattern in stated:
        for m in re.finditer(pattern, text):
            size = len(m[2]) if kind == "assign" else m.end() - m.start()
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), ORDER.index(kind), m.end()))
    return [(ORDER[k], s, e) for s, k, e in sorted(out)]


def test_base_equals_the_patterns_as_stated():
    rng = random.Random(3)
    parts = ["password", "PassWd", "SECRET", "toKen", "api_key", "APIKEY", "'", '"', " ", "=", ":", ": ", "AKIA", "A1B2C3D4E5F6", "0a1b2c3d", "abcdef0123456789", "x", ".", "ſecret", "Key", "é", "🙂", "\n", "-", "/", "hunter2hunter2"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert S.base_spans(text) == plain_base(text), text
    text = "".join(rng.choice("0123456789abcdefg=token ") for _ in range(300_000))
    assert S.base_spans(text) == plain_base(text)


def test_random_strings_are_found_and_names_are_not(vocab):
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits
    found = 0
    for n in range(300):
        key = "".join(rng.choice(letters + "+/") for _ in range(rng.randint(24, 64)))
        text = f"see {key}, and"
        found += any(s["kind"] == "random" and (s["start"], s["end"]) == (4, 4 + len(key)) for s in S.spans_of(text, vocab))
    assert found >= 0.95 * 300
    names = ["getUserAccountBalance2024Now", "customer_account_number_2024", "com/en/products/list/2023/item-12", "ORD-2024-000123-778899", "DE89370400440532013000",
             "550e8400-e29b-41d4-a716-446655440000", "jquery-3_6_0-min-bundle-v2", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "2024-01-15T10-22-33-alpha",
             "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "Donaudampfschifffahrtsgesellschaft", "1234567890123456789012345", "md5-d41d8cd98f00b204e9800998"]
    assert [n for n in names if S.spans_of(f"x {n} y", vocab)] == []


def test_spans_of_patterns_are_not_repeated(vocab):
    key = "aB3dE9fGhK2LmN4pQrS7tUvWx1"
    assert [s["kind"] for s in S.spans_of(f"token={key} {key}", vocab)] == ["assign", "random"]
    assert S.redacted(f"token={key} {key}!", S.spans_of(f"token={key} {key}!", vocab)) == "[assign] [random]!"
    both = 'token = "' + "0a" * 20 + '"'
    assert [s["kind"] for s in S.spans_of(both, vocab)] == ["assign", "hex"] and S.redacted(both, S.spans_of(both, vocab)) == '[assign]"'


def test_rows(spark):
    key = "aB3dE9fGhK2LmN4pQrS7tUvWx1"
    rows = [(1, f"é🙂 {key}", 0), (2, None, 0), (3, "", 0), (1, f"é🙂 {key}", 0), (None, "password: abcdefgh", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted(((r.doc_id or 0, r.n_assign, r.n_hex, r.n_random, r.base_sha256, r.spans) for r in S.digest_rows(df, PATH, PATTERN).collect()))
    none = hashlib.sha256(b"").hexdigest()
    one = (1, 0, 0, 1, none, f"random:3:{3 + len(key)}")
    assert got == [(0, 1, 0, 0, hashlib.sha256(b"assign:0:18").hexdigest(), "assign:0:18"), one, one, (2, 0, 0, 0, none, ""), (3, 0, 0, 0, none, "")]
    assert S.digest_rows(df.limit(0), PATH, PATTERN).count() == 0
    out = {r.text: r for r in S.with_spans(df.drop("doc_id").withColumnRenamed("spans", "secrets"), PATH, PATTERN, redacted_col="clean").collect()}
    assert out[f"é🙂 {key}"].clean == "é🙂 [random]" and out[None].clean is None and out[None].secrets == []
    assert out[f"é🙂 {key}"].secrets[0].ratio < 2 and out["password: abcdefgh"].secrets[0].kind == "assign"


def test_a_very_long_run_and_bytes_that_are_no_text(spark, vocab):
    rng = random.Random(9)
    run = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(400_000))
    assert [(s["kind"], s["end"] - s["start"]) for s in S.spans_of(f"a {run} b", vocab)] == [("random", 400_000)]
    df = spark.sql("select 1L as doc_id, cast(x'FF20746f6b656e3d6162636465666768' as string) as text")
    assert S.digest_rows(df, PATH, PATTERN).first().spans == "assign:2:16"


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_secrets(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.n_assign for r in got) > 0
    for r in got:
        base = plain_base(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in ORDER)
