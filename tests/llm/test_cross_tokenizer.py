import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from priorframe.llm import cross_tokenizer as X
from priorframe.llm import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_level():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def spans(ids, raw):
    out, at = [], 0
    for k, t in zip(ids, raw):
        out.append((k, at, at + len(t)))
        at += len(t)
    return out


def one(text, a, b):
    """(groups, links) of a text by plain loops, or nothing."""
    if not text:
        return [], []
    byte, whole = byte_level(), (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in ids_a]
    raw_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return [], []
    sa, sb = spans(ids_a, raw_a), spans(ids_b, raw_b)
    cuts = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
    groups, low = [], 0
    for cut in cuts:
        groups.append(([k for k, s, e in sa if low <= s and e <= cut], [k for k, s, e in sb if low <= s and e <= cut]))
        low = cut
    links, j0 = [], 0
    for k, s, e in sa:
        while sb[j0][2] <= s:
            j0 += 1
        j = j0
        while j < len(sb) and sb[j][1] < e:
            links.append((k, sb[j][0]))
            j += 1
    return groups, links


def brute(texts, libraries):
    found = [one(t, *libraries) for t in texts]
    count, most = Counter(), defaultdict(int)
    for _, links in found:
        count.update(set(links))
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for groups, links in found:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        out.append((n_a, n_b, len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), digest))
    return out


def plain(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)


TEXTS = ["The cat", "", None, "<|endoftext|> and <s> </s> <unk>", "a▁b", "  two  spaces ", "日本語のテキスト", "naïve café \U0001f642\U0001f642", "\t\nx\r\n", "\x00\x01",
         "<0x41>", "The cat", "é", "ﬁne", "x" * 5000, " ", "　ideographic", "ｆｕｌｌ"]


def test_odd_texts_equal_plain_loops(spark, libraries):
    rows = [(k if k % 5 else None, t, "x", k) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string, chunk long")
    want = sorted(zip([r[0] is None for r in rows], [r[0] or 0 for r in rows], brute(TEXTS, libraries)))
    for size in (1 << 23, 1):
        got = X.align(df, A, B, chunk_bytes=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, plain(r)) for r in got) == want
    assert X.align(df.limit(0), A, B).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select 1L as doc_id, cast(x'6162ff63' as string) as text union all select 2L, 'ab'")
    got = {r.doc_id: plain(r) for r in X.align(df, A, B).collect()}
    assert got[1] == EMPTY and got[2][0] > 0


def test_large_ids_stay_whole(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "ab cd"), (None, "ab")], "doc_id long, text string")
    assert {r.doc_id for r in X.align(df, A, B).collect()} == {big, None}


def test_whole_table_equals_plain_loops(spark, sf, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([r[0] for r in rows], brute([r[1] for r in rows], libraries)))
    got = {r.doc_id: plain(r) for r in queries.op12_token_alignment(spark, sf).collect()}
    assert len(got) == len(rows) and got == want


def test_long_texts_are_cut_without_effect(libraries, monkeypatch):
    rng = random.Random(6)
    words = ["the", "  ", " a", "straße", "日本", "\n\n", "x1", "'s", "▁", "\t "]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(400)) for _ in range(40)]
    codec = X.PieceCodec(B)
    want = [libraries[1].encode(t) for t in texts]
    monkeypatch.setattr(X, "GROUP_CHARS", 50)
    ids, offsets = codec.encode_group(texts)
    assert codec.may_cut and [part.tolist() for part in np.split(ids, offsets[1:-1])] == want


def test_groups_of_intervals():
    rng = random.Random(2)
    for _ in range(300):
        ends = [sorted({*rng.sample(range(1, 30), rng.randint(0, 12)), 30}) for _ in range(2)]
        starts = [[0, *e[:-1]] for e in ends]
        group = X.coalesce(np.array(sum(starts, [])), np.array(sum(ends, [])))
        shared = sorted(set(ends[0]) & set(ends[1]))
        want = [sum(c <= s for c in shared) for s in sum(starts, [])]
        assert group.tolist() == want


def test_groups_column_and_link_table(spark, libraries):
    df = spark.createDataFrame([(1, "The naïve cat", 5), (2, None, 6), (3, "The cat", 7)], "doc_id long, text string, groups int")
    got = {r.doc_id: r.groups for r in X.with_groups(df, A, B).collect()}
    for k, text in ((1, "The naïve cat"), (3, "The cat")):
        want = one(text, *libraries)[0]
        assert [(list(g.a), list(g.b)) for g in got[k]] == want
        assert got[k][0].start == 0 and got[k][-1].end == len((" " + text).encode())
        assert all(x.end == y.start for x, y in zip(got[k], got[k][1:]))
    assert got[2] == []
    links = {(r.a_id, r.b_id): (r.n_docs, r.best) for r in X.token_links(df, A, B).collect()}
    count = Counter(x for t in ("The naïve cat", "The cat") for x in set(one(t, *libraries)[1]))
    assert {k: v[0] for k, v in links.items()} == dict(count)
