import random

import xxhash
from pyspark.sql import functions as F

from priorframe.llm import simhash_dedup as S
from priorframe.llm.linking import connected_components
from priorframe.llm.scratch import Scratch


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    got = S.near_duplicates(docs).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)


def test_chains_of_close_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    marks = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            marks.append(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    prints = dict(enumerate(marks))
    rows = [(k, m - (1 << 64) if m >> 63 else m) for k, m in prints.items()]
    monkeypatch.setattr(S, "fingerprints", lambda *_: spark.createDataFrame(rows, "doc_id long, mark long"))
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.range(1)).collect()}
    assert got == brute_components(prints)


def test_every_close_half_shares_the_home_anchor():
    masks = S.replication_masks()
    assert all(sum(s == k for s, _, _ in masks) == (17 if k else 2) for k in range(32))


def test_nulls_empties_and_repeats(spark):
    rows = [(5, None, 1), (3, "", 1), (9, " \n", 1), (7, "One two", 2), (7, "One two", 2), (None, "one TWO", 3), (2, "a b c d e", 4)]
    out = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, mark int")).collect()
    assert len(out) == 7
    assert {r.doc_id: r.component_id for r in out if r.doc_id in (3, 5, 9)} == {3: 3, 5: 3, 9: 3}
    assert {r.component_id for r in out if r.doc_id in (7, None)} == {7}
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = connected_components(Scratch(spark, "path"), edges).collect()
    assert {r.comp for r in out} == {0} and len(out) == 61


def test_a_very_long_text(spark):
    long = " ".join(f"w{(k * 7919) % 4001}" for k in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "short text of five words")], "doc_id long, text string")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.near_duplicates(df).collect()}
    assert got[1] == (brute_print(long), 1) and got[2][1] == 1 and got[3][1] == 3
