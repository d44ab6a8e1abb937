import math
import random

import duckdb
import numpy as np
import pytest

from priorframe.llm import hard_negatives as H
from priorframe.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row int"


def brute(rows, every=100, k=5, scale=256):
    """Rows of (id, vector, label) to (anchor, positive, rank, negative, positive score, negative score)."""
    usable = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows
              if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v, y) in enumerate(usable):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, n, z) for n, (j, w, z) in enumerate(usable) if n != at and len(w) == len(v)]
        scored.sort()
        for p, j, _, _ in [s for s in scored if s[3] == y][:k]:
            hard = [s for s in scored if s[3] != y and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            out += [(i, j, r, h[1], -p, -h[0]) for r, h in enumerate(hard, 1)]
    return sorted(out)


def plain(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 0) for i, v, y in rows], SCHEMA)


def f32(v):
    return [np.float32(x).item() for x in v]


@pytest.mark.parametrize("shard_rows", [16_384, 70])
def test_query_equals_brute_force(spark, sf, shard_rows):
    df = H.relabel(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    want = brute(rows, every=10)
    assert len(want) > 20 and plain(H.hard_negatives(df, every=10, shard_rows=shard_rows)) == want


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{at}/embeddings.parquet'")
    want = sorted(tuple(r[c] for c in range(6)) for r in con.sql(queries.ORACLES["op11_hard_negatives"]).fetchall())
    assert plain(queries.op11_hard_negatives(spark, at)) == want


def test_clusters_ties_and_copies(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(1200):
        base = centres[i % 6]
        rows.append((i, f32(base if i % 3 == 0 else [x + rng.gauss(0, 0.05) for x in base]), i % 4))
    want = brute(rows)
    assert want and plain(H.hard_negatives(frame(spark, rows), shard_rows=400)) == want


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (40, 16))
    rows = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(0, 10, (6000, 16)))
    ids, labels = np.arange(6000), np.zeros(6000, np.int64)
    tree = H.CoverTree(rows, ids, ids, labels)
    tested = 0

    def allowed(q, m):
        nonlocal tested
        tested += len(q)
        return np.ones(len(q), bool)

    queries_ = rows[::300]
    none = np.full(len(queries_), np.inf)
    q, m, s = tree.search(queries_, -none, none, allowed, 5)
    full = queries_ @ rows.T
    for k in range(len(queries_)):
        want = np.lexsort((ids, -full[k]))[:5]
        assert m[q == k].tolist() == want.tolist() and s[q == k].tolist() == full[k][want].tolist()
    assert tested < 0.2 * full.size

    def reach(node):
        centre, radius, children, members = node
        assert (tree._away(centre, members) <= radius + 1e-9).all()
        if children:
            assert sorted(np.concatenate([c[3] for c in children]).tolist()) == sorted(members.tolist())
            [reach(c) for c in children]

    reach(tree.root)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.45, 2.0], 2), (2, [0.45, 2.0], 2), (3, [0.45, 1.0], 3), (4, None, 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 2),
            (7, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (100, [-1.0, 0.0], 1), (200, [1.0, 0.0, 0.0], 1), (300, [], 5), (301, [], 5), (302, [], 6), (400, [0.0, 0.0], 9),
            (8, [float("inf"), 0.0], 2), (0, [1.0, 0.0], 2), (9, [-1e-9, 0.0], 9)]
    plain_rows = [(i, None if v is None else [None if x is None else np.float32(x).item() for x in v], y) for i, v, y in rows]
    got = plain(H.hard_negatives(frame(spark, rows)))
    assert got == brute(plain_rows) and (300, 301, 1, 302, 0, 0) in got
    assert H.hard_negatives(frame(spark, rows[:3]).limit(0)).count() == 0


def test_long_vectors_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, f32([rng.uniform(-1, 1) * 3e6 for _ in range(3)]), i % 3) for i in range(60)]
    assert plain(H.hard_negatives(frame(spark, rows), every=20)) == brute(rows, every=20)

