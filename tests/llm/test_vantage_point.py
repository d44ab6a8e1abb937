import math
import random

import numpy as np
import pytest

from priorframe.llm import vantage_point as V

SCHEMA = "vec_id long, embedding array<float>, query_id int"


def brute(rows, every, k):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and any(v) and all(x is not None and math.isfinite(x) for x in v):
            seen[i] = min(seen.get(i, v), v)
    out = {}
    for q in (i for i in seen if i % every == 0):
        found = []
        for i, v in seen.items():
            if i != q and len(v) == len(seen[q]):
                total = 0.0
                for a, b in zip(seen[q], v):
                    total += (float(a) - float(b)) * (float(a) - float(b))
                found.append((math.sqrt(total), i))
        out[q] = sorted(found)[:k]
    return out


def check(got, want):
    rows = {}
    for r in got:
        rows.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in rows.items()} == {q: x for q, x in want.items() if x}
    assert all([r for r, _, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in rows.values())


def test_whole_table_is_exact(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, tuple(r.embedding)) for r in df.collect()], 50, 10)
    check(V.nearest(df, 50).collect(), want)
    check(V.nearest(df, 50, shard_rows=100, block=4).collect(), want)


def test_relaxed_pruning_keeps_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in V.nearest(df, 50).collect()}
    loose = {(r.query_id, r.vec_id) for r in V.nearest(df, 50, factor=1.5, shard_rows=200).collect()}
    assert len(exact & loose) >= 0.9 * len(exact)
    with pytest.raises(ValueError):
        V.nearest(df, 50, factor=0.5)


def test_odd_vectors_ties_and_repeats(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [2.0, 2.0]),
            (10, [1.0, 0.0]), (10, [1.0, 0.0]), (20, [5.0, 5.0, 5.0]), (30, []), (None, [1.0, 1.0]), (40, [float("inf"), 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    plain = [(i, tuple(v) if v else v) for i, v in rows]
    check(V.nearest(df, 10, k=3).collect(), brute(plain, 10, 3))
    assert V.nearest(df.limit(0), 10).count() == 0


def test_a_large_group_of_copies(spark):
    rng = random.Random(2)
    base = [rng.random() for _ in range(4)]
    rows = [(i, base if i % 3 else [rng.random() for _ in range(4)]) for i in range(900)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    plain = [(i, tuple(np.float32(x).item() for x in v)) for i, v in rows]
    check(V.nearest(df, 100, shard_rows=300).collect(), brute(plain, 100, 10))


def test_copies_of_the_queries_are_not_sent_to_the_driver(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(3000)]
    got = V.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA), 10, shard_rows=50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    check(got.collect(), brute([(i, tuple(np.float32(x).item() for x in v)) for i, v in rows], 10, 10))
