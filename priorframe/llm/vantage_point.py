"""Nearest neighbours with a vantage-point tree per shard.

Rows are dealt to shards of about ``shard_rows`` by a hash of their id. A shard's tree splits its rows at the median
distance from a vantage point down to leaves of ``leaf`` rows. Rows and a copy of the stated queries for every shard are
one shuffle without a join: a shard's task builds its tree once and answers the queries in blocks of ``block`` as they
come, so it holds one shard and one batch of queries. A subtree is skipped if the triangle inequality
shows that it lies further away than the k-th best so far: |d(q, v) - median| * factor > worst. Factor one is exact
search; larger factors skip more.

Distances are Euclidean in double precision, the squares added in component order. The search itself adds them in any
order, keeps eight rows more than k, and the exact sums decide among these. Ties go to the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries or as
candidates; vectors whose length is not the query's are no candidates of it; a query is never its own candidate, whose
id it is; repeated ids count once (the smallest vector by component order); fewer candidates than k give fewer rows; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

SHARD_ROWS = 8192
BLOCK = 512
LEAF = 256
SPARE = 8
FACTOR = 1.0
SLACK = 1e-9


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean, each sum taken in component order."""
    total = np.zeros((len(queries), len(rows)))
    for j in range(queries.shape[1]):
        total += (queries[:, j, None] - rows[None, :, j]) ** 2
    return np.sqrt(total)


def quick_distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean within a few units in the last place; equal rows give equal distances."""
    out = np.empty((len(queries), len(rows)))
    for at in range(0, len(queries), 32):
        gap = queries[at : at + 32, None, :] - rows[None, :, :]
        out[at : at + 32] = np.einsum("qrd,qrd->qr", gap, gap)
    return np.sqrt(out)


class VantagePointTree:
    """Rows in leaf order; an inner node is (vantage row, median, near child, far child)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.leaf = ids[order], rows[order], leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        sample = members[:: max(1, len(members) // 16)]
        vantage = sample[int(np.argmax(np.std(quick_distances(self.rows[sample], self.rows[sample]), axis=1)))]
        away = quick_distances(self.rows[vantage : vantage + 1], self.rows[members])[0]
        median = float(np.median(away))
        inside = away <= median
        if inside.all():  # equal distances cannot be split: a larger leaf keeps the search exact
            return members
        return vantage, median, self._build(members[inside]), self._build(members[~inside])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best ``(distance, place in the tree's rows)`` of each query; missing places are infinite."""
        wide = k + SPARE
        best = np.full((len(queries), wide), np.inf)
        places = np.full((len(queries), wide), len(self.ids))

        def visit(node, active: np.ndarray) -> None:
            if not len(active):
                return
            if isinstance(node, np.ndarray):
                away = quick_distances(queries[active], self.rows[node])
                away[query_ids[active][:, None] == self.ids[node][None, :]] = np.inf
                d = np.concatenate([best[active], away], axis=1)
                i = np.concatenate([places[active], np.broadcast_to(node, away.shape)], axis=1)
                i = np.where(np.isinf(d), len(self.ids), i)  # rows are in order of their ids, so places break ties
                order = np.lexsort((i, d), axis=1)[:, :wide]
                best[active], places[active] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
                return
            vantage, median, near, far = node
            gap = quick_distances(queries[active], self.rows[vantage : vantage + 1])[:, 0] - median
            inside = gap <= 0
            visit(near, active[inside])
            visit(far, active[~inside])
            open_ = np.abs(gap) * factor <= best[active, -1] * (1 + SLACK) + SLACK
            visit(far, active[inside & open_])
            visit(near, active[~inside & open_])

        visit(self.root, np.arange(len(queries)))
        for q in range(len(queries)):
            real = np.isfinite(best[q])
            best[q, real] = distances(queries[q : q + 1], self.rows[places[q, real]])[0]
        order = np.lexsort((places, best), axis=1)[:, :k]
        return np.take_along_axis(best, order, 1), np.take_along_axis(places, order, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` in doubles, without the vectors that take no part, one row for each id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where("vec_id is not null and v is not null").where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(
    vectors: DataFrame, every: int, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; queries are the rows whose id is divisible by ``every``."""
    if factor < 1:
        raise ValueError("the factor is at least one")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vptree")
    rows = scratch.save(usable(vectors, id_col, vector_col), "rows")
    n_shards = max(1, -(-rows.count() // shard_rows))
    deal = F.pmod(F.xxhash64("vec_id", F.lit("shard")), F.lit(n_shards)).cast("int")
    held = rows.select(deal.alias("shard"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "vec_id", "v")
    # each query is replicated to every shard: the stated queries against all rows. A join would send the copies to the driver,
    # as the planner does not see that they are many
    copies = F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))
    asked = rows.where(F.col("vec_id") % every == 0).select(copies.alias("shard"), F.size("v").alias("dim"), F.lit(1).alias("kind"), "vec_id", "v")
    dealt = held.unionByName(asked).repartition(max(8, n_shards), "shard").sortWithinPartitions("shard", "dim", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip([0, *ends], ends):
                if end == start:
                    continue
                shard, dim, kind = keys[start].tolist()
                if (shard, dim) != key:
                    key, parts, tree = (shard, dim), [], None
                ids = batch.column(3).slice(start, end - start).to_numpy()
                v = batch.column(4).slice(start, end - start).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if kind == 0:
                    parts.append((ids, v))
                    continue
                if tree is None and parts:
                    tree, parts = VantagePointTree(*(np.concatenate(p) for p in zip(*parts))), []
                for at in range(0, len(ids) if tree is not None else 0, block):
                    names = ids[at : at + block]
                    best, found = tree.search(names, v[at : at + block], k, factor)
                    real = np.isfinite(best)
                    columns = np.repeat(names, real.sum(1)), tree.ids[found[real]], best[real]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    hits = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
