"""Hard negatives by inner product, searched in a cover tree per shard.

Candidates are lifted to a sphere, (x, sqrt(M^2 - |x|^2)) with M the longest norm, where the nearest to an anchor is the
one of largest inner product. A cover tree's level has balls of half the squared radius of the level above; a ball
bounds the inner products of all rows inside: q.p - |q| r <= q.x <= q.p + |q| r, and on the sphere also by the distance
of q to the ball. The search descends best first, a block of queries at a time. It leaves out a node for a query
whose window (lowest and highest score wanted, or the k-th best so far) lies outside of the node's bounds, and tests the
rows of leaves by their exact products.

Two searches are run: an anchor's positives (same label), then for every positive its window of scores among the rows of
other labels. Rows are dealt to shards of about ``shard_rows``; a task builds a shard's tree and then reads the queries
one batch after the other, so that it holds one shard and one batch. Queries, a stated share of the rows, are copied to
every shard; candidates move once a search. Both searches rank in Spark what the shards found, k rows a shard at most.

Components are floor(scale * x), so products are integers. They are exact in double precision up to 2^52; a shard
with longer vectors is searched in Python's integers instead, where a window's ends are rounded to doubles and scores
beyond a long are shown as its ends.

Defined cases: rows with a null id, label or vector, or with null or non-finite components, take no part; vectors of
other lengths never meet; an empty vector has the product zero; repeated ids are rows of their own, in the order of
score, id and then place in the table; anchors with no positive, and positives with no negative, give no rows; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

SHARD_ROWS = 16_384
LEAF = 128
PICKS = 16
BLOCK = 1024
BASE = 2**0.5
EXACT = float(1 << 52)
LONG = (1 << 63) - 1
HITS = "query long, slot int, row long, vec_id long, score long"


class CoverTree:
    """Rows (integers as doubles) with their ids, row numbers and labels, under balls that shrink from level to level."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray, labels: np.ndarray, leaf: int = LEAF):
        self.rows, self.ids, self.numbers, self.labels, self.leaf = rows, ids, numbers, labels, leaf
        norm = (rows * rows).sum(1)
        self.top = float(norm.max(initial=0.0))
        self.lift = np.sqrt(np.maximum(self.top - norm, 0.0))
        members = np.arange(len(rows))
        away = self._away(0, members) if len(rows) else np.zeros(0)
        self.root = self._build(0, members, away)

    def _away(self, centre: int, members: np.ndarray) -> np.ndarray:
        gap = self.rows[members] - self.rows[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.lift[members] - self.lift[centre]) ** 2)

    def _build(self, centre: int, members: np.ndarray, away: np.ndarray) -> tuple:
        """``(centre, radius, children or None, members)``."""
        radius = float(away.max(initial=0.0))
        if len(members) <= self.leaf or radius == 0.0:
            return centre, radius, None, members
        children, left, distance = [], members, away
        for _ in range(max(2, len(members) // PICKS)):
            pick = centre if not children else int(left[0])
            distance = away if not children else self._away(pick, left)
            inside = distance <= radius / BASE
            children.append(self._build(pick, left[inside], distance[inside]))
            left = left[~inside]
            if not len(left):
                break
        if len(left):  # rows that few balls cover have no nearer company: they stay together under their own radius
            pick = int(left[0])
            children.append((pick, float(self._away(pick, left).max()), None, left))
        return centre, radius, children, members

    def search(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, allowed, k: int) -> tuple[np.ndarray, ...]:
        """The k best rows of each query with low <= score <= high: (query, row, score), best first.

        ``allowed(queries, rows)`` says which of these pairs count. Ties go to the smaller id, then row number.
        """
        norm2 = (queries * queries).sum(1)
        norm, floor = np.sqrt(norm2), low.copy()
        slack = 1e-9 * (norm2 + self.top) + 1e-6
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def bounds(active: np.ndarray, nodes: list) -> tuple[np.ndarray, np.ndarray]:
            score = queries[active] @ self.rows[[n[0] for n in nodes]].T
            r, q2 = np.array([n[1] for n in nodes]), norm2[active, None] + self.top
            away, reach = np.sqrt(np.maximum(q2 - 2 * score, 0.0)), norm[active, None] * r
            upper = np.minimum(score + reach, (q2 - np.maximum(away - r, 0.0) ** 2) / 2)
            lower = np.maximum(score - reach, (q2 - (away + r) ** 2) / 2)
            return upper + slack[active, None], lower - slack[active, None]

        heap, count = [], 0

        def push(active: np.ndarray, nodes: list) -> None:
            nonlocal count
            upper, lower = bounds(active, nodes)
            open_ = (upper >= floor[active, None]) & (lower <= high[active, None])
            for j, node in enumerate(nodes):
                mine = open_[:, j]
                if mine.any():
                    best = np.minimum(upper[mine, j], high[active[mine]])
                    heapq.heappush(heap, (-float(best.max()), count, node, active[mine], upper[mine, j]))
                    count += 1

        if len(self.rows) and len(queries):
            push(np.arange(len(queries)), [self.root])
        while heap:
            _, _, node, active, upper = heapq.heappop(heap)
            active = active[upper >= floor[active]]
            if not len(active):
                continue
            if node[2] is not None:
                push(active, node[2])
                continue
            for at in range(0, len(node[3]), 1024):
                members = node[3][at : at + 1024]
                score = queries[active] @ self.rows[members].T
                i, j = np.nonzero((score >= floor[active, None]) & (score <= high[active, None]))
                q, m = active[i], members[j]
                ok = allowed(q, m)
                q, m, s = q[ok], m[ok], score[i[ok], j[ok]]
                if not len(q):
                    continue
                # the touched queries' lists with the new rows, cut to k
                touched = np.zeros(len(queries), bool)
                touched[q] = True
                old = touched[found[0]]
                q, m, s = (np.concatenate((f[old], n)) for f, n in zip(found, (q, m, s)))
                order = np.lexsort((self.numbers[m], self.ids[m], -s, q))
                q, m, s = q[order], m[order], s[order]
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                full = place == k - 1
                floor[q[full]] = np.maximum(low[q[full]], s[full])
                keep = place < k
                found = tuple(np.concatenate((f[~old], n[keep])) for f, n in zip(found, (q, m, s)))
        order = np.lexsort((self.numbers[found[1]], self.ids[found[1]], -found[2], found[0]))
        return tuple(f[order] for f in found)


def exact_search(tree: CoverTree, queries: np.ndarray, low: np.ndarray, high: np.ndarray, allowed, k: int) -> tuple:
    """The same result from Python's integers, for products that doubles do not hold."""
    whole = [[int(x) for x in row] for row in tree.rows]
    out: list[tuple[int, int, int]] = []
    for q, query in enumerate(queries):
        ints = [int(x) for x in query]
        pairs = np.flatnonzero(allowed(np.full(len(whole), q), np.arange(len(whole)))).tolist()
        scores = ((sum(a * b for a, b in zip(ints, whole[m])), m) for m in pairs)
        ranked = sorted((-s, int(tree.ids[m]), int(tree.numbers[m]), m) for s, m in scores if low[q] <= s <= high[q])
        out += [(q, m, -s) for s, _, _, m in ranked[:k]]
    return [r[0] for r in out], [r[1] for r in out], [r[2] for r in out]


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part, components floor(scale * x)."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(F.forall("v", finite))
    # from 2^52 on a double has no fraction
    whole = lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return rows.withColumn("v", F.transform("v", whole))


def _vectors(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _search(rows: DataFrame, queries: DataFrame, n_shards: int, k: int, same: bool) -> DataFrame:
    """``(query, slot, row, vec_id, score)``: the k best of every shard for each of a query's windows."""
    deal = F.pmod(F.xxhash64("row"), F.lit(n_shards)).cast("int")
    none = F.lit(None).cast("array<double>")
    held = rows.select(deal.alias("shard"), F.size("v").alias("dim"), F.lit(0).alias("kind"), "row", "vec_id", "label", "v", none.alias("low"), none.alias("high"))
    asked = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.size("v").alias("dim"), F.lit(1).alias("kind"), "row", "vec_id", "label", "v", "low", "high"
    )
    dealt = held.unionByName(asked).repartition(max(8, n_shards), "shard").sortWithinPartitions("shard", "dim", "kind", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            start = 0
            for end in ends:
                if end == start:
                    continue
                shard, dim, kind = keys[start].tolist()
                part = batch.slice(start, end - start)
                start = end
                if (shard, dim) != key:
                    key, parts, tree = (shard, dim), [], None
                if kind == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if tree is None:
                    column = lambda c: np.concatenate([p.column(c).to_numpy() for p in parts])  # noqa: B023, E731
                    tree = CoverTree(np.concatenate([_vectors(p.column(6), dim) for p in parts]), column(4), column(3), column(5))
                for at in range(0, len(part), BLOCK):
                    yield _answer(tree, part.slice(at, BLOCK), dim, k, same)

    return dealt.mapInArrow(run, HITS)


def _answer(tree: CoverTree, part: pa.RecordBatch, dim: int, k: int, same: bool) -> pa.RecordBatch:
    numbers, labels = part.column(3).to_numpy(), part.column(5).to_numpy()
    vectors = _vectors(part.column(6), dim)
    sizes = part.column(7).value_lengths().to_numpy()
    owner = np.repeat(np.arange(len(part)), sizes)
    slot = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    low, high = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (7, 8))
    own, label = numbers[owner], labels[owner]

    def allowed(q: np.ndarray, m: np.ndarray) -> np.ndarray:
        return ((label[q] == tree.labels[m]) == same) & (own[q] != tree.numbers[m])

    largest = max(float(np.abs(vectors).max(initial=0.0)), float(np.abs(tree.rows).max(initial=0.0)))
    find = tree.search if largest * largest * max(dim, 1) < EXACT else lambda *a: exact_search(tree, *a)
    q, m, score = find(vectors[owner], low, high, allowed, k)
    q, m = np.asarray(q, np.int64), np.asarray(m, np.int64)
    score = [max(-LONG - 1, min(LONG, int(s))) for s in score] if isinstance(score, list) else score.astype(np.int64)
    arrays = [numbers[owner[q]], slot[q].astype(np.int32), tree.numbers[m], tree.ids[m], score]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays[:4]] + [pa.array(score, pa.int64())], names=["query", "slot", "row", "vec_id", "score"])


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low_share: int = 80, high_share: int = 100,
    scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` in the order of score, then id.

    Anchors are the rows whose id is divisible by ``every``; a negative's score n and the positive's p satisfy
    low_share * p <= 100 * n <= high_share * p.
    """
    scratch = Scratch(vectors.sparkSession, "hardneg")
    rows = usable(vectors, id_col, vector_col, label_col, scale).withColumn("row", F.monotonically_increasing_id())
    rows = scratch.save(rows, "rows")  # the row numbers are facts from here on
    n_shards = max(1, -(-rows.count() // shard_rows))
    anchors = rows.where(F.col("vec_id") % every == 0)
    whole = anchors.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    best = _best(_search(rows, whole, n_shards, positives, same=True), positives)
    best = scratch.save(best.select("query", F.col("vec_id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score")), "positives")
    # equal scores of one anchor ask for the same window once
    score = F.col("positive_score")
    ends = best.where(score >= 0).select("query", "positive_score").distinct()
    exact = lambda share, up: (F.ceil if up else F.floor)(score.cast("decimal(38,0)") * share / 100).cast("double")
    windows = ends.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(score, exact(low_share, True).alias("low"), exact(high_share, False).alias("high")))).alias("w"))
    windows = scratch.save(windows, "windows")
    asked = anchors.join(windows, F.col("row") == F.col("query")).select("row", "vec_id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    hits = _best(_search(rows, asked, n_shards, negatives, same=False), negatives)
    named = windows.select("query", F.posexplode("w").alias("slot", "s")).select("query", "slot", F.col("s.positive_score").alias("positive_score"))
    taken = hits.select("query", "slot", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = taken.join(named, ["query", "slot"]).join(best, ["query", "positive_score"]).join(anchors.select(F.col("row").alias("query"), F.col("vec_id").alias("anchor_id")), "query")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabel(vectors: DataFrame, every: int = 7, classes: int = 10, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """The vectors, the label of every so many ids moved to the next class."""
    moved = F.when(F.col(id_col) % every == 0, (F.col(label_col) + 1) % classes).otherwise(F.col(label_col))
    return vectors.withColumn(label_col, moved)
