"""Benchmark decontamination by greedy string tiling.

Texts are words (``\\w+``, lower case). A document and a benchmark item that share a seed, five words in a row, are a
candidate pair. The item is tiled with pieces of the document: running Karp-Rabin finds the longest matches of words not
yet used, marks them, and goes on with shorter ones down to the seed length. The share of the item's words under tiles is
its coverage, whatever the order of the tiles, so reordered passages count too. Pairs of coverage 0.8 or more are leaks.

Seeds are joined in one of two ways with equal results: a benchmark of at most ``broadcast_words`` words goes to every
task, so documents are read once and not shuffled; a larger one is joined by seed hashes in a shuffle.

Defined cases: null and empty texts have no words and leak nothing; items of fewer words than a seed have no tile and
are never leaked; repeated documents each get their rows; repeated items of one id are tiled each on its own, and the
best coverage counts; null ids take part under a null id; empty tables give an empty result; further columns are ignored
or, by :func:`remove_leaks`, kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

SEED_WORDS = 5
COVERAGE = 0.8
BROADCAST_WORDS = 2_000_000
FIRST_LENGTH = 20
BASE, MODULUS = 1_000_003, (1 << 61) - 1
WORD = re.compile(r"\w+")
ROWS = "doc_id long, item_id long, coverage double, covered_words long, item_words long, n_tiles long, longest_tile long"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _stretches(free: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of true values of at least this length, as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


def _window_hashes(seq: list[int], stretches: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int]]:
    """``(hash, start)`` of each window of this length inside the stretches, rolled by one word at a time."""
    top = pow(BASE, length - 1, MODULUS)
    for a, b in stretches:
        h = 0
        for x in seq[a : a + length]:
            h = (h * BASE + x) % MODULUS
        yield h, a
        for i in range(a + 1, b - length + 1):
            h = ((h - seq[i - 1] * top) * BASE + seq[i + length - 1]) % MODULUS
            yield h, i


def tile(item: list[int], text: list[int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(length, item start, text start)``. Word numbers are positive; zero in text never matches.

    The longest match of free words is marked first, ties by their places, until none of ``least`` words is left. Every free
    match of a pass is part of one found at its start, so a queue of these and of what is left of them is complete.
    """
    free_item, free_text = np.ones(len(item), bool), np.array(text, np.int64) > 0
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(FIRST_LENGTH, len(item), len(text)))
    while True:
        table: dict[int, list[int]] = {}
        for h, i in _window_hashes(item, _stretches(free_item, length), length):
            table.setdefault(h, []).append(i)
        found: list[tuple[int, int, int]] = []
        longest = 0
        reach: dict[int, int] = {}  # where the latest match of a diagonal ends; each diagonal's run is walked once
        for h, j in _window_hashes(text, _stretches(free_text, length), length):
            for i in table.get(h, ()):
                if j < reach.get(j - i, 0):
                    continue
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_item[i + n] and free_text[j + n]:
                    n += 1
                reach[j - i] = j + n
                if n >= length:
                    found.append((n, i, j))
                    longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        queue = [(-n, i, j) for n, i, j in found]
        heapq.heapify(queue)
        while queue:
            n, i, j = heapq.heappop(queue)
            free = free_item[i : i - n] & free_text[j : j - n]
            if free.all():
                free_item[i : i - n] = False
                free_text[j : j - n] = False
                tiles.append((-n, i, j))
                continue
            # what longer tiles have left of it comes up again at its own length
            for x, y in _stretches(free, length):
                heapq.heappush(queue, (x - y, i + x, j + x))
        if length == least:
            return tiles
        length = max(least, length // 2)


@dataclass
class Benchmark:
    """A bounded benchmark: its items as word numbers and a sorted table of seed hashes."""

    items: list[tuple[int | None, list[int]]]
    vocabulary: dict[str, int]
    seeds: np.ndarray
    owners: np.ndarray
    marks: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int | None, str | None]]) -> Benchmark:
        vocabulary: dict[str, int] = {}
        items = [(k, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)]) for k, t in rows]
        marks = np.array([0, *(xxhash.xxh64_intdigest(w, 1) for w in vocabulary)], np.uint64)
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for at, (_, seq) in enumerate(items):
            h = np.unique(seed_hashes(np.array(seq, np.int64), marks)[0])
            hashes.append(h)
            owners.append(np.full(len(h), at))
        seeds, owned = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(seeds, kind="stable")
        return cls(items, vocabulary, seeds[order], owned[order], marks)

    def leaks(self, text: str | None, coverage: float) -> list[tuple]:
        """``(item id, coverage, covered, words, tiles, longest)`` of the items that this text covers."""
        if not len(self.seeds):
            return []
        get = self.vocabulary.get
        numbers = np.array([get(w, 0) for w in words_of(text)], np.int64)
        hashes, starts = seed_hashes(numbers, self.marks)
        if not len(hashes):
            return []
        low, high = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        hit = np.flatnonzero(high > low)
        at: dict[int, list[int]] = {}
        for h in hit.tolist():
            for owner in self.owners[low[h] : high[h]].tolist():
                at.setdefault(owner, []).append(starts[h])
        best: dict[int | None, tuple] = {}
        for owner, places in at.items():
            name, item = self.items[owner]
            result = measure(item, numbers, np.array(places))
            if result[0] >= coverage and (name not in best or result > best[name]):
                best[name] = result
        return [(name, *result) for name, result in best.items()]


def seed_hashes(numbers: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of all windows of SEED_WORDS known words."""
    n = len(numbers) - SEED_WORDS + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known = np.concatenate(([0], np.cumsum(numbers > 0)))
    starts = np.flatnonzero(known[SEED_WORDS:] - known[:-SEED_WORDS] == SEED_WORDS)
    h, of = np.zeros(len(starts), np.uint64), marks[numbers]
    for k in range(SEED_WORDS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + of[starts + k]
    return h, starts


def measure(item: list[int], numbers: np.ndarray, places: np.ndarray) -> tuple[float, int, int, int, int]:
    """Tile an item with the stretches of a text where seeds were found; other words lie in no tile anyway."""
    covered = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(covered, places, 1)
    np.add.at(covered, places + SEED_WORDS, -1)
    inside = np.cumsum(covered)[:-1] > 0
    parts: list[int] = []
    for a, b in _stretches(inside, SEED_WORDS):
        parts += [*numbers[a:b].tolist(), 0]
    tiles = tile(item, parts)
    total = sum(t[0] for t in tiles)
    return total / len(item), total, len(item), len(tiles), max((t[0] for t in tiles), default=0)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "item_id", "coverage", "covered_words", "item_words", "n_tiles", "longest_tile")
    arrays = [pa.array([r[k] for r in rows], pa.float64() if n == "coverage" else pa.int64()) for k, n in enumerate(names)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def _by_broadcast(docs: DataFrame, items: list, coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Benchmark.build(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            yield _record([(k, *r) for k, t in zip(ids, texts) for r in shared.value.leaks(t.as_py(), coverage)])

    return docs.mapInArrow(run, ROWS)


def _by_shuffle(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words_of(text.as_py())
                grams = {xxhash.xxh64_intdigest(" ".join(w[i : i + SEED_WORDS])) for i in range(len(w) - SEED_WORDS + 1)}
                rows += [(key, np.uint64(h).astype(np.int64)) for h in grams]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["key", "seed"]
            )

    keyed_docs = docs.withColumn("text_key", F.xxhash64("text"))
    texts = keyed_docs.select("text_key", "text").dropDuplicates(["text_key"])
    keyed_items = items.withColumn("item_key", F.xxhash64("text"))
    left = texts.mapInArrow(seeds, "key long, seed long")
    right = keyed_items.select("item_key", "text").dropDuplicates(["item_key"]).mapInArrow(seeds, "key long, seed long")
    pairs = left.withColumnRenamed("key", "text_key").join(right.withColumnRenamed("key", "item_key"), "seed")
    pairs = pairs.select("text_key", "item_key").distinct()
    full = pairs.join(texts, "text_key").join(keyed_items.withColumnRenamed("text", "item_text"), "item_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, item, item_text in zip(*(batch.column(k) for k in range(4))):
                build = Benchmark.build([(item.as_py(), item_text.as_py())])
                rows += [(key.as_py(), *r) for r in build.leaks(text.as_py(), coverage)]
            yield _record(rows)

    found = full.select("text_key", "text", "item_id", "item_text").mapInArrow(run, ROWS).withColumnRenamed("doc_id", "text_key")
    best = F.max(F.struct("coverage", "covered_words", "item_words", "n_tiles", "longest_tile")).alias("best")
    best_rows = found.groupBy("text_key", "item_id").agg(best).select("text_key", "item_id", "best.*")
    # each row of docs gets the rows of its text
    return keyed_docs.select("doc_id", "text_key").join(best_rows, "text_key").drop("text_key")


def _bounded_items(benchmark: DataFrame, item_col: str, item_text_col: str, broadcast_words: int) -> tuple[DataFrame, list | None]:
    """``(item_id, text)``, and its rows if they are few enough to go to every task."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.where("text is not null")
    # a word has at least one character beside its separator, so this bounds the words
    bound = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    return items, [tuple(r) for r in items.collect()] if bound <= broadcast_words else None


def leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """One row for each document and benchmark item that it covers: coverage, covered and all words, tiles."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items, listed = _bounded_items(benchmark, item_col, item_text_col, broadcast_words)
    return _by_shuffle(rows, items, coverage) if listed is None else _by_broadcast(rows, listed, coverage)


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """docs without the rows whose text covers a benchmark item; all columns are kept."""
    items, listed = _bounded_items(benchmark, item_col, item_text_col, broadcast_words)
    if listed is not None:
        shared = docs.sparkSession.sparkContext.broadcast(Benchmark.build(listed))

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not shared.value.leaks(t, coverage) for t in texts], dtype=bool)

        return docs.where(clean(F.col(text_col).cast("string")))
    keyed = docs.withColumn("__text_key", F.xxhash64(F.col(text_col)))
    rows = keyed.select(F.col("__text_key").alias("doc_id"), F.col(text_col).alias("text")).dropDuplicates(["doc_id"])
    found = Scratch(docs.sparkSession, "leaks").save(_by_shuffle(rows, items, coverage), "found")
    return keyed.join(found.select(F.col("doc_id").alias("__text_key")).distinct(), "__text_key", "left_anti").drop("__text_key")
