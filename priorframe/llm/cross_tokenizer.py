"""Alignment of two tokenizers' tokens over the same bytes, by interval coalescing, with corpus-wide link counts.

Every text is encoded by a byte-level BPE (A) and a sentence-piece model (B). The tokens of a group of texts, A and B
together, are sorted by their first byte (``lexsort``); where a start reaches the running maximum of the ends
(``maximum.accumulate``) a group ends, and so exactly where tokens of both sides end. Within groups overlapping byte
ranges are expanded to links.

A pair of ids counts once for each document that holds it linked. Texts are encoded once, in one pass that moves no rows:
it writes each document's distinct pairs and, for every chunk of about ``CHUNK_BYTES`` of text, one row with the chunk's
pairs and their numbers of documents. Only these chunk rows are summed up over the corpus; a chunk then gets back
the counts of its own pairs, and they meet its documents in one task. What a task holds is bounded by a chunk (or one
text, if that is longer). The best count of each A id is broadcast: it has at most as many rows as A has ids.

Defined cases: a text that is null, empty, not UTF-8, or whose joined A or B bytes differ from space+text (for example
where B's normalisation changes it) has no tokens: zeros and an empty digest; special tokens' strings are plain text;
every row is a document, repeated ids too; a null id stays null; an empty table gives an empty result; further columns
are ignored. Texts are whole at any length: for B, texts above a million characters are cut before a space that follows
another character, where no piece of the vocabulary goes on (if one did, they would not be cut).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import GROUP_CHARS, BytePairCodec, ragged
from .scratch import Scratch

CHUNK_BYTES = 8 << 20
GROUPS = "array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>"
ENCODED = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "own_pairs binary, own_times binary, pairs array<long>, docs array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PieceCodec:
    """A sentence-piece model: ids and the bytes that they stand for."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        # a byte piece is written <0xHH>
        raw = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.blob = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_sizes = np.array([len(t) for t in raw], np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.may_cut = not any(regex.search("[^▁]▁", p) for p in pieces)
        self.word_end = regex.compile(r"(?s)(?<=[^ ▁]) (?=.)")  # an empty part would lose its space

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of about GROUP_CHARS; the model puts back the space that a later part starts with."""
        at = 0
        while self.may_cut and len(text) - at > GROUP_CHARS and (m := self.word_end.search(text, at + GROUP_CHARS)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def encode_group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more than there are texts)."""
        listed = [list(self._parts(t)) for t in texts]
        ids = self.model.encode([p for parts in listed for p in parts], num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((k for part in ids for k in part), np.int64, int(sizes.sum()))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return flat, ends[np.concatenate(([0], np.cumsum([len(p) for p in listed])))]


class Pair:
    """The two codecs, and decimal texts of all ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = BytePairCodec(path_a), PieceCodec(path_b)
        self.a.special = {}  # special tokens' strings are plain text here
        self.width = len(self.b.byte_sizes)
        shown = [f"{k},".encode() for k in range(max(len(self.a.byte_sizes), self.width))]
        self.shown, self.shown_sizes = np.frombuffer(b"".join(shown), np.uint8), np.array([*map(len, shown)], np.int64)
        self.shown_starts = np.cumsum(self.shown_sizes) - self.shown_sizes


@lru_cache(2)
def pair_of(path_a: str, path_b: str) -> Pair:
    """One pair of codecs for each Python worker, which tasks reuse."""
    return Pair(path_a, path_b)


def _agree(codec, ids: np.ndarray, offsets: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each text's tokens are the text."""
    sizes = codec.byte_sizes[ids]
    raw = codec.blob[ragged(codec.byte_starts[ids], sizes)].tobytes()
    ends = np.concatenate(([0], np.cumsum(sizes)))[offsets].tolist()
    return np.array([raw[a:b] == t for a, b, t in zip(ends[:-1], ends[1:], texts)], bool)


@dataclass
class Tokens:
    """One side's tokens over the joined texts: ids, byte ranges, text and group of each."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    group: np.ndarray


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval; a group breaks where a start reaches the running maximum of the ends before it."""
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    breaks = np.concatenate(([0], (starts[order][1:] >= reached[:-1]).astype(np.int64))) if len(order) else np.zeros(0, np.int64)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in a, place in b) whose byte ranges overlap: in each A token's group, the run of B tokens it meets."""
    first, last = np.searchsorted(b.ends, a.starts, "right"), np.searchsorted(b.starts, a.ends, "left")
    sizes = last - first
    return np.repeat(np.arange(len(sizes)), sizes), ragged(first, sizes)


def tokens_of(pair: Pair, texts: list[bytes | None]) -> tuple[Tokens, Tokens, np.ndarray]:
    """Both sides' tokens of the texts that have any, and whether each text has."""
    strings: list[str] = []
    for t in texts:
        try:
            strings.append((t or b"").decode())
        except UnicodeDecodeError:
            strings.append("")
    there = np.array([bool(s) for s in strings], bool)
    raw = [b" " + s.encode() if s else b"" for s in strings]
    found = [pair.a.encode_group([" " + s if s else "" for s in strings]), pair.b.encode_group(strings)]
    for codec, (ids, offsets) in zip((pair.a, pair.b), found):
        there &= _agree(codec, ids, offsets, raw)
    sides = []
    for codec, (ids, offsets) in zip((pair.a, pair.b), found):
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        kept = there[owner]
        ids, owner = ids[kept].astype(np.int64), owner[kept]
        ends = np.cumsum(codec.byte_sizes[ids])
        sides.append(Tokens(ids, ends - codec.byte_sizes[ids], ends, owner, np.zeros(0, np.int64)))
    a, b = sides
    group = coalesce(np.concatenate((a.starts, b.starts)), np.concatenate((a.ends, b.ends)))
    a.group, b.group = group[: len(a.ids)], group[len(a.ids) :]
    return a, b, there


def digests(pair: Pair, a: Tokens, b: Tokens, n: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each of n texts; empty for one without tokens."""
    place_a = np.arange(len(a.ids)) + np.searchsorted(b.group, a.group, "left")
    place_b = np.arange(len(b.ids)) + np.searchsorted(a.group, b.group, "right")
    ids, last = np.empty(len(a.ids) + len(b.ids), np.int64), np.full(len(a.ids) + len(b.ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a.ids, b.ids
    for t, place, mark in ((a, place_a, "|"), (b, place_b, ";")):
        last[place[np.append(t.group[1:] != t.group[:-1], True)[: len(place)]]] = ord(mark)
    sizes = pair.shown_sizes[ids]
    raw = pair.shown[ragged(pair.shown_starts[ids], sizes)]
    ends = np.cumsum(sizes)
    raw[ends - 1] = last
    raw = raw.tobytes()
    counts = np.bincount(a.owner, minlength=n) + np.bincount(b.owner, minlength=n)
    cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(cuts[:-1], cuts[1:])]


def _groups(column: pa.Array) -> Iterator[list[bytes | None]]:
    """A binary column in lists of about GROUP_CHARS bytes."""
    group, size = [], 0
    for t in column:
        group.append(t.as_py())
        size += len(group[-1] or b"")
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    keys, numbers = (np.concatenate([p[k] for p in parts]) for k in range(2))
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, numbers, len(distinct)).astype(np.int64)


def encode_pairs(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each document with its distinct pairs, and one for each chunk of documents with the pairs' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, schema = pair_of(path_a, path_b), _arrow_schema()
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0

        def closed() -> pa.RecordBatch:
            keys, numbers = _sum_up(held)
            row = {"chunk": chunk, "pairs": keys, "docs": numbers}
            return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)

        for batch in batches:
            at = 0
            for texts in _groups(batch.column(1)):
                n = len(texts)
                a, b, _ = tokens_of(pair, texts)
                i, j = overlaps(a, b)
                # distinct pairs of each document and how often each is linked
                space = len(pair.a.byte_sizes) * pair.width
                key, times = np.unique(a.owner[i] * space + a.ids[i] * pair.width + b.ids[j], return_counts=True)
                owner, key = key // space, key % space
                held.append(np.unique(key, return_counts=True))
                cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
                count = lambda t: pa.array(np.bincount(t.owner, minlength=n))  # noqa: B023, E731
                groups = np.bincount(a.owner[np.append(a.group[1:] != a.group[:-1], True)[: len(a.ids)]], minlength=n)
                column = lambda v: pa.array([v[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())  # noqa: B023, E731
                links = np.bincount(a.owner[i], minlength=n)
                arrays = [pa.array(np.full(n, chunk)), batch.column(0).slice(at, n), count(a), count(b), pa.array(groups), pa.array(links), pa.array(digests(pair, a, b, n))]
                arrays += [column(key.astype("<u8" if space >> 32 else "<u4")), column(times.astype("<u4")), pa.nulls(n, schema.field("pairs").type), pa.nulls(n, schema.field("docs").type)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
                at += n
                size += sum(len(t or b"") for t in texts)
                if size >= chunk_bytes:
                    yield closed()
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in ENCODED.split(", "))])


def _counts(encoded: DataFrame, width: int) -> DataFrame:
    """``(pair, n, best)`` over the corpus: in how many documents, and whether no pair of the same A id is in more."""
    listed = encoded.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("z"))
    counts = listed.groupBy(F.col("z.pairs").alias("pair")).agg(F.sum("z.docs").alias("n")).withColumn("a", F.floor(F.col("pair") / width))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def token_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus' table of linked ids: ``(a_id, b_id, n_docs, best)``."""
    width = PieceCodec(path_b).model.get_piece_size()
    scratch = Scratch(docs.sparkSession, "links")
    counts = scratch.save(_counts(scratch.save(encode_pairs(docs, path_a, path_b, id_col, text_col), "encoded"), width), "counts")
    return counts.select(F.floor(F.col("pair") / width).alias("a_id"), (F.col("pair") % width).alias("b_id"), F.col("n").alias("n_docs"), "best")


def align(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for each row of docs."""
    model = PieceCodec(path_b)
    width = model.model.get_piece_size()
    scratch = Scratch(docs.sparkSession, "alignment")
    encoded = scratch.save(encode_pairs(docs, path_a, path_b, id_col, text_col, chunk_bytes), "encoded")
    counts = scratch.save(_counts(encoded, width), "counts")
    # each chunk's own pairs come back with their counts: as many rows as a chunk has distinct pairs
    own = encoded.where("pairs is not null").select("chunk", F.explode("pairs").alias("pair")).join(counts, "pair")
    packed = own.groupBy(F.col("chunk").alias("of")).agg(F.sort_array(F.collect_list(F.struct("pair", "n", "best"))).alias("m"))
    packed = packed.select("of", F.col("m.pair").alias("pair"), F.col("m.n").alias("n"), F.col("m.best").cast("array<bigint>").alias("best"))
    texts = encoded.where("pairs is null").drop("pairs", "docs")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        raw = [left.column(c).combine_chunks() for c in ("own_pairs", "own_times")]
        sizes = np.array([len(v) // 4 for v in raw[1].to_pylist()], np.int64)
        pairs, times = (b"".join(v.to_pylist()) for v in raw)
        pairs = np.frombuffer(pairs, "<u8" if len(pairs) > len(times) else "<u4").astype(np.int64)
        times = np.frombuffer(times, "<u4").astype(np.int64)
        known, n, best = (right.column(c).combine_chunks().flatten().to_numpy() for c in ("pair", "n", "best"))
        at = np.searchsorted(known, pairs)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        total = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[ends])
        out = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(total(times * best[at]))).append_column("count_sum", pa.array(total(times * n[at])))
        return out.append_column("groups_sha256", left.column("groups_sha256"))

    return texts.groupBy("chunk").cogroup(packed.groupBy("of")).applyInArrow(score, RESULT)


def with_groups(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", groups_col: str = "groups") -> DataFrame:
    """docs with the aligned groups of each text: byte range (of space+text) and both sides' ids; a column of this name is replaced."""
    kept = docs.drop(groups_col)
    names, place = kept.columns, kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        ids = pa.list_(pa.int32())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", ids), ("b", ids)]))
        for batch in batches:
            at = 0
            for texts in _groups(batch.column(place).cast(pa.binary())):
                a, b, _ = tokens_of(pair, texts)
                first = np.flatnonzero(np.append(True, a.group[1:] != a.group[:-1])[: len(a.ids)])
                edges = [np.append(np.flatnonzero(np.append(True, t.group[1:] != t.group[:-1])[: len(t.ids)]), len(t.ids)) for t in (a, b)]
                ends = a.ends[edges[0][1:] - 1]
                lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(t.ids.astype(np.int32))) for e, t in zip(edges, (a, b))]
                owner = a.owner[first]
                base = np.zeros(len(texts), np.int64)
                base[owner[::-1]] = a.starts[first][::-1]  # the first group of each text
                rows = pa.StructArray.from_arrays([pa.array(a.starts[first] - base[owner]), pa.array(ends - base[owner]), *lists], fields=list(kind.value_type))
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(cuts), rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(texts)) for k in range(len(names))), found], names=[*names, groups_col])
                at += len(texts)

    schema = kept.limit(0).selectExpr("*", f"cast(null as {GROUPS}) as `{groups_col}`").schema
    return kept.mapInArrow(run, schema)
