"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint is the bitwise majority of the 64-bit hashes of its word shingles. Documents are linked if
their fingerprints differ in at most three bits, and every document gets the smallest id it can reach.

The search uses anchors of a covering code. Of two fingerprints at distance three or less, one 32-bit half differs in
at most one bit. On a half the anchors are the words of the [31,26] Hamming code beside a free bit: a code of covering
radius one, so each half has one home anchor at distance one or less. A half is replicated to every anchor within
covering radius plus threshold, that is two; there are at most 17. Whoever is within one bit of a half therefore
stands in that half's home anchor, where the two are compared on all 64 bits.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; fewer words than a shingle give one
shingle of all; repeated rows get equal results; a null doc_id takes part but is never a component's name unless all ids
of the component are null; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import link_buckets
from .scratch import Scratch

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 3
SHINGLE = 3
SEED = 42
BLOCK = 1 << 15


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit majority of the shingles' XXH64; zero without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends))[: len(words) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        part = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        ones = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += ones.sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, mark)``: the fingerprint as a signed long, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], names=["doc_id", "mark"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long")


def replication_masks() -> list[tuple[int, int, bool]]:
    """``(syndrome, mask, home)``: what to flip in a half of that syndrome to reach each anchor within two bits."""
    masks = []
    for s in range(32):
        home = 1 << (s - 1) if s else 0
        masks += [(s, home, True), (s, home | 1 << 31, False)]
        masks += [(s, 1 << (j - 1) | 1 << ((j ^ s) - 1), False) for j in range(1, 32) if s and j < j ^ s]
    return masks


def _syndrome(half: Column) -> Column:
    checks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    bits = [F.bit_count(half.bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)) * (1 << k) for k, m in enumerate(checks)]
    return sum(bits[1:], bits[0])


def anchors(marks: DataFrame) -> DataFrame:
    """``marks(mark)`` to ``(bucket, id, home)``: every anchor to which a fingerprint is replicated."""
    spark = marks.sparkSession
    masks = F.broadcast(spark.createDataFrame(replication_masks(), "syndrome int, mask long, home boolean"))
    low = F.lit(0xFFFFFFFF)
    halves = marks.select(
        "mark",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("mark").bitwiseAND(low).alias("half")),
                F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("mark", 32).alias("half")),
            )
        ).alias("part"),
    ).select("mark", "part.*")
    bucket = F.shiftleft(F.col("side").cast("long"), 32).bitwiseOR(F.col("half").bitwiseXOR(F.col("mask")))
    rows = halves.withColumn("syndrome", _syndrome(F.col("half")).cast("int")).join(masks, "syndrome")
    return rows.select(bucket.alias("bucket"), F.col("mark").alias("id"), "home")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of docs. The covering holds for ``bits`` of 0 to 3."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be 0 to {BITS}, the distance that two halves within one bit cover")
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.save(fingerprints(docs, id_col, text_col), "marks")
    nodes = scratch.save(marks.groupBy("mark").agg(F.min("doc_id").alias("first")), "nodes")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= bits
    linked = link_buckets(scratch, anchors(nodes), near)
    # Written tables: the join below is then of two plain scans, a hot component of which Spark can split.
    named = scratch.save(nodes.join(linked.withColumnRenamed("id", "mark"), "mark", "left"), "named")
    best = scratch.save(named.where("comp is not null").groupBy("comp").agg(F.min("first").alias("best")), "best")
    names = named.join(best, "comp", "left").select("mark", F.coalesce("best", "first").alias("component_id"))
    names = scratch.save(names, "names")
    digits = F.lpad(F.lower(F.hex("mark")), 16, "0")
    return marks.join(names, "mark").select("doc_id", digits.alias("fingerprint"), "component_id")
