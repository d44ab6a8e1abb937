"""Quality scores by compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled good and bad texts. A text that the good dictionary compresses better
resembles good text. The difference of the two compressed sizes, divided by the text's own size, is all that the score
sees; a logistic curve calibrates it to the probability of label 1.

The labelled sample is bounded by ``max_labelled`` (60,000 ids) and dealt in two halves by a hash, whatever its size: one
builds the dictionaries, the other fits the curve. ``per_class`` texts a class (2,000, each of at most ``longest`` bytes,
65,536) go to the driver for the dictionaries, in pieces of ``PIECE`` bytes, at most 262 MB at the worst and 8 MB as a
rule; the curve is fitted on the sizes of at most ``calibrate`` texts (20,000). Texts are scored whole.

Defined cases: null and empty texts are scored as empty; without labels of both classes every score is the share of
good labels (0.5 without labels); repeated rows get equal rows; a null doc_id is kept and is not held out; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_LABELLED, held_out, labelled_texts, logistic, probability, training_labels
from .scratch import Scratch

DICTIONARY_BYTES = 32_768
PIECE = 1_024
PER_CLASS = 2_000
LONGEST = 65_536
CALIBRATE = 20_000
LEVEL = 3


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' end as raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def _compressor(content: bytes | None) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if content is None or len(content) < 8:
        return zstandard.ZstdCompressor(**options)
    shared = zstandard.ZstdCompressionDict(content)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=shared, **options)


def pieces(texts: list[bytes]) -> list[bytes]:
    """Texts cut in pieces of PIECE bytes, so that long ones do not fill a dictionary alone."""
    return [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]


def size_differences(texts: list[bytes | None], bad: bytes, good: bytes) -> np.ndarray:
    """How much smaller each text is with the good dictionary than with the bad one, as a share of its size."""
    coders = [_compressor(bad), _compressor(good)]
    sizes = np.array([[len(c.compress(t or b"")) for c in coders] for t in texts], float).reshape(-1, 2)
    return (sizes[:, 0] - sizes[:, 1]) / np.maximum(np.array([len(t or b"") for t in texts], float), 1)


@dataclass
class QualityModel:
    """The two dictionaries, the centre and scale of the difference, and the curve."""

    bad: bytes
    good: bytes
    centre: float
    scale: float
    curve: list[float]

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return probability(((size_differences(texts, self.bad, self.good) - self.centre) / self.scale)[:, None], self.curve)


def fit(
    docs: DataFrame, labels: DataFrame, modulus: int, rest: int, id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = MAX_LABELLED, per_class: int = PER_CLASS, longest: int = LONGEST, calibrate: int = CALIBRATE,
) -> QualityModel:
    """Learn only from labelled rows whose crc32(id as text) mod ``modulus`` is not ``rest``."""
    scratch = Scratch(docs.sparkSession, "quality")
    sample = scratch.save(training_labels(labels, "quality", modulus, rest, max_labelled, F.min), "sample")
    order = F.xxhash64("doc_id", F.lit("dictionary"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    seeds = [sample.where((F.col("y") == y) & (half == 0)).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    seeds = scratch.save(seeds[0].unionByName(seeds[1]), "seeds")
    rows = labelled_texts(docs, seeds, id_col, text_col).where(F.length("text").between(1, longest)).distinct()
    rows = rows.orderBy(order, "doc_id", "text").limit(2 * per_class).collect()
    bad, good = (build_dictionary(pieces([bytes(r.text) for r in rows if r.y == y])) for y in (0, 1))
    others = scratch.save(sample.where(half == 1).orderBy(order, "doc_id").limit(calibrate), "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = size_differences([t.as_py() for t in batch.column(0)], bad, good)
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column(1)], names=["x", "y"])

    sizes = labelled_texts(docs, others, id_col, text_col).select("text", "y")
    # rows of numbers; the order is fixed where repeated ids give more of them than the bound
    found = sizes.mapInArrow(run, "x double, y int").orderBy(F.xxhash64("x", "y"), "x").limit(2 * calibrate).collect()
    x, y = np.array([r.x for r in found], float), np.array([r.y for r in found], float)
    centre, scale = (float(x.mean()), max(float(x.std()), 1e-9)) if len(x) else (0.0, 1.0)
    return QualityModel(bad, good, centre, scale, logistic(((x - centre) / scale)[:, None], y, np.ones(len(y))))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores([t.as_py() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2, threshold: float = 0.7
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of docs."""
    rows = score(docs, fit(docs, labels, modulus, rest))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return rows.select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "score", predicted)
