"""Toxic passages by maximum-scoring segments over token log-odds.

Token scores are log-odds ratios of toxic against clean labelled texts under an informative Dirichlet prior, the
frequencies of all labelled texts. In training a token counts once per text, so that a text that repeats a word says no
more than one that has it; in the scan every occurrence is scored, so that no passage is lost to an earlier one. Tokens whose ratio is not significant (a z-score below sqrt(2 ln n) for n
toxic texts, as in the Bayesian information criterion) only cost the drift, a small penalty that keeps the expected
score of clean text negative. A linear scan finds every maximal scoring segment. A segment's score S in a text of n
tokens is calibrated as an extreme value: E = K n exp(-lambda S), lambda from the clean token distribution and K from
the largest segments of clean text. Segments of E below one half are reported; a document's evidence is the sum of
-ln E over them, or -ln E of its best segment if none is, and a logistic curve turns it into a score.

The labelled sample is bounded by ``max_labelled`` (60,000 ids). A significant token is in many of its texts, so the
table of token scores is bounded by the sample too; counting, fitting and scoring run on the executors, and only this
table and histograms reach the driver.

Defined cases: null and empty texts have no tokens and get the curve's value for no evidence; without labels every score
is 0.0; repeated rows get equal rows; a null doc_id is kept and is not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import MAX_LABELLED, held_out, labelled_texts, logistic, probability, training_labels
from .scratch import Scratch

PRIOR_SHARE = 0.1
DRIFT = 0.5
REPORT_E = 0.5
WORD = re.compile(r"\w+")


def tokens(text: bytes | None) -> list[str]:
    return WORD.findall((text or b"").decode("utf-8", "replace").lower())


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in linear time.

    Candidates are kept in a list with the running totals before and after each. A new positive run is joined with the
    latest candidate that starts lower, as long as it ends higher than that candidate; the candidates between are dropped.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, nearest lower start
    total = 0.0
    for at, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low = at, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((start, at + 1, low, total, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class ToxicityModel:
    """Bounded state of a fitted model, sent with the tasks."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    log_k: float = 0.0
    curve: list[float] = field(default_factory=list)

    def segments(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Maximal segments in positions of words. Runs of ordinary words are joined first, which changes no segment."""
        get = self.scores.get
        marks = [(k, s) for k, w in enumerate(words) if (s := get(w)) is not None]
        if not any(s > DRIFT for _, s in marks):
            return []
        series: list[float] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for k, s in marks:
            if k > at:
                series.append(-DRIFT * (k - at))
                spans.append((at, k))
            series.append(s - DRIFT)
            spans.append((k, k + 1))
            at = k + 1
        return [(spans[a][0], spans[b - 1][1], s) for a, b, s in maximal_segments(series)]

    def log_e(self, score: float, n: int) -> float:
        return self.log_k + math.log(max(n, 1)) - self.decay * score

    def evidence(self, words: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's evidence and its reported segments ``(start, end, E)``."""
        n = len(words)
        found = [(a, b, self.log_e(s, n)) for a, b, s in self.segments(words)]
        if not found:
            return 0.0, []
        passed = [x for x in found if x[2] < math.log(REPORT_E)]
        total = sum(-x[2] for x in passed) if passed else -min(x[2] for x in found)
        return max(total, 0.0), [(a, b, math.exp(e)) for a, b, e in passed]


def count_tokens(texts: DataFrame) -> DataFrame:
    """``(token, toxic, clean)``: numbers of labelled texts with a token; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[y].update(set(tokens(text.as_py())))
            words = list({**counts[0], **counts[1]})
            columns = [words, [counts[1][w] for w in words], [counts[0][w] for w in words]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["token", "toxic", "clean"],
            )

    counts = texts.select("text", "y").mapInArrow(run, "token string, toxic long, clean long")
    return counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, n_toxic: int, prior_share: float = PRIOR_SHARE) -> DataFrame:
    """``(token, delta, clean)`` of all significant tokens."""
    sums = counts.agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0"))
    rows = counts.crossJoin(F.broadcast(sums))  # one row
    prior = prior_share * (F.col("n1") + F.col("n0"))
    a = prior_share * (F.col("toxic") + F.col("clean"))
    y1, y0 = F.col("toxic") + a, F.col("clean") + a
    ratio = F.log(y1 / (F.col("n1") + prior - y1)) - F.log(y0 / (F.col("n0") + prior - y0))
    rows = rows.withColumn("delta", ratio).withColumn("z", F.col("delta") / F.sqrt(1 / y1 + 1 / y0))
    least = math.sqrt(2 * math.log(max(n_toxic, 3)))
    rows = rows.where(F.abs("z") >= least)
    return rows.select("token", "delta", (F.col("clean") / F.col("n0")).alias("clean"))


def solve_decay(scores: np.ndarray, rates: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1, by bisection; rates of listed tokens, the rest cost the drift."""
    rest = max(0.0, 1 - rates.sum())
    total = lambda x: float((rates * np.exp(np.minimum(x * (scores - DRIFT), 50))).sum() + rest * math.exp(-x * DRIFT))
    low, high = 1e-3, 1.0
    while total(high) < 1 and high < 16:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 1 else (low, mid)
    return low


def _evidence_rows(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """Histogram ``(y, n_bin, best, n)`` of labelled texts' best segments, counted in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: Counter = Counter()
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                words = tokens(text.as_py())
                top = max((s for _, _, s in model.segments(words)), default=0.0)
                out[y, round(math.log(max(len(words), 1)), 1), round(top, 1), round(model.evidence(words)[0], 1)] += 1
            rows = list(out)
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([out[r] for r in rows], pa.int64())], names=["y", "log_n", "top", "evidence", "n"])

    rows = texts.select("text", "y").mapInArrow(run, "y int, log_n double, top double, evidence double, n long")
    return rows.groupBy("y", "log_n", "top", "evidence").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame, labels: DataFrame, modulus: int, rest: int, id_col: str = "doc_id", text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
) -> ToxicityModel:
    """Learn only from labelled rows whose crc32(id as text) mod ``modulus`` is not ``rest``."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(training_labels(labels, "toxic", modulus, rest, max_labelled, F.max), "sample")
    # copies of a text count once, by their smallest id
    copies = labelled_texts(docs, sample, id_col, text_col).select("doc_id", "y", F.xxhash64("text").alias("key"))
    sample = scratch.save(copies.groupBy("key").agg(F.min(F.struct("doc_id", "y")).alias("m")).select("m.*"), "distinct")
    texts = labelled_texts(docs, sample, id_col, text_col)
    counts = scratch.save(count_tokens(texts), "counts")
    n_toxic = sample.where("y = 1").count()
    rows = log_odds(counts, n_toxic).orderBy("token").collect()
    model = ToxicityModel({r.token: r.delta for r in rows})
    if not rows:
        return model
    delta, rates = np.array([r.delta for r in rows]), np.array([r.clean for r in rows])
    model.decay = solve_decay(delta, rates)
    bins = _evidence_rows(texts, model).collect()
    # K: the mean largest segment of clean text gives ln(K n) = lambda * mean - 0.5772 for a Gumbel law.
    clean = [(r.log_n, r.top, r.n) for r in bins if r.y == 0 and r.top > 0]
    if clean:
        weight = np.array([c[2] for c in clean], float)
        gap = np.array([model.decay * top - log_n for log_n, top, _ in clean])
        model.log_k = float(np.average(gap, weights=weight)) - 0.5772
    model.log_k = min(max(model.log_k, -12.0), 0.0)
    final = _evidence_rows(texts, model).collect() if clean else bins
    x = np.array([[r.evidence] for r in final])
    model.curve = logistic(np.minimum(x, 40.0), np.array([r.y for r in final], float), np.array([r.n for r in final], float))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, evidence, passages)``; passages are arrays of ``(first_word, last_word, e_value)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("e_value", pa.float64())]))
        for batch in batches:
            found = [m.evidence(tokens(x.as_py())) for x in batch.column(1)]
            values = np.array([e for e, _ in found], float).reshape(-1, 1)
            scores = probability(np.minimum(values, 40.0), m.curve) if m.curve else np.zeros(len(found))
            spans = [[{"first_word": a, "last_word": b - 1, "e_value": e} for a, b, e in s] for _, s in found]
            arrays = [batch.column(0), pa.array(scores), pa.array(values[:, 0]), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "evidence", "passages"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    schema = "doc_id long, score double, evidence double, passages array<struct<first_word:long,last_word:long,e_value:double>>"
    return rows.mapInArrow(run, schema)


def toxic_documents(
    docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, threshold: float = 0.7
) -> DataFrame:
    """Every document's ``held_out, score, predicted`` with its toxic passages."""
    model = fit(docs, labels, modulus, rest)
    rows = score(docs, model)
    return rows.select(
        "doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "passages",
    )


def reject(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without those that score at least ``threshold``; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts):
        m = shared.value
        values = np.minimum(np.array([m.evidence(tokens(t))[0] for t in texts], float).reshape(-1, 1), 40.0)
        return pd.Series(probability(values, m.curve) < threshold if m.curve else np.ones(len(texts), bool))

    return docs.where(clean(F.col(text_col).cast("binary")))
