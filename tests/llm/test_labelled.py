import random
import zlib

import numpy as np
import pytest

from priorframe.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def rate(rows, labels, column):
    held = [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return np.mean([r.predicted == y for r, y in held]), held


def tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    accuracy, held = rate(rows, {r.doc_id: r.quality for r in labels.collect()}, "quality")
    assert accuracy >= 0.9 and len(held) > 50


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rows = toxicity.toxic_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    known = {r.doc_id: r.toxic for r in labels.collect()}
    accuracy, held = rate(rows, known, "toxic")
    assert accuracy >= 0.95
    assert all(r.passages for r, y in held if r.predicted)


def test_held_out_labels_change_nothing(spark):
    docs, labels = tables(spark)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) toxic", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) quality")
    for run in (quality.quality_scores, toxicity.toxic_documents):
        a, b = ({r.doc_id: r.score for r in run(docs, x).collect()} for x in (labels, flipped))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


@pytest.mark.parametrize("run", [quality.quality_scores, toxicity.toxic_documents])
def test_odd_rows(spark, run):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (None, "some text", 0.0), (2, "", 0.0), (3, "word " * 30_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (3, 0, 1), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(run(docs, labels).collect()) == 5
    assert len({r.score for r in run(docs, labels).where("doc_id = 2").collect()}) == 1
    assert run(docs, labels.limit(0)).count() == 5 and run(docs.limit(0), labels).count() == 0


def brute_segments(s):
    best = None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            t = sum(s[i:j])
            if t > 0 and (best is None or t > best[0] + 1e-12):
                best = (t, i, j)
    if not best:
        return []
    _, i, j = best
    return brute_segments(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(s[j:])]


def test_segments_against_the_definition():
    rng = random.Random(0)
    for _ in range(500):
        s = [rng.choice([4, -5, 3, -3, 1, 2, -2, 5, -1]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        assert [x[:2] for x in toxicity.maximal_segments(s)] == brute_segments(s)


def test_joining_ordinary_words_changes_no_segment():
    model = toxicity.ToxicityModel({"bad": 3.0, "worse": 5.0, "fine": -2.0})
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice(["bad", "worse", "fine", "x", "y", "z"]) for _ in range(rng.randint(0, 40))]
        plain = toxicity.maximal_segments([model.scores.get(w, 0.0) - toxicity.DRIFT for w in words])
        joined = model.segments(words)
        assert [x[:2] for x in joined] == [x[:2] for x in plain]
