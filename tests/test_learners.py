"""Learners without SQL against their closed forms."""

import numpy as np
import pytest

from priorframe.operators import learn
from priorframe.plans import learn_queries as L
from priorframe.plans import scalar_queries


def ridge(x, y, alpha):
    centre = x.mean(0)
    beta = np.linalg.solve((x - centre).T @ (x - centre) + alpha * np.eye(x.shape[1]), (x - centre).T @ (y - y.mean()))
    return lambda z: (z - centre) @ beta + y.mean()


@pytest.fixture(scope="module")
def table(spark):
    rows = L.frame(spark, "/root/testdata/sf0.001").collect()
    return [r for r in rows if r.season is not None]


def filled(rows, seen, inputs):
    middle = [np.median([r[c] for r in seen if r[c] is not None]) for c in inputs]
    return np.array([[m if r[c] is None else float(r[c]) for c, m in zip(inputs, middle)] for r in rows])


def test_ridge_on_a_holdout_and_what_inputs_add(spark, sf, table):
    train, holdout = [r for r in table if r.season < 2001], [r for r in table if r.season == 2001]
    y, truth = np.array([r.label for r in train]), np.array([r.label for r in holdout])
    error = {}
    for name, inputs in (("without", ["pred"]), ("with", L.INPUTS)):
        error[name] = np.abs(ridge(filled(train, train, inputs), y, 10.0)(filled(holdout, train, inputs)) - truth)
    got = {r.grp: (r.ridge, r.floor) for r in L.l04(spark, sf).collect()}
    for grp, (found, floor) in got.items():
        mine = [k for k, r in enumerate(holdout) if r.grp == grp]
        assert found == pytest.approx(error["with"][mine].mean(), abs=2e-4) and floor == pytest.approx(np.abs(truth[mine] - y.mean()).mean(), abs=2e-4)
    row = L.l08(spark, sf).first()
    assert row["without"] == pytest.approx(error["without"].mean(), abs=1e-4) and row["with"] == pytest.approx(error["with"].mean(), abs=1e-4)
    assert row.keeps == (error["without"].mean() - error["with"].mean() > 0.01)


def test_stacked_predictions(spark, sf, table):
    """Three stages out of fold, each on what the stage before predicted."""

    def stage(rows, inputs, alpha, out):
        done = []
        for season in sorted({r["season"] for r in rows}):
            seen = [r for r in rows if r["season"] < season]
            now = [r for r in rows if r["season"] == season]
            if seen:
                guess = ridge(filled(seen, seen, inputs), np.array([r["label"] for r in seen]), alpha)(filled(now, seen, inputs))
                done += [{**r, out: float(g), "last": max(s["season"] for s in seen)} for r, g in zip(now, guess)]
        return done

    rows = stage(stage(stage([r.asDict() for r in table], ["pred", "naive"], 1.0, "base_a"), ["share"], 1.0, "base_b"), ["base_a", "base_b"], 5.0, "p")
    want = {r["game"]: (r["p"], r["last"]) for r in rows}
    got = {r.game: (r.prediction, r.max_train_season) for r in L.l05(spark, sf).collect()}
    assert set(got) == set(want) and all(got[k][1] == want[k][1] for k in want)
    # the solver stops at a tolerance, which one season with ten distinct inputs makes larger than its predictions' spread
    later = [r["game"] for r in rows if r["season"] >= 1999]
    assert len(later) > 300 and max(abs(got[k][0] - want[k][0]) for k in later) < 1e-2


def test_out_of_fold_predictions_never_see_their_season(spark, sf):
    rows = L.l02(spark, sf).collect()
    assert rows and all(r.max_train_season < r.season and np.isfinite(r.prediction) for r in rows)


def test_availability_is_calibrated(spark, sf):
    rows = L.l09(spark, sf).collect()
    assert rows and all(0 <= r.p_active <= 1 and np.isfinite(r.role) for r in rows)


def test_vectors_on_their_principal_axes(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    names, x = list(rows), np.stack(list(rows.values()))
    # centred by the scaler, which divides by the sample deviation
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    value, vector = np.linalg.eigh(np.cov(z.T))
    want = np.tanh(z @ vector[:, np.argsort(-value)[:8]])
    got = {r.vec_id: np.array(r.profile) for r in scalar_queries.f28(spark, sf).collect()}
    assert set(got) == set(names)
    # an axis has no sign
    assert max(np.abs(np.abs(got[n]) - np.abs(w)).max() for n, w in zip(names, want)) < 1e-6


def test_medians_of_inputs_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert learn.medians(df, ["a", "b"]) == {"a": 2.0, "b": 0.0}
