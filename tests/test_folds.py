"""Walk-forward queries predict every season that has rows to learn from."""

from priorframe.plans import learn_queries

ROWS = "game long, season long, pred double, naive double, share double, label double"


def test_every_season_after_the_first(spark, monkeypatch):
    rows = [(s * 10 + k, s, float(k), float(k % 3), float(k % 2), 2.0 * k + s % 5) for s in (1995, 1996, 1997, 2002) for k in range(8)]
    table = spark.createDataFrame(rows, ROWS).cache()
    monkeypatch.setattr(learn_queries, "frame", lambda spark, sf_dir: table)
    found = lambda run: {r.season for r in run(spark, "").select("season").distinct().collect()}
    assert found(learn_queries.l02) == {1996, 1997, 2002}
    # three stages, each of which learns from seasons that the stage before predicted
    assert found(learn_queries.l05) == {2002}
