"""The streamed ratings over every round of a table of several seasons."""

from priorframe.operators.rating import rate
from priorframe.plans import stream_queries
from priorframe.sources.tables import Workspace

GAMES = "season long, period long, home long, away long, home_score long, away_score long"


def test_streamed_rounds_reach_the_last_season(spark, monkeypatch):
    rows = [(1995, 1, 1, 2, 3, 1), (1995, 5, 2, 1, 4, 1), (1995, 5, 3, 4, 2, 2), (1996, 1, 1, 3, 0, 5), (1997, 2, 2, 4, 1, 0)]
    monkeypatch.setattr(stream_queries, "games", lambda spark, sf_dir: spark.createDataFrame(rows, GAMES))
    got = {r.team: (r.off, r["def"], r.last_season) for r in stream_queries.x07(spark, "").collect()}
    seen = rate(Workspace(spark, "test-rounds"), spark.createDataFrame(rows, GAMES))
    last = {}
    for r in seen.orderBy("season", "period").collect():
        last[r.team] = (round(r.off, 6), round(r["def"], 6))
    assert {t: x[:2] for t, x in got.items()} == last
    assert {t: x[2] for t, x in got.items()} == {1: 1996, 2: 1997, 3: 1996, 4: 1997}
