"""Ratings (R), with their SQL: a recursion over rounds whose rows are the teams' ratings after each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import expected_score, quantile_sql
from ..operators.rank import ordinal
from ..operators.rating import RatingRules, fresh_state, implied_line, play_round, rate, sides
from ..operators.temporal import asof_join
from ..sources.tables import Workspace, files_fingerprint
from .aggregate_queries import GAMES, games
from .facts import FACT, table
from .join_queries import ROUND
from .registry import query

_HISTORY: dict[tuple[str, str, str], str] = {}

#: Every team's ratings after each round; season and period are null where it did not play.
RATINGS = f"""WITH RECURSIVE {FACT}, {ROUND}, {GAMES},
rounds AS (SELECT season, period, row_number() OVER (ORDER BY season, period) AS no, dense_rank() OVER (ORDER BY season) AS sno FROM (SELECT DISTINCT season, period FROM games)),
sides AS (SELECT no, sno, season, period, home AS team, home AS meeting, true AS at_home, (home_score - away_score)::DOUBLE AS margin FROM games JOIN rounds USING (season, period)
 UNION ALL SELECT no, sno, season, period, away, home, false, (away_score - home_score)::DOUBLE FROM games JOIN rounds USING (season, period)),
st(no, team, o, d, last_sno, last_season, season, period) AS (
 SELECT 0::BIGINT, team, 1500.0::DOUBLE, 1500.0::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT team FROM sides)
 UNION ALL
 SELECT no, team,
  CASE WHEN meeting IS NULL THEN o ELSE least(greatest(fo + step * CASE WHEN margin = 0 THEN 0.5 WHEN margin > 0 THEN 1 ELSE 0.3 END, 1000), 2200) END,
  CASE WHEN meeting IS NULL THEN d ELSE least(greatest(fd + step * CASE WHEN margin = 0 THEN 0.5 WHEN margin > 0 THEN 0.3 ELSE 1 END, 1000), 2200) END,
  coalesce(sno, last_sno), coalesce(season, last_season), season, period
 FROM (SELECT *, 20 * CASE WHEN margin = 0 THEN 1 ELSE least(ln(abs(margin) + 1) * 2.2 / ((CASE WHEN margin > 0 THEN mean - rival ELSE rival - mean END) * 0.001 + 2.2), 3) END
   * (CASE WHEN margin > 0 THEN 1 WHEN margin = 0 THEN 0.5 ELSE 0 END - 1 / (1 + pow(10.0::DOUBLE, (rival - mean - CASE WHEN at_home THEN 65 ELSE -65 END) / 400))) AS step
  FROM (SELECT *, CASE WHEN at_home THEN min(CASE WHEN NOT at_home THEN mean END) OVER (PARTITION BY meeting) ELSE min(CASE WHEN at_home THEN mean END) OVER (PARTITION BY meeting) END AS rival
   FROM (SELECT *, (fo + fd) / 2 AS mean FROM (SELECT st.no + 1 AS no, st.team, st.o, st.d, st.last_sno, st.last_season, s.season, s.period, s.sno, s.meeting, s.at_home, s.margin,
     1500 + pow(0.75::DOUBLE, coalesce(s.sno - st.last_sno, 0)) * (st.o - 1500) AS fo, 1500 + pow(0.75::DOUBLE, coalesce(s.sno - st.last_sno, 0)) * (st.d - 1500) AS fd
     FROM st LEFT JOIN sides s ON s.team = st.team AND s.no = st.no + 1 WHERE st.no < (SELECT max(no) FROM rounds))))))"""
MEETINGS = f"""{RATINGS}, met AS (SELECT g.*, h.o AS home_off, h.d AS home_def, a.o AS away_off, a.d AS away_def, ((h.o + h.d) - (a.o + a.d)) / 2 AS gap
 FROM games g JOIN rounds r USING (season, period) JOIN st h ON h.team = g.home AND h.no = r.no - 1 JOIN st a ON a.team = g.away AND a.no = r.no - 1)"""


def history(spark, sf_dir):
    """Ratings after each round; written once for each session and version of the tables' files."""
    mark = files_fingerprint(*(table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem")))
    key = (spark.sparkContext.applicationId, sf_dir, mark)
    if key not in _HISTORY:
        workspace = Workspace(spark, "ratings")
        rate(workspace, games(spark, sf_dir))
        _HISTORY[key] = workspace.path
    return spark.read.parquet(f"{_HISTORY[key]}/history")


def _before(spark, sf_dir, rows, who):
    """Each row with the ratings of a team strictly before its round; the start value where there are none."""
    seen = history(spark, sf_dir).select(F.col("team").alias(who), (F.col("season") * 100 + F.col("period")).alias("as_of"), "off", "def")
    joined = asof_join(rows, seen, [who], "at", "as_of", ["off", "def"], strict=True, prefix=f"{who}_")
    start = F.lit(RatingRules().start)
    return joined.withColumns({f"{who}_{c}": F.coalesce(f"{who}_{c}", start) for c in ("off", "def")}).drop(f"{who}_as_of")


def _meetings(spark, sf_dir):
    return games(spark, sf_dir).withColumn("at", F.col("season") * 100 + F.col("period"))


SIX = ("off", "def")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("R01", RATINGS + " SELECT season, period, team, round(o, 6) AS off, round(d, 6) AS def FROM st WHERE season IS NOT NULL")
def r01(spark, sf_dir):
    return _rounded(history(spark, sf_dir), *SIX)


@query("R02", RATINGS + " SELECT team, round(o, 6) AS off, round(d, 6) AS def, last_season FROM st WHERE no = 1")
def r02(spark, sf_dir):
    """One round from a fresh state."""
    rows = games(spark, sf_dir)
    first = rows.agg(F.min(F.struct("season", "period")).alias("f"))
    one = rows.join(F.broadcast(first.select("f.*")), ["season", "period"])
    return _rounded(play_round(fresh_state(rows, RatingRules()), sides(one), RatingRules()), *SIX)


@query("R03", MEETINGS + " SELECT season, period, home, round(home_off, 6) AS home_off, round(home_def, 6) AS home_def FROM met")
def r03(spark, sf_dir):
    rows = _meetings(spark, sf_dir).select("season", "period", "home", "at")
    return _rounded(_before(spark, sf_dir, rows, "home").drop("at"), "home_off", "home_def")


@query("R04", RATINGS + """, e AS (SELECT season, team, max_by((o + d) / 2, no) AS mean FROM st WHERE season IS NOT NULL GROUP BY ALL)
SELECT season, team, round(mean, 6) AS mean, row_number() OVER (PARTITION BY season ORDER BY mean DESC, team) AS place FROM e""")
def r04(spark, sf_dir):
    """Teams by mean rating after each season's last round."""
    last = history(spark, sf_dir).groupBy("season", "team").agg(F.max_by(F.struct("off", "def"), "period").alias("r"))
    rows = last.select("season", "team", ((F.col("r.off") + F.col("r.def")) / 2).alias("mean"))
    return _rounded(rows.withColumn("place", ordinal(("season",), F.desc("mean"), "team")), "mean")


def rated_meetings(spark, sf_dir):
    """Meetings with four ratings, their difference and the implied probability; the home bonus is optional and off."""
    rows = _before(spark, sf_dir, _before(spark, sf_dir, _meetings(spark, sf_dir), "home"), "away")
    mean = lambda who: (F.col(f"{who}_off") + F.col(f"{who}_def")) / 2
    return rows.drop("at").withColumn("gap", mean("home") - mean("away")).withColumn("p_home", expected_score(mean("home"), mean("away")))


@query("R05", MEETINGS + """ SELECT season, period, home, away, home_score, away_score, round(home_off, 6) AS home_off, round(home_def, 6) AS home_def,
 round(away_off, 6) AS away_off, round(away_def, 6) AS away_def, round(gap, 6) AS gap, round(1 / (1 + pow(10.0::DOUBLE, -gap / 400)), 6) AS p_home FROM met""")
def r05(spark, sf_dir):
    return _rounded(rated_meetings(spark, sf_dir), "home_off", "home_def", "away_off", "away_def", "gap", "p_home")


@query("R06", MEETINGS + f""", p AS (SELECT *, least(greatest(1 / (1 + pow(10.0::DOUBLE, -gap / 400)), 0.001), 0.999) AS p FROM met)
SELECT season, period, home, away, round(CASE WHEN home % 2 = 0 THEN (home_score - away_score)::DOUBLE ELSE 13.5 * ({quantile_sql("p")}) END, 6) AS line,
 CASE WHEN home % 2 = 0 THEN 'stored' ELSE 'implied' END AS basis FROM p""")
def r06(spark, sf_dir):
    """A stored line where there is one, else the line that the ratings imply."""
    rows = rated_meetings(spark, sf_dir)
    stored = F.when(F.col("home") % 2 == 0, (F.col("home_score") - F.col("away_score")).cast("double"))
    line = F.coalesce(stored, implied_line(F.col("gap"), 13.5))
    return rows.select("season", "period", "home", "away", F.round(line, 6).alias("line"), F.when(stored.isNull(), "implied").otherwise("stored").alias("basis"))
