"""Paired offence and defence ratings, updated in rounds.

A round is one period, in which a team plays at most once, so all its games are independent. The state has one row per
team. A round joins it with the round's sides and meets both sides in a window over the meeting, so a round reads the
state once, and several rounds are one plan: one job and one written state for them, with each team's ratings after each
of its rounds in the row. The driver loops over such jobs; ratings are never collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import expected_score, margin_multiplier, normal_quantile
from ..sources.tables import Workspace

#: Rounds in one plan. Longer plans are planned anew at each of their stages, which costs more than it saves.
ROUNDS_A_JOB = 3
SNAPSHOT = "array<struct<season:bigint,period:bigint,off:double,def:double>>"


@dataclass(frozen=True)
class RatingRules:
    start: float = 1500.0
    k: float = 20.0
    spill: float = 0.3
    keep: float = 0.75
    low: float = 1000.0
    high: float = 2200.0
    cap: float = 3.0
    home_bonus: float = 65.0


def complete(games: DataFrame) -> DataFrame:
    """Games without a null in what the ratings need."""
    return games.dropna(subset=["season", "period", "home", "away", "home_score", "away_score"])


def fresh_state(games: DataFrame, rules: RatingRules) -> DataFrame:
    """``(team, off, def, last_season)``: every team at the start value."""
    teams = games.select(F.explode(F.array("home", "away")).alias("team")).distinct()
    last = F.lit(None).cast("long")
    return teams.select("team", F.lit(rules.start).alias("off"), F.lit(rules.start).alias("def"), last.alias("last_season"))


def sides(games: DataFrame) -> DataFrame:
    """One row a team and game; the home team names the meeting."""
    side = lambda who, own, other: F.struct(F.col(who).alias("team"), F.lit(who == "home").alias("at_home"), F.col(own).alias("own"), F.col(other).alias("other"))
    both = F.array(side("home", "home_score", "away_score"), side("away", "away_score", "home_score"))
    return complete(games).select("season", "period", F.col("home").alias("meeting"), F.explode(both).alias("s")).select("season", "period", "meeting", "s.*")


def play_round(state: DataFrame, played: DataFrame, rules: RatingRules, seasons: Sequence[int] = ()) -> DataFrame:
    """State after one round's :func:`sides`; further columns of the state are kept, ``snapshots`` gets the new ratings.

    All ratings are pulled to the mean once for each of ``seasons`` (those with games, in order) that begins between a
    team's last game and this one. A stored rating is never pulled: it is that after the team's last game. Without
    ``seasons``, a later season counts once.
    """
    kept = [c for c in state.columns if c not in ("off", "def", "last_season", "snapshots")]
    rows = state.join(played, "team", "left")
    begun = F.when(F.col("last_season") < F.col("season"), 1).otherwise(0)
    if seasons:
        passed = F.filter(F.array(*map(F.lit, seasons)), lambda s: (s > F.col("last_season")) & (s <= F.col("season")))
        begun = F.when(F.col("last_season") < F.col("season"), F.size(passed)).otherwise(0)
    pull = F.pow(F.lit(rules.keep), begun)
    now = lambda c: F.when(F.col("meeting").isNotNull(), rules.start + pull * (F.col(c) - rules.start)).otherwise(F.col(c))
    rows = rows.withColumns({"__off": now("off"), "__def": now("def")}).withColumn("__mean", (F.col("__off") + F.col("__def")) / 2)
    # teams without a game are groups of their own
    meeting = Window.partitionBy("meeting", F.when(F.col("meeting").isNull(), F.col("team")))
    of = lambda home: F.max(F.when(F.col("at_home") == home, F.col("__mean"))).over(meeting)
    rows = rows.withColumns({"__home": of(True), "__away": of(False)})
    rival = F.when(F.col("at_home"), F.col("__away")).otherwise(F.col("__home"))
    margin = F.col("own") - F.col("other")
    won, tie = margin > 0, margin == 0
    bonus = F.when(F.col("at_home"), F.lit(rules.home_bonus)).otherwise(F.lit(-rules.home_bonus))
    gap = F.when(won, F.col("__mean") - rival).otherwise(rival - F.col("__mean"))
    factor = F.when(tie, 1.0).otherwise(margin_multiplier(margin.cast("double"), gap, rules.cap))
    result = F.when(won, 1.0).when(tie, 0.5).otherwise(0.0)
    step = rules.k * factor * (result - expected_score(F.col("__mean"), rival, bonus))
    share = {"off": F.when(tie, 0.5).when(won, 1.0).otherwise(rules.spill), "def": F.when(tie, 0.5).when(won, rules.spill).otherwise(1.0)}
    clip = lambda c: F.least(F.greatest(c, F.lit(rules.low)), F.lit(rules.high))
    moved = {c: F.when(F.col("meeting").isNotNull(), clip(F.col(f"__{c}") + step * share[c])).otherwise(F.col(c)) for c in share}
    rows = rows.select(*kept, *(["snapshots"] if "snapshots" in state.columns else []), "season", "period", "meeting",
                       moved["off"].alias("off"), moved["def"].alias("def"), F.coalesce("season", "last_season").alias("last_season"))
    after = rows.select(*kept, "off", "def", "last_season", *(["snapshots", "season", "period", "meeting"] if "snapshots" in state.columns else []))
    if "snapshots" not in state.columns:
        return after
    new = F.array(F.struct("season", "period", "off", "def"))
    return after.withColumn("snapshots", F.when(F.col("meeting").isNotNull(), F.concat("snapshots", new)).otherwise(F.col("snapshots"))).drop("season", "period", "meeting")


def rounds_of(games: DataFrame) -> list[tuple[int, int]]:
    """The distinct (season, period) in order, a few rows."""
    return [(r.season, r.period) for r in complete(games).select("season", "period").distinct().orderBy("season", "period").collect()]


def rate(workspace: Workspace, games: DataFrame, rules: RatingRules = RatingRules()) -> DataFrame:
    """Ratings after each round in which a team played: ``(season, period, team, off, def)``."""
    games = workspace.save(complete(games), "games")
    both = workspace.save(sides(games), "sides")
    rounds = rounds_of(games)
    seasons = sorted({s for s, _ in rounds})
    none = F.array().cast(SNAPSHOT)
    state = workspace.save(fresh_state(games, rules).withColumn("snapshots", none), "state-start")
    parts = [state]
    for at in range(0, len(rounds), ROUNDS_A_JOB):
        now = state.withColumn("snapshots", none)
        for season, period in rounds[at : at + ROUNDS_A_JOB]:
            now = play_round(now, both.where((F.col("season") == season) & (F.col("period") == period)), rules, seasons)
        state = workspace.save(now, f"state-{at}")
        parts.append(state)
    history = reduce(DataFrame.unionByName, parts).select("team", F.explode("snapshots").alias("s"))
    return workspace.save(history.select("s.season", "s.period", "team", "s.off", "s.def"), "history")


def implied_line(rating_gap: Column, sigma: float) -> Column:
    """Expected margin of a rating gap: the normal quantile of its win probability times sigma."""
    p = F.least(F.greatest(expected_score(rating_gap, F.lit(0.0)), F.lit(0.001)), F.lit(0.999))
    return normal_quantile(p) * sigma
