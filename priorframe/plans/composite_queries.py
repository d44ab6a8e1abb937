"""Composite pipelines (C) built from the other queries' parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.aggregate import mode_per_key
from ..operators.quality import failed_rules, quarantine
from ..operators.rank import global_ordinal
from ..operators.temporal import filtered_form, prior_values, prior_window, safe_ratio
from ..sources.tables import VersionedTable, Workspace, promote_run, protected_upsert
from ..streaming.stateful import run_batches
from .aggregate_queries import a06, a07, a08, a11, a12, a13, a14, a17, a24, a25
from .facts import FACT, PLAYS, facts, months, plays, table
from .join_queries import SEVERITY, j02, j04, j10, u10
from .metric_queries import m10, m11, m16
from .rank_queries import BOARD, board, t03, t04, t07, t08, t09, t10
from .rating_queries import r05
from .registry import ORACLES, query
from .scalar_queries import f19
from .window_queries import KALMAN, prior_of, w02, w09, w10, w11, w12, w13, w15

KEYS = ["entity", "season", "period", "game"]
SEASON, ORDER = ("entity", "season"), ("period", "game")


def _with(key: str) -> str:
    """A registered query's SQL as a sub-query."""
    return f"({ORACLES[key]})"


def entity_features(fact: DataFrame) -> DataFrame:
    """Each row of a fact with what the entity's strictly earlier rows say: one shuffle, two sort orders, no join."""
    fact = fact.repartition("entity")  # serves the windows of a season and of a career
    keep = F.col("lines").isNull() | (F.col("lines") >= 3)
    kept = lambda c: F.when(keep, F.col(c))
    before, last3 = prior_window(SEASON, ORDER), prior_window(SEASON, ORDER, 3)
    season, career = Window.partitionBy(*SEASON).orderBy(*ORDER), Window.partitionBy("entity").orderBy("season", *ORDER)
    active = F.max(F.when(F.col("lines") >= 3, F.col("period"))).over(before)
    trend = F.last("qty", ignorenulls=True).over(before) - F.first("qty", ignorenulls=True).over(before)
    carried = F.last(F.when(F.col("returned") > 0, F.struct("qty", "lines")), ignorenulls=True).over(before)
    rows = fact.select(
        *KEYS, "grp", "team", F.avg(kept("qty")).over(before).alias("mean_qty"),
        safe_ratio(F.sum(kept("returned")).over(before), F.sum(kept("lines")).over(before)).alias("return_rate"),
        F.count(F.when(keep, 1)).over(before).alias("n_prior"), F.avg("qty").over(last3).alias("trailing_rows"),
        (F.lag("qty", 1).over(season) - F.coalesce(F.lag("qty", 3).over(season), F.lag("qty", 2).over(season))).alias("trend_3"),
        F.when(F.count("qty").over(before) >= 2, trend).alias("trend_all"), F.lag("qty").over(career).alias("prior_qty"),
        (F.row_number().over(career) - 1).cast("long").alias("prior_games"), (F.col("period") - 1 - F.coalesce(active, F.lit(0))).alias("missed"),
        carried.alias("carried"), "qty",
    )
    rows = filtered_form(rows, SEASON, ORDER, "qty", prior_of(), *KALMAN, "form")
    numbers = [F.col("carried.qty").alias("carried_qty"), F.col("carried.lines").alias("carried_lines"), F.round("form.mean", 6).alias("form"), F.round("form.var", 6).alias("form_var")]
    return rows.select(*[c for c in rows.columns if c not in ("carried", "qty", "form")], *numbers)


ENTITY_SQL = " JOIN ".join(
    [
        f"(SELECT entity, season, period, game, grp, team FROM (WITH {FACT} SELECT * FROM fact))", f"{_with('W01')} USING (entity, season, period, game)",
        f"(SELECT entity, season, period, game, trailing_rows FROM {_with('W03')}) USING (entity, season, period, game)",
        f"(SELECT entity, season, period, game, trend AS trend_3 FROM {_with('W04')}) USING (entity, season, period, game)",
        f"(SELECT entity, season, period, game, trend AS trend_all FROM {_with('W05')}) USING (entity, season, period, game)",
        f"(SELECT entity, season, period, game, prior_qty FROM {_with('W06')}) USING (entity, season, period, game)",
        f"(SELECT entity, season, period, game, prior_games FROM {_with('W07')}) USING (entity, season, period, game)",
        f"{_with('W08')} USING (entity, season, period, game)", f"{_with('W14')} USING (entity, season, period, game)", f"{_with('W20')} USING (entity, season, period, game)",
    ]
)


@query("C01", f"""SELECT * FROM {ENTITY_SQL} LEFT JOIN {_with('W02')} USING (team, season, period) LEFT JOIN {_with('W15')} USING (team, season, period)
 LEFT JOIN {_with('W12')} USING (team, grp, season, period, entity) LEFT JOIN {_with('A12')} USING (season, period, grp) LEFT JOIN {_with('A13')} USING (season, period)
 LEFT JOIN (SELECT o_orderkey AS game, c_name, n_name, r_name FROM {_with('J02')}) USING (game)
 LEFT JOIN (SELECT game, bool_or(dome) AS dome, max(rule_era) AS rule_era, min(rest) AS rest, sum(scheme) AS scheme FROM {_with('F19')} GROUP BY 1) USING (game)
 LEFT JOIN (SELECT season, period, team, opponent FROM {_with('J04')}) USING (season, period, team)
 LEFT JOIN (SELECT opponent, season, period, allowed FROM {_with('A11')} WHERE location = 'R') USING (opponent, season, period)
 LEFT JOIN (SELECT game, min(defender) AS defender FROM (WITH {PLAYS} SELECT * FROM plays) GROUP BY 1) USING (game)
 LEFT JOIN {_with('W13')} USING (defender, season, period)""")
def c01(spark, sf_dir):
    """The historical feature matrix: an entity's own history from one window, joined with its team's, rank's and league's,
    with names, venue and rules of the game, what the opponent allowed before, and the first defender's tendency."""
    w = Workspace(spark, "matrix")
    fact = w.save(facts(spark, sf_dir), "fact")
    month = w.save(months(fact), "month")
    # written, so that the planner sees their size: tables of teams and periods then meet the wide rows without a shuffle
    team = w.save(w02(spark, sf_dir, month).join(w15(spark, sf_dir, month), ["team", "season", "period"], "full"), "team")
    group, league = w.save(a12(spark, sf_dir, month), "group"), w.save(a13(spark, sf_dir, month), "league")
    meetings = w.save(j04(spark, sf_dir, fact).drop("opponent_cents"), "meetings")
    allowed = w.save(a11(spark, sf_dir).where("location = 'R'").drop("location"), "allowed")
    # the joins on many rows first, those on the game next to each other
    rows = entity_features(fact).join(w12(spark, sf_dir, month), ["team", "grp", "season", "period", "entity"], "left")
    rows = rows.join(j02(spark, sf_dir).withColumnRenamed("o_orderkey", "game"), "game", "left")
    flags = F.bool_or("dome").alias("dome"), F.max("rule_era").alias("rule_era"), F.min("rest").alias("rest"), F.sum("scheme").alias("scheme")
    rules = f19(spark, sf_dir, "defender").groupBy("game").agg(*flags, F.min("defender").alias("defender"))
    rows = rows.join(rules, "game", "left").join(w13(spark, sf_dir), ["defender", "season", "period"], "left")
    rows = rows.join(team, ["team", "season", "period"], "left").join(group, ["season", "period", "grp"], "left").join(league, ["season", "period"], "left")
    return rows.join(meetings, ["season", "period", "team"], "left").join(allowed, ["opponent", "season", "period"], "left")


NEXT = (2000, 7)


@query("C02", f"""WITH {FACT}, kept AS (SELECT * FROM fact WHERE (season, period) < ({NEXT[0]}, {NEXT[1]})), k AS (SELECT *, (lines IS NULL OR lines >= 3) AS keep FROM kept WHERE season = {NEXT[0]}),
last AS (SELECT entity, max_by(grp, season * 100 + period) AS grp, max_by(team, season * 100 + period) AS team, count(*) AS prior_games FROM kept GROUP BY 1),
s AS (SELECT entity, avg(CASE WHEN keep THEN qty END) AS mean_qty, sum(CASE WHEN keep THEN returned END)::DOUBLE / nullif(sum(CASE WHEN keep THEN lines END), 0) AS return_rate, count(CASE WHEN keep THEN 1 END) AS n_prior,
 {NEXT[1]} - 1 - coalesce(max(CASE WHEN lines >= 3 THEN period END), 0) AS missed FROM k GROUP BY 1),
t AS (SELECT entity, avg(qty) AS trailing_rows FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC, game DESC) AS r FROM k) WHERE r <= 3 GROUP BY 1),
p AS (SELECT entity, last(qty ORDER BY season, period, game) AS prior_qty FROM kept GROUP BY 1)
SELECT entity, {NEXT[0]}::BIGINT AS season, {NEXT[1]}::BIGINT AS period, grp, team, mean_qty, return_rate, coalesce(n_prior, 0) AS n_prior, trailing_rows, coalesce(missed, {NEXT[1] - 1}) AS missed, prior_qty, prior_games, profile
FROM last LEFT JOIN s USING (entity) LEFT JOIN t USING (entity) LEFT JOIN p USING (entity) LEFT JOIN {_with('J10')} USING (entity)""")
def c02(spark, sf_dir):
    """Rows for a period that is still to come, as of its start: the matrix's own code over the rows before it and one row to fill."""
    season, period = (F.lit(x).cast("long") for x in NEXT)
    known = facts(spark, sf_dir).where(F.struct("season", "period") < F.struct(season, period))
    newest = F.max_by(F.struct("grp", "team"), F.struct("season", "period"))
    blank = known.groupBy("entity").agg(newest.alias("now")).select("entity", season.alias("season"), period.alias("period"), F.lit(None).cast("long").alias("game"), "now.*")
    rows = entity_features(known.unionByName(blank, allowMissingColumns=True)).where(F.col("game").isNull())
    part = rows.select("entity", "season", "period", "grp", "team", "mean_qty", "return_rate", "n_prior", "trailing_rows", "missed", "prior_qty", "prior_games")
    return part.join(j10(spark, sf_dir), "entity", "left")


@query("C03", f"""WITH {PLAYS}, g AS (SELECT receiver, team, season, period, game, count(*) AS targets, sum(yards) AS yards, count(*) FILTER (WHERE location = 'R') AS caught, sum(yards) FILTER (WHERE location = 'R') AS ret,
 sum(yards) FILTER (WHERE location = 'A') AS acc, count(*) FILTER (WHERE disc >= 8) AS deep, count(*) FILTER (WHERE disc = 0) AS pressed, max(yards) AS longest FROM plays GROUP BY ALL)
SELECT g.*, targets / sum(targets) OVER t AS target_share, CASE WHEN sum(yards) OVER t > 0 THEN yards / sum(yards) OVER t END AS yard_share, sum(pressed) OVER t / sum(targets) OVER t AS pressure_rate,
 (sum(caught) OVER b)::DOUBLE / nullif(sum(targets) OVER b, 0) AS caught_before, opponent, opponent_cents, drops, rate AS preferred_rate, main.other AS main_other, main.share AS main_share
FROM g LEFT JOIN {_with('J04')} j USING (season, period, team) LEFT JOIN (SELECT game, drops FROM {_with('A07')}) USING (game) LEFT JOIN {_with('A08')} USING (receiver)
LEFT JOIN (SELECT receiver, min(other) AS other, any_value(share) AS share FROM {_with('A06')} WHERE is_max GROUP BY 1) main USING (receiver)
WINDOW t AS (PARTITION BY team, season, period), b AS (PARTITION BY team, season ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def c03(spark, sf_dir):
    """Play features per entity and game from one scan of the plays: sums, shares of the team, the team's rates, the other side."""
    at = lambda v: F.col("location") == v
    rows = plays(spark, sf_dir).groupBy("receiver", "team", "season", "period", "game").agg(
        F.count("*").alias("targets"), F.sum("yards").alias("yards"), F.count_if(at("R")).alias("caught"), F.sum(F.when(at("R"), F.col("yards"))).alias("ret"),
        F.sum(F.when(at("A"), F.col("yards"))).alias("acc"), F.count_if(F.col("disc") >= 8).alias("deep"), F.count_if(F.col("disc") == 0).alias("pressed"), F.max("yards").alias("longest"),
    )
    team, before = Window.partitionBy("team", "season", "period"), prior_values(("team", "season"), "period")
    rows = rows.select(
        "*", (F.col("targets") / F.sum("targets").over(team)).alias("target_share"), F.when(F.sum("yards").over(team) > 0, F.col("yards") / F.sum("yards").over(team)).alias("yard_share"),
        (F.sum("pressed").over(team) / F.sum("targets").over(team)).alias("pressure_rate"), safe_ratio(F.sum("caught").over(before), F.sum("targets").over(before)).alias("caught_before"),
    )
    rows = rows.join(j04(spark, sf_dir), ["season", "period", "team"], "left")
    # charted flags of the game, the entity's rate from the preferred source, and whom it meets most
    rows = rows.join(a07(spark, sf_dir).select("game", "drops"), "game", "left")
    rows = rows.join(a08(spark, sf_dir).withColumnRenamed("rate", "preferred_rate"), "receiver", "left")
    main = a06(spark, sf_dir).where("is_max").groupBy("receiver").agg(F.min("other").alias("main_other"), F.any_value("share").alias("main_share"))
    return rows.join(main, "receiver", "left")


FORM = "SELECT team, season, period, pace, pass_rate, rate_before"


@query("C04", f"""WITH f AS (SELECT * FROM {_with('W15')} JOIN {_with('W02')} USING (team, season, period))
SELECT j.season, j.period, j.team, j.opponent, a.pace, a.pass_rate, a.rate_before, b.pace AS opponent_pace, b.pass_rate AS opponent_pass_rate, b.rate_before AS opponent_rate_before, a.pace - b.pace AS pace_gap, n.n_regionkey = m.n_regionkey AS same_region,
 s.at_home, s.own_off, s.own_def, s.rival_off, s.rival_def, s.p_win, v.roof
FROM {_with('J04')} j LEFT JOIN f a ON a.team = j.team AND a.season = j.season AND a.period = j.period LEFT JOIN f b ON b.team = j.opponent AND b.season = j.season AND b.period = j.period
LEFT JOIN nation n ON n.n_nationkey = j.team LEFT JOIN nation m ON m.n_nationkey = j.opponent
LEFT JOIN (SELECT season, period, home AS team, true AS at_home, home_off AS own_off, home_def AS own_def, away_off AS rival_off, away_def AS rival_def, p_home AS p_win FROM {_with('R05')}
 UNION ALL SELECT season, period, away, false, away_off, away_def, home_off, home_def, round(1 - p_home, 6) FROM {_with('R05')}) s ON s.team = j.team AND s.season = j.season AND s.period = j.period
LEFT JOIN (SELECT team, roof FROM (SELECT s_nationkey::BIGINT AS team, roof, count(*) AS n FROM {_with('A14')} JOIN lineitem ON l_orderkey = game AND l_linenumber = play JOIN supplier ON s_suppkey = l_suppkey WHERE roof IS NOT NULL GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, roof) = 1) v ON v.team = CASE WHEN s.at_home THEN j.team ELSE j.opponent END""")
def c04(spark, sf_dir):
    """A row per side of each meeting with both sides' form and ratings before it, and the home side's venue."""
    form = w15(spark, sf_dir).join(w02(spark, sf_dir), ["team", "season", "period"]).select("team", "season", "period", "pace", "pass_rate", "rate_before")
    other = form.select(F.col("team").alias("opponent"), "season", "period", *(F.col(c).alias(f"opponent_{c}") for c in ("pace", "pass_rate", "rate_before")))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), "n_regionkey")
    region = lambda who, out: F.broadcast(nation.select(F.col("nation").alias(who), F.col("n_regionkey").alias(out)))  # noqa: E731  a fixed dimension
    rows = j04(spark, sf_dir).drop("opponent_cents").join(form, ["team", "season", "period"], "left").join(other, ["opponent", "season", "period"], "left")
    rows = rows.join(region("team", "r1"), "team", "left").join(region("opponent", "r2"), "opponent", "left")
    rows = rows.select(
        "season", "period", "team", "opponent", "pace", "pass_rate", "rate_before", "opponent_pace", "opponent_pass_rate", "opponent_rate_before",
        (F.col("pace") - F.col("opponent_pace")).alias("pace_gap"), (F.col("r1") == F.col("r2")).alias("same_region"),
    )
    rows = rows.join(rated_sides(spark, sf_dir), ["season", "period", "team"], "left")
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    played = line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play"), F.col("s_nationkey").cast("long").alias("venue"))
    venue = mode_per_key(a14(spark, sf_dir).join(played, ["game", "play"]).where("roof is not null"), ["venue"], "roof")
    at = F.when(F.col("at_home"), F.col("team")).otherwise(F.col("opponent"))
    return rows.withColumn("venue", at).join(venue, "venue", "left").drop("venue")


def rated_sides(spark, sf_dir) -> DataFrame:
    """Each meeting's sides as rows of their own: ratings before it and the chance to win, from one scan of the meetings."""
    rows = r05(spark, sf_dir)
    side = lambda own, rival, p: F.struct(
        F.col(own).alias("team"), F.lit(own == "home").alias("at_home"), F.col(f"{own}_off").alias("own_off"), F.col(f"{own}_def").alias("own_def"),
        F.col(f"{rival}_off").alias("rival_off"), F.col(f"{rival}_def").alias("rival_def"), p.alias("p_win"),
    )
    both = F.array(side("home", "away", F.col("p_home")), side("away", "home", F.round(1 - F.col("p_home"), 6)))
    return rows.select("season", "period", F.explode(both).alias("s")).select("season", "period", "s.*")


def preseason(spark, sf_dir, season: int = 2001, multiseason_games: bool = True, age_curve: bool = True, marcel: bool = True, calibrated: bool = True) -> DataFrame:
    """Season totals before a season starts; each part can be switched off.

    Rate: earlier seasons weighted by age, or the shrunk one where there is one. Games: expected from three seasons, or
    last season's. Age: the cohort's ratio to the year before. Calibration: scaled to last season's mean of totals.
    """
    history = facts(spark, sf_dir).where(F.col("season") < season)
    rows = history.groupBy("entity").agg(F.min("season").alias("entry"), F.count(F.when(F.col("season") == season - 1, 1)).alias("last_games"), F.sum(F.when(F.col("season") == season - 1, F.col("qty"))).alias("last_total"))
    rows = rows.join(a17(spark, sf_dir), "entity").join(a25(spark, sf_dir), "entity").withColumn("age", season - F.col("entry"))
    rate = F.col("weighted")
    if marcel:
        rows = rows.join(m11(spark, sf_dir).where(F.col("season") == season).select("entity", "marcel"), "entity", "left")
        rate = F.coalesce("marcel", "weighted")
    total = rate * (F.col("expected") if multiseason_games else F.col("last_games"))
    if age_curve:
        rows = rows.join(F.broadcast(a24(spark, sf_dir).select("age", "curve")), "age", "left")  # a row for each age
        total = total * F.coalesce("curve", F.lit(1.0))
    rows = rows.withColumn("total", total)
    if not calibrated:
        return rows.select("entity", F.round("total", 4).alias("total"))
    means = rows.agg(F.avg("last_total").alias("before"), F.avg("total").alias("now"))
    return rows.crossJoin(F.broadcast(means)).select("entity", F.round(F.col("total") * F.col("before") / F.col("now"), 4).alias("total"))


@query("C05", f"""WITH h AS (WITH {FACT} SELECT entity, min(season) AS entry, count(*) FILTER (WHERE season = 2000) AS last_games, sum(qty) FILTER (WHERE season = 2000) AS last_total FROM fact WHERE season < 2001 GROUP BY 1),
r AS (SELECT entity, last_total, coalesce(marcel, weighted) * expected * coalesce(curve, 1.0) AS total FROM h JOIN {_with('A17')} USING (entity) JOIN {_with('A25')} USING (entity)
 LEFT JOIN (SELECT entity, marcel FROM {_with('M11')} WHERE season = 2001) USING (entity) LEFT JOIN {_with('A24')} c ON c.age = 2001 - entry)
SELECT entity, round(total * (SELECT avg(last_total) FROM r) / (SELECT avg(total) FROM r), 4) AS total FROM r""")
def c05(spark, sf_dir):
    return preseason(spark, sf_dir)


@query("C06", f"""SELECT entity, place, kind, position, vor, blend, cold, market_rank, market_rank - place AS value_vs_market FROM {_with('T08')} JOIN {_with('T04')} USING (entity) LEFT JOIN (SELECT entity, blend FROM {_with('T07')}) USING (entity)
 LEFT JOIN (SELECT entity, cold FROM {_with('T03')}) USING (entity) LEFT JOIN (WITH {BOARD} SELECT entity, row_number() OVER (ORDER BY adp DESC, entity) AS market_rank FROM board WHERE adp IS NOT NULL) USING (entity)""")
def c06(spark, sf_dir):
    """The draft board: market rows first, then by value, with the blended rank, the cold-start flag and the value against the market."""
    rows = t08(spark, sf_dir).join(t04(spark, sf_dir), "entity").join(t07(spark, sf_dir).select("entity", "blend"), "entity", "left")
    market = global_ordinal(board(spark, sf_dir).where("adp is not null").select("entity", "adp"), "market_rank", F.desc("adp"), F.col("entity"))
    rows = rows.join(t03(spark, sf_dir).select("entity", "cold"), "entity", "left").join(market.select("entity", "market_rank"), "entity", "left")
    return rows.select("entity", "place", "kind", "position", "vor", "blend", "cold", "market_rank", (F.col("market_rank") - F.col("place")).alias("value_vs_market"))


@query("C07", f"SELECT * FROM {_with('W09')} JOIN {_with('W10')} USING (event_id, user_id) JOIN {_with('W11')} USING (event_id, user_id)")
def c07(spark, sf_dir):
    """State history: run length before, time to the next good state, and kind of each event."""
    keys = ["event_id", "user_id"]
    return w09(spark, sf_dir).join(w10(spark, sf_dir), keys).join(w11(spark, sf_dir), keys)


KNOWN = ("signup", "view", "click", "purchase", "error")
STAMP_LIMIT = "TIMESTAMP '2024-02-01'"


@query("C08", f"""WITH e AS (SELECT * FROM events WHERE event_type IN {KNOWN} AND regexp_matches(user_id::VARCHAR, '^[1-9][0-9]*$') AND ts <= {STAMP_LIMIT}), u AS (SELECT DISTINCT user_id FROM e),
a AS (SELECT e.user_id, min_by(event_type, list_position({list(SEVERITY)}, event_type)) AS status, count(*) AS n, max(ts) AS newest FROM {_with('U10')} s JOIN e USING (event_id) WHERE event_type IN {SEVERITY} GROUP BY 1),
r AS (SELECT user_id, count(*) AS refused FROM events WHERE event_id NOT IN (SELECT event_id FROM e) GROUP BY 1)
SELECT user_id, coalesce(status, 'unknown') AS status, coalesce(n, 0) AS n_reports, newest, coalesce(refused, 0) AS refused FROM u LEFT JOIN a USING (user_id) LEFT JOIN r USING (user_id)""")
def c08(spark, sf_dir):
    """Availability: the most restrictive known state of the newest accepted snapshot; users without one are unknown.

    Reports with an unknown label, an unreadable id or a stamp later than the fetch are refused first, and counted.
    """
    rules = {"label": F.col("event_type").isin(*KNOWN), "id": F.col("user_id").cast("string").rlike("^[1-9][0-9]*$"), "stamp": F.col("ts") <= F.expr(STAMP_LIMIT)}
    marked = table(spark, sf_dir, "events").withColumn("broken", failed_rules(rules))
    events = marked.where(F.size("broken") == 0)
    refused = marked.where(F.size("broken") > 0).groupBy("user_id").agg(F.count("*").alias("refused"))
    accepted = u10(spark, sf_dir).select("event_id").join(events, "event_id").where(F.col("event_type").isin(*SEVERITY))
    place = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("event_type"))
    found = accepted.groupBy("user_id").agg(F.min_by("event_type", place).alias("status"), F.count("*").alias("n"), F.max("ts").alias("newest"))
    rows = events.select("user_id").distinct().join(found, "user_id", "left").join(refused, "user_id", "left")
    zero = F.lit(0)
    return rows.select("user_id", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("n", zero).alias("n_reports"), "newest", F.coalesce("refused", zero).alias("refused"))


@query("C09", f"""WITH {FACT}, s AS (SELECT entity, max(grp) AS grp, avg(qty) AS rate, coalesce(var_samp(qty), 0) AS var, least(count(DISTINCT period) / {NEXT[1] - 1}, 1) AS p FROM fact WHERE season = {NEXT[0]} AND period < {NEXT[1]} AND qty IS NOT NULL GROUP BY 1),
e AS (SELECT *, p * rate * {13 - NEXT[1]} AS expected, {13 - NEXT[1]} * (p * (var + rate * rate) - (p * rate) * (p * rate)) AS variance FROM s)
SELECT entity, grp, round(p, 6) AS p_active, round(expected, 6) AS expected, round(sqrt(greatest(variance, 0)), 6) AS deviation, row_number() OVER (PARTITION BY grp ORDER BY round(expected, 6) DESC, entity) AS place FROM e""")
def c09(spark, sf_dir):
    """Rest-of-season totals in closed form: mean p * rate * weeks, variance weeks * (p (var + rate^2) - (p rate)^2)."""
    season, period = NEXT
    weeks = 13 - period
    rows = facts(spark, sf_dir).where((F.col("season") == season) & (F.col("period") < period) & F.col("qty").isNotNull())
    rows = rows.groupBy("entity").agg(F.max("grp").alias("grp"), F.avg("qty").alias("rate"), F.coalesce(F.var_samp("qty"), F.lit(0.0)).alias("var"), F.count_distinct("period").alias("n"))
    p, rate = F.least(F.col("n") / (period - 1), F.lit(1.0)), F.col("rate")
    rows = rows.withColumn("p", p)
    p = F.col("p")
    variance = weeks * (p * (F.col("var") + rate * rate) - (p * rate) * (p * rate))
    rows = rows.select("entity", "grp", F.round("p", 6).alias("p_active"), F.round(p * rate * weeks, 6).alias("expected"), F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), 6).alias("deviation"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("expected"), "entity")).cast("long")
    return rows.withColumn("place", place)


@query("C10", f"SELECT * FROM {_with('M16')} JOIN {_with('T09')} USING (position) JOIN {_with('T10')} USING (position)")
def c10(spark, sf_dir):
    """Market evaluation per position: rank correlation, hit rate and points lost."""
    return m16(spark, sf_dir).join(t09(spark, sf_dir), "position").join(t10(spark, sf_dir), "position")


#: Kinds of reports that a refresh must have features of, and users whose rows another approved run serves.
REQUIRED, SERVED_USERS = ("signup", "view", "click", "purchase"), 5


@query("C11", f"""WITH v AS (SELECT * FROM events WHERE event_type <> 'error' AND value > 1), f AS (SELECT user_id, count(*) AS n, max(ts) AS newest, avg(value) AS mean_value FROM v GROUP BY 1),
gone AS (SELECT unnest({list(REQUIRED)}) AS event_type EXCEPT SELECT event_type FROM v), g AS (SELECT (SELECT count(*) FROM f) >= 0.5 * (SELECT count(DISTINCT user_id) FROM events) AND (SELECT count(*) FROM gone) = 0 AS ok),
served AS (SELECT DISTINCT user_id FROM events WHERE user_id % {SERVED_USERS} = 0), new AS (SELECT user_id FROM f WHERE user_id NOT IN (SELECT user_id FROM served))
SELECT 'loaded' AS step, count(*) AS n FROM events UNION ALL SELECT 'valid', count(*) FROM v UNION ALL SELECT 'rejected', (SELECT count(*) FROM events) - count(*) FROM v
UNION ALL SELECT 'features', count(*) FROM f UNION ALL SELECT 'skipped', count(*) - (SELECT count(*) FROM new) FROM f UNION ALL SELECT 'promoted', CASE WHEN ok THEN (SELECT count(*) FROM new) ELSE 0 END FROM g
UNION ALL SELECT 'served', (SELECT count(*) FROM served) + CASE WHEN ok THEN (SELECT count(*) FROM new) ELSE 0 END FROM g""")
def c11(spark, sf_dir):
    """The weekly refresh as one batch: consume once, validate, build features, upsert what is free, gate, promote; a row per step.

    Staged files are consumed by a checkpointed stream, so a run that is repeated loads nothing twice. Rows that another
    approved run serves are left alone. Features wait under a pending run; if every required kind has rows and half of the
    users are covered, one commit makes them the approved run's, else the served rows stay as they were.
    """
    w = Workspace(spark, "refresh")
    staged = w.save(table(spark, sf_dir, "events"), "staged")
    rules = {"type": F.col("event_type") != "error", "value": F.col("value") > 1}

    def ingest(batch, number):
        valid, rejected = quarantine(batch.persist(), rules, "events")
        valid.write.mode("overwrite").parquet(f"{w.path}/valid/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{w.path}/rejected/batch={number}")
        batch.unpersist()

    for _ in range(2):  # the second run finds nothing new
        run_batches(spark.readStream.schema(staged.schema).parquet(f"{w.path}/staged"), w, "ingest", ingest)
    valid, rejected = (spark.read.parquet(f"{w.path}/{kind}") for kind in ("valid", "rejected"))
    features = valid.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("newest"), F.avg("value").alias("mean_value"))
    features = w.save(features.withColumn("run", F.lit("pending")), "features")
    users = staged.select("user_id").distinct()
    held = VersionedTable(spark, f"{w.path}/served", features.schema, "run")
    held.append(users.where(F.col("user_id") % SERVED_USERS == 0).join(features.limit(0).drop("run"), "user_id", "left").withColumn("run", F.lit("approved")))
    merged, skipped = protected_upsert(held.read(), features, ["user_id"], F.col("run") == "approved")
    skipped = w.save(skipped, "skipped")
    held.replace(["pending"], merged.where("run = 'pending'"))
    need = spark.createDataFrame([(k,) for k in REQUIRED], "event_type string")
    covered = need.join(valid, "event_type", "left_anti").isEmpty() and features.count() >= 0.5 * users.count()
    pending = held.read(values=["pending"]).count()
    if covered:
        promote_run(held, "run", "pending", "approved")
    count = lambda name, df: df.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
    out = count("loaded", staged).unionByName(skipped.select(F.lit("skipped").alias("step"), F.col("skipped").alias("n")))
    for name, df in (("valid", valid), ("rejected", rejected), ("features", features), ("served", held.read(values=["approved"]))):
        out = out.unionByName(count(name, df))
    promoted = spark.createDataFrame([("promoted", pending if covered else 0)], "step string, n long")
    return out.unionByName(promoted)


@query("C12", f"""WITH e AS (WITH {FACT} SELECT entity, season, max(grp) AS grp, avg(qty) AS actual, count(qty) AS n FROM fact GROUP BY ALL), g AS (SELECT a.season AS eval_season, a.entity, a.grp, a.actual, a.n,
 p.previous, avg(h.actual) AS career, max(h.season) AS max_train_season FROM e a LEFT JOIN {_with('M10')} p USING (entity, season) LEFT JOIN e h ON h.entity = a.entity AND h.season < a.season AND h.actual IS NOT NULL GROUP BY ALL)
SELECT eval_season, grp, count(*) FILTER (WHERE actual IS NOT NULL AND previous IS NOT NULL) AS n, round(avg(abs(actual - previous)), 6) AS previous_mae, round(avg(abs(actual - career)), 6) AS career_mae, max(max_train_season) AS max_train_season FROM g GROUP BY ALL""")
def c12(spark, sf_dir):
    """Backtest providers gated by season: a season's actuals beside what was known before it, with the newest season used."""
    season = facts(spark, sf_dir).groupBy("entity", "season").agg(F.max("grp").alias("grp"), F.avg("qty").alias("actual"))
    w = Window.partitionBy("entity").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("actual").isNotNull(), F.col("season"))
    rows = season.select("*", F.avg("actual").over(w).alias("career"), F.max(known).over(w).alias("newest")).join(m10(spark, sf_dir), ["entity", "season"], "left")
    mae = lambda c: F.round(F.avg(F.abs(F.col("actual") - F.col(c))), 6)
    return rows.groupBy(F.col("season").alias("eval_season"), "grp").agg(
        F.count_if(F.col("actual").isNotNull() & F.col("previous").isNotNull()).alias("n"), mae("previous").alias("previous_mae"), mae("career").alias("career_mae"),
        F.max("newest").alias("max_train_season"),
    )
