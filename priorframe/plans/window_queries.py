"""Windows over strictly earlier rows (W), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import average_ranks, exact_quantiles, ordinals, tile
from ..operators.temporal import filtered_form, prior_values, prior_window, run_length, safe_ratio, trailing_mean
from ..sources.tables import Workspace
from .facts import FACT, MONTHS, PLAYS, facts, months, plays, table
from .registry import query

SEASON, ORDER = ("entity", "season"), ("period", "game")
W_SQL = "OVER (PARTITION BY entity, season ORDER BY period, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("W01", f"""WITH {FACT}, kept AS (SELECT *, (lines IS NULL OR lines >= 3) AS keep FROM fact)
SELECT entity, season, period, game, avg(CASE WHEN keep THEN qty END) {W_SQL} AS mean_qty,
  (sum(CASE WHEN keep THEN returned END) {W_SQL})::DOUBLE / nullif(sum(CASE WHEN keep THEN lines END) {W_SQL}, 0) AS return_rate,
  count(CASE WHEN keep THEN 1 END) {W_SQL} AS n_prior FROM kept""")
def w01(spark, sf_dir):
    keep = F.col("lines").isNull() | (F.col("lines") >= 3)
    w = prior_window(SEASON, ORDER)
    when = lambda c: F.when(keep, F.col(c))
    return facts(spark, sf_dir).select(
        "entity", "season", "period", "game", F.avg(when("qty")).over(w).alias("mean_qty"),
        safe_ratio(F.sum(when("returned")).over(w), F.sum(when("lines")).over(w)).alias("return_rate"),
        F.count(F.when(keep, 1)).over(w).alias("n_prior"),
    )


@query("W02", f"""WITH {MONTHS}, t AS (SELECT team, season, period, sum(returned)::BIGINT AS r, sum(lines)::BIGINT AS n FROM months GROUP BY ALL)
SELECT team, season, period, (sum(r) OVER w)::DOUBLE / nullif(sum(n) OVER w, 0) AS rate_before
FROM t WINDOW w AS (PARTITION BY team, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w02(spark, sf_dir, month=None):
    month = months(facts(spark, sf_dir)) if month is None else month
    team = month.groupBy("team", "season", "period").agg(F.sum("returned").alias("r"), F.sum("lines").alias("n"))
    w = prior_window(("team", "season"), ("period",))
    return team.select("team", "season", "period", safe_ratio(F.sum("r").over(w), F.sum("n").over(w)).alias("rate_before"))


@query("W03", f"""WITH {FACT} SELECT entity, season, period, game,
  avg(qty) OVER (PARTITION BY entity, season ORDER BY period, game ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS trailing_rows,
  list_avg(list_slice(list_reverse(list(qty) FILTER (WHERE qty IS NOT NULL) {W_SQL}), 1, 3)) AS trailing_values FROM fact""")
def w03(spark, sf_dir):
    rows = trailing_mean(facts(spark, sf_dir), "qty", 3, SEASON, ORDER, "trailing_rows")
    rows = trailing_mean(rows, "qty", 3, SEASON, ORDER, "trailing_values", skip_null=True)
    return rows.select("entity", "season", "period", "game", "trailing_rows", "trailing_values")


@query("W04", f"""WITH {FACT} SELECT entity, season, period, game,
  lag(qty, 1) OVER w - coalesce(lag(qty, 3) OVER w, lag(qty, 2) OVER w) AS trend
FROM fact WINDOW w AS (PARTITION BY entity, season ORDER BY period, game)""")
def w04(spark, sf_dir):
    w = Window.partitionBy(*SEASON).orderBy(*ORDER)
    trend = F.lag("qty", 1).over(w) - F.coalesce(F.lag("qty", 3).over(w), F.lag("qty", 2).over(w))
    return facts(spark, sf_dir).select("entity", "season", "period", "game", trend.alias("trend"))


@query("W05", f"""WITH {FACT} SELECT entity, season, period, game, CASE WHEN count(qty) {W_SQL} >= 2 THEN
  last_value(qty IGNORE NULLS) {W_SQL} - first_value(qty IGNORE NULLS) {W_SQL} END AS trend FROM fact""")
def w05(spark, sf_dir):
    w = prior_window(SEASON, ORDER)
    trend = F.last("qty", ignorenulls=True).over(w) - F.first("qty", ignorenulls=True).over(w)
    return facts(spark, sf_dir).select("entity", "season", "period", "game", F.when(F.count("qty").over(w) >= 2, trend).alias("trend"))


@query("W06", f"""WITH {FACT} SELECT entity, season, period, game, lag(qty) OVER w AS prior_qty, lag(cents) OVER w AS prior_cents
FROM fact WINDOW w AS (PARTITION BY entity ORDER BY season, period, game)""")
def w06(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("season", *ORDER)
    return facts(spark, sf_dir).select("entity", "season", "period", "game", F.lag("qty").over(w).alias("prior_qty"), F.lag("cents").over(w).alias("prior_cents"))


@query("W07", f"""WITH {FACT} SELECT entity, season, period, game, row_number() OVER w - 1 AS prior_games,
  count(CASE WHEN lines >= 3 THEN 1 END) OVER (PARTITION BY entity ORDER BY season, period, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_active
FROM fact WINDOW w AS (PARTITION BY entity ORDER BY season, period, game)""")
def w07(spark, sf_dir):
    """The shift stays inside the entity: its first row has no earlier rows."""
    w = Window.partitionBy("entity").orderBy("season", *ORDER)
    active = F.count(F.when(F.col("lines") >= 3, 1)).over(prior_window(("entity",), ("season", *ORDER)))
    ordinal = (F.row_number().over(w) - 1).cast("long")
    return facts(spark, sf_dir).select("entity", "season", "period", "game", ordinal.alias("prior_games"), active.alias("prior_active"))


@query("W08", f"""WITH {FACT} SELECT entity, season, period, game, period - 1 - coalesce(max(CASE WHEN lines >= 3 THEN period END) {W_SQL}, 0) AS missed FROM fact""")
def w08(spark, sf_dir):
    last = F.max(F.when(F.col("lines") >= 3, F.col("period"))).over(prior_window(SEASON, ORDER))
    return facts(spark, sf_dir).select("entity", "season", "period", "game", (F.col("period") - 1 - F.coalesce(last, F.lit(0))).alias("missed"))


STATES = "states AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, date_part('day', ts)::BIGINT AS day FROM events)"


def states(spark, sf_dir):
    """Events with a state: an error is the bad one."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("bad"), F.dayofmonth("ts").cast("long").alias("day"))


@query("W09", f"""WITH {STATES}, i AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM states),
r AS (SELECT *, count(CASE WHEN bad THEN 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i)
SELECT event_id, user_id, coalesce(lag(run) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS run_before FROM r""")
def w09(spark, sf_dir):
    return run_length(states(spark, sf_dir), "bad", ("user_id",), ("ts", "event_id"), "run_before").select("event_id", "user_id", "run_before")


W10_SQL = f"""WITH {STATES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM states),
f AS (SELECT *, lead(CASE WHEN NOT bad THEN day END IGNORE NULLS) OVER w AS next_day, lead(CASE WHEN NOT bad THEN rn END IGNORE NULLS) OVER w AS next_rn
 FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CASE WHEN bad THEN CASE WHEN next_day - day > 0 THEN next_day - day ELSE next_rn - rn END END AS time_to_good FROM f"""


@query("W10", W10_SQL)
def w10(spark, sf_dir):
    """Days to the next good state; rows are counted where the days do not grow; null if there is none."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = states(spark, sf_dir).withColumn("rn", F.row_number().over(order).cast("long"))
    good = F.first(F.when(~F.col("bad"), F.struct("day", "rn")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("next", good)
    days = F.col("next.day") - F.col("day")
    wait = F.when(days > 0, days).otherwise(F.col("next.rn") - F.col("rn"))
    return rows.select("event_id", "user_id", F.when(F.col("bad"), wait).alias("time_to_good"))


@query("W11", f"""WITH {STATES}, l AS (SELECT *, coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS before FROM states)
SELECT event_id, user_id, CASE WHEN bad AND NOT before THEN 'start' WHEN bad THEN 'ongoing' WHEN before THEN 'return' ELSE 'active' END AS kind FROM l""")
def w11(spark, sf_dir):
    rows = run_length(states(spark, sf_dir), "bad", ("user_id",), ("ts", "event_id"), "run")
    before = F.col("run") > 0
    kind = F.when(F.col("bad") & ~before, "start").when(F.col("bad"), "ongoing").when(before, "return").otherwise("active")
    return rows.select("event_id", "user_id", kind.alias("kind"))


@query("W12", f"""WITH {MONTHS}, last AS (SELECT team, grp, season, max(period) AS top FROM months GROUP BY ALL),
spine AS (SELECT team, grp, season, unnest(range(1, top + 2)) AS period FROM last),
members AS (SELECT DISTINCT team, grp, season, entity FROM months),
volume AS (SELECT s.team, s.grp, s.season, s.period, m.entity, coalesce(sum(x.qty), 0) AS prior_qty
 FROM spine s JOIN members m USING (team, grp, season) LEFT JOIN months x ON x.entity = m.entity AND x.season = s.season AND x.team = s.team AND x.grp = s.grp AND x.period < s.period GROUP BY ALL)
SELECT team, grp, season, period::BIGINT AS period, entity, row_number() OVER (PARTITION BY team, grp, season, period ORDER BY prior_qty DESC, entity) AS pos_rank FROM volume WHERE prior_qty > 0""")
def w12(spark, sf_dir, month=None):
    """Rank within team and group by what was gathered before each period; ties by id. Unseen entities have no row.

    A running total stands from the period after a row to the entity's next row, and is written out for these periods only.
    """
    month = months(facts(spark, sf_dir)) if month is None else month
    keys = ["team", "grp", "season"]
    own = Window.partitionBy(*keys, "entity").orderBy("period")
    top = F.max("period").over(Window.partitionBy(*keys))
    rows = month.select(*keys, "entity", "period", top.alias("top"), F.sum("qty").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.lead("period").over(own).alias("next"))
    held = F.sequence(F.col("period") + 1, F.coalesce("next", F.col("top") + 1))
    volume = rows.where("total > 0").select(*keys, F.explode(held).alias("period"), "entity", "total")
    rank = F.row_number().over(Window.partitionBy(*keys, "period").orderBy(F.desc("total"), "entity")).cast("long")
    return volume.select("team", "grp", "season", "period", "entity", rank.alias("pos_rank"))


@query("W13", f"""WITH {PLAYS}, c AS (SELECT defender, season, period, count(*) AS n, count(*) FILTER (WHERE location = 'R') AS r FROM plays GROUP BY ALL),
t AS (SELECT *, sum(n) OVER w AS before, sum(r) OVER w AS hits FROM c WINDOW w AS (PARTITION BY defender ORDER BY season, period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT defender, season, period, CASE WHEN before >= 50 THEN hits::DOUBLE / before END AS tendency FROM t""")
def w13(spark, sf_dir):
    counts = plays(spark, sf_dir).groupBy("defender", "season", "period").agg(F.count("*").alias("n"), F.count_if(F.col("location") == "R").alias("r"))
    w = prior_window(("defender",), ("season", "period"))
    n, r = F.sum("n").over(w), F.sum("r").over(w)
    return counts.select("defender", "season", "period", F.when(n >= 50, r / n).alias("tendency"))


@query("W14", f"""WITH {FACT} SELECT entity, season, period, game, last_value(CASE WHEN returned > 0 THEN qty END IGNORE NULLS) {W_SQL} AS carried_qty,
 last_value(CASE WHEN returned > 0 THEN lines END IGNORE NULLS) {W_SQL} AS carried_lines FROM fact""")
def w14(spark, sf_dir):
    tuple_ = F.last(F.when(F.col("returned") > 0, F.struct("qty", "lines")), ignorenulls=True).over(prior_window(SEASON, ORDER))
    rows = facts(spark, sf_dir).withColumn("carried", tuple_)
    return rows.select("entity", "season", "period", "game", F.col("carried.qty").alias("carried_qty"), F.col("carried.lines").alias("carried_lines"))


@query("W15", f"""WITH {MONTHS}, t AS (SELECT team, season, period, sum(lines)::BIGINT AS plays, sum(returned)::BIGINT AS passes, sum(games)::BIGINT AS games FROM months GROUP BY ALL),
p AS (SELECT team, season, period, (sum(plays) OVER w)::DOUBLE / nullif(sum(games) OVER w, 0) AS pace, (sum(passes) OVER w)::DOUBLE / nullif(sum(plays) OVER w, 0) AS pass_rate
 FROM t WINDOW w AS (PARTITION BY team, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT *, pace * pass_rate AS pass_volume, pace * (1 - pass_rate) AS rush_volume FROM p""")
def w15(spark, sf_dir, month=None):
    month = months(facts(spark, sf_dir)) if month is None else month
    team = month.groupBy("team", "season", "period").agg(
        F.sum("lines").alias("plays"), F.sum("returned").alias("passes"), F.sum("games").alias("games")
    )
    w = prior_window(("team", "season"), ("period",))
    total = lambda c: F.sum(c).over(w)
    rows = team.select(
        "team", "season", "period", safe_ratio(total("plays"), total("games")).alias("pace"), safe_ratio(total("passes"), total("plays")).alias("pass_rate")
    )
    return rows.select("*", (F.col("pace") * F.col("pass_rate")).alias("pass_volume"), (F.col("pace") * (1 - F.col("pass_rate"))).alias("rush_volume"))


@query("W16", f"""WITH {FACT} SELECT game, season, grp, r AS avg_rank, r / count(*) OVER (PARTITION BY season, grp) AS pct FROM (
 SELECT game, season, grp, rank() OVER (PARTITION BY season, grp ORDER BY qty DESC) + (count(*) OVER (PARTITION BY season, grp, qty) - 1) / 2.0::DOUBLE AS r FROM fact WHERE qty IS NOT NULL)""")
def w16(spark, sf_dir):
    rows = facts(spark, sf_dir).where("qty is not null")
    rows = average_ranks(rows.select("game", "season", "grp", "qty"), ("season", "grp"), "qty", "avg_rank", descending=True, total="n")
    return rows.select("game", "season", "grp", "avg_rank", (F.col("avg_rank") / F.col("n")).alias("pct"))


@query("W17", f"""WITH {FACT} SELECT game, season, ntile(10) OVER (PARTITION BY season ORDER BY qty, game)::BIGINT AS bucket FROM fact WHERE qty IS NOT NULL""")
def w17(spark, sf_dir):
    rows = facts(spark, sf_dir).where("qty is not null").select("game", "season", "qty")
    return ordinals(rows, ("season",), ["qty", "game"], "place", "n").select("game", "season", tile("place", "n", 10).alias("bucket"))


@query("W18", """WITH e AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'purchase' THEN round(value * 100)::BIGINT WHEN event_type = 'error' THEN -round(value * 100)::BIGINT ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS equity FROM events),
p AS (SELECT e.*, max(equity) OVER (PARTITION BY e.user_id ORDER BY ts, e.event_id) AS peak FROM e JOIN events v USING (event_id))
SELECT user_id, event_id, equity, peak, equity - peak AS drawdown FROM p""")
def w18(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    gain = F.when(F.col("event_type") == "purchase", cents).when(F.col("event_type") == "error", -cents).otherwise(F.lit(0).cast("long"))
    rows = table(spark, sf_dir, "events").withColumn("equity", F.sum(gain).over(w)).withColumn("peak", F.max("equity").over(w))
    return rows.select("user_id", "event_id", "equity", "peak", (F.col("equity") - F.col("peak")).alias("drawdown"))


@query("W19", f"""WITH {PLAYS}, e AS (SELECT receiver, defender, count(*) AS n FROM plays GROUP BY ALL)
SELECT receiver, defender, n, n = max(n) OVER (PARTITION BY receiver) AS is_primary, n::DOUBLE / sum(n) OVER (PARTITION BY receiver) AS share FROM e""")
def w19(spark, sf_dir):
    edges = plays(spark, sf_dir).groupBy("receiver", "defender").agg(F.count("*").alias("n"))
    w = Window.partitionBy("receiver")
    return edges.select("receiver", "defender", "n", (F.col("n") == F.max("n").over(w)).alias("is_primary"), (F.col("n") / F.sum("n").over(w)).alias("share"))


#: Process variance, observation variance below two values, variance of the prior.
KALMAN = (1.0, 100.0, 1000.0)
#: The prior mean of each group; a group without one starts from zero.
PRIORS = {"BUILDING": 70.0, "AUTOMOBILE": 80.0, "MACHINERY": 90.0, "HOUSEHOLD": 100.0}


def prior_of(grp="grp"):
    out = F.lit(0.0)
    for name, value in PRIORS.items():
        out = F.when(F.col(grp) == name, value).otherwise(out)
    return out


def _form(spark, sf_dir):
    rows = facts(spark, sf_dir).select("entity", "season", "period", "game", "grp", "qty")
    return filtered_form(rows, SEASON, ORDER, "qty", prior_of(), *KALMAN, "form")


PRIOR_SQL = "CASE grp " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in PRIORS.items()) + " ELSE 0::DOUBLE END"
KALMAN_SQL = f"""WITH RECURSIVE {FACT}, p AS (SELECT *, {PRIOR_SQL} AS x0 FROM fact), seen AS (SELECT entity, season, period, game, x0, coalesce(list(coalesce(qty, x0)) {W_SQL}, []) AS xs,
 CASE WHEN count(qty) {W_SQL} >= 2 THEN greatest(var_samp(qty) {W_SQL}, 1e-6) ELSE 100.0::DOUBLE END AS r FROM p),
f(game, k, m, v) AS (SELECT game, 0, x0, 1000.0::DOUBLE FROM seen UNION ALL
 SELECT f.game, k + 1, m + (v + 1) / (v + 1 + r) * (xs[k + 1] - m), (1 - (v + 1) / (v + 1 + r)) * (v + 1) FROM f JOIN seen USING (game) WHERE k < len(xs))
"""


@query("W20", KALMAN_SQL + """SELECT s.entity, s.season, s.period, s.game, round(f.m, 6) AS form, round(f.v, 6) AS form_var
FROM seen s JOIN f ON f.game = s.game AND f.k = len(s.xs)""")
def w20(spark, sf_dir):
    """Filtered level before each game, from the group's prior; no earlier game, the prior."""
    return _form(spark, sf_dir).select(
        "entity", "season", "period", "game", F.round("form.mean", 6).alias("form"), F.round("form.var", 6).alias("form_var")
    )


@query("W21", KALMAN_SQL + """SELECT s.entity, s.season, s.period, s.game, round(f.m, 6) AS form,
 row_number() OVER (PARTITION BY s.entity, s.season ORDER BY s.period, s.game) AS step FROM seen s JOIN f ON f.game = s.game AND f.k = len(s.xs)""")
def w21(spark, sf_dir):
    """The whole trajectory of an entity's season, in order."""
    step = F.row_number().over(Window.partitionBy(*SEASON).orderBy(*ORDER)).cast("long")
    return _form(spark, sf_dir).select("entity", "season", "period", "game", F.round("form.mean", 6).alias("form"), step.alias("step"))


@query("W22", f"""WITH {FACT} SELECT game, (season - (SELECT min(season) FROM fact)) * 12 + period - 1 AS time_idx,
 coalesce(qty, (SELECT median(qty) FROM fact)) AS filled FROM fact""")
def w22(spark, sf_dir):
    rows = facts(spark, sf_dir)
    rows = Workspace(spark, "timeline").save(rows.select("game", "season", "period", "qty"), "rows")
    middle = exact_quantiles(rows.select("qty"), (), "qty", (0.5,)).select(F.col("q")[0].alias("middle"))
    first = rows.agg(F.min("season").alias("first_season"))
    rows = rows.crossJoin(F.broadcast(first)).join(F.broadcast(middle), how="left")  # one row each, or none without values
    return rows.select("game", ((F.col("season") - F.col("first_season")) * 12 + F.col("period") - 1).alias("time_idx"), F.coalesce("qty", "middle").alias("filled"))
