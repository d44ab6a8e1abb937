"""Aggregations (A), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.aggregate import mode_per_key, ratio, recency_mean, share_of, shrunk_means
from ..operators.ordered import exact_quantiles, null_safe_join, ordinals, tile
from ..operators.temporal import prior_values, prior_window
from ..sources.tables import Workspace
from .facts import FACT, MONTHS, PLAYS, facts, months, plays, table
from .join_queries import ROUND, team_rounds
from .registry import query


@query("A01", f"""WITH {PLAYS} SELECT receiver, game, count(*) AS targets, count(*) FILTER (WHERE location = 'R') AS caught, sum(yards) AS yards,
 count(*) FILTER (WHERE disc >= 8) AS deep, CASE WHEN count(*) FILTER (WHERE location = 'R') > 0 THEN sum(yards) FILTER (WHERE location = 'R') / count(*) FILTER (WHERE location = 'R') END AS yards_per_catch FROM plays GROUP BY ALL""")
def a01(spark, sf_dir):
    caught = F.col("location") == "R"
    return plays(spark, sf_dir).groupBy("receiver", "game").agg(
        F.count("*").alias("targets"), F.count_if(caught).alias("caught"), F.sum("yards").alias("yards"), F.count_if(F.col("disc") >= 8).alias("deep"),
        ratio(F.sum(F.when(caught, F.col("yards"))), F.count_if(caught)).alias("yards_per_catch"),
    )


@query("A02", f"""WITH {PLAYS}, a AS (SELECT receiver, team, season, period, count(*) AS targets, sum(yards) AS yards, count(*) FILTER (WHERE zone = 'F') AS red FROM plays GROUP BY ALL)
SELECT receiver, team, season, period, targets / sum(targets) OVER w AS target_share, CASE WHEN sum(yards) OVER w > 0 THEN yards / sum(yards) OVER w END AS yard_share,
 CASE WHEN sum(red) OVER w > 0 THEN red / sum(red) OVER w END AS red_share FROM a WINDOW w AS (PARTITION BY team, season, period)""")
def a02(spark, sf_dir):
    sums = plays(spark, sf_dir).groupBy("receiver", "team", "season", "period").agg(
        F.count("*").alias("targets"), F.sum("yards").alias("yards"), F.count_if(F.col("zone") == "F").alias("red")
    )
    keys = ("team", "season", "period")
    share = lambda c, n: share_of(c, keys).alias(n)
    return sums.select("receiver", *keys, share("targets", "target_share"), share("yards", "yard_share"), share("red", "red_share"))


@query("A03", f"""WITH {PLAYS} SELECT defender, game, count(*) AS attempts, sum(yards) AS yards, max(yards) AS longest, count(*) FILTER (WHERE yards >= 25) AS explosive,
 sum(yards) / count(*) AS per_attempt FROM plays GROUP BY ALL""")
def a03(spark, sf_dir):
    return plays(spark, sf_dir).groupBy("defender", "game").agg(
        F.count("*").alias("attempts"), F.sum("yards").alias("yards"), F.max("yards").alias("longest"), F.count_if(F.col("yards") >= 25).alias("explosive"),
        (F.sum("yards") / F.count("*")).alias("per_attempt"),
    )


@query("A04", f"WITH {PLAYS} SELECT team, season, period, count(*) FILTER (WHERE disc = 0) / count(*) AS pressure_rate, count(*) FILTER (WHERE disc >= 9) / count(*) AS hit_rate FROM plays GROUP BY ALL")
def a04(spark, sf_dir):
    rate = lambda c: F.count_if(c) / F.count("*")
    return plays(spark, sf_dir).groupBy("team", "season", "period").agg(rate(F.col("disc") == 0).alias("pressure_rate"), rate(F.col("disc") >= 9).alias("hit_rate"))


@query("A05", f"""WITH {PLAYS}, u AS (SELECT receiver AS entity, yards, 1 AS n FROM plays WHERE location = 'R' UNION ALL SELECT defender, -yards, 1 FROM plays WHERE location = 'A')
SELECT entity, sum(yards) / sum(n) AS per_play, sum(n)::BIGINT AS n FROM u GROUP BY entity""")
def a05(spark, sf_dir):
    """Two aggregate sets added: each is summed first, so the union stays small."""
    rows = plays(spark, sf_dir)
    part = lambda k, who, sign: rows.where(F.col("location") == k).groupBy(F.col(who).alias("entity")).agg((sign * F.sum("yards")).alias("y"), F.count("*").alias("n"))
    both = part("R", "receiver", 1).unionByName(part("A", "defender", -1))
    return both.groupBy("entity").agg((F.sum("y") / F.sum("n")).alias("per_play"), F.sum("n").alias("n"))


@query("A06", f"""WITH {PLAYS}, u AS (SELECT receiver, unnest([defender, part]) AS other FROM plays), e AS (SELECT receiver, other, count(*) AS n FROM u GROUP BY ALL)
SELECT receiver, other, n, n / sum(n) OVER (PARTITION BY receiver) AS share, n = max(n) OVER (PARTITION BY receiver) AS is_max FROM e""")
def a06(spark, sf_dir):
    edges = plays(spark, sf_dir).unpivot(["receiver"], ["defender", "part"], "role", "other").groupBy("receiver", "other").agg(F.count("*").alias("n"))
    return edges.select("receiver", "other", "n", share_of("n", ("receiver",)).alias("share"), (F.col("n") == F.max("n").over(Window.partitionBy("receiver"))).alias("is_max"))


@query("A07", """WITH f AS (SELECT l_orderkey AS game, l_linenumber, CASE WHEN l_linestatus = 'F' THEN l_tax > 0.04 END AS is_drop FROM lineitem)
SELECT game, count(*) FILTER (WHERE coalesce(is_drop, false)) AS drops, count(*) AS n FROM f GROUP BY game""")
def a07(spark, sf_dir):
    flag = F.when(F.col("l_linestatus") == "F", F.col("l_tax") > 0.04)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(F.count_if(F.coalesce(flag, F.lit(False))).alias("drops"), F.count("*").alias("n"))


@query("A08", f"""WITH {PLAYS}, a AS (SELECT receiver, count(*) FILTER (WHERE location = 'R') / nullif(count(*) FILTER (WHERE zone = 'F'), 0) AS first_rate, count(*) FILTER (WHERE location = 'A') / count(*) AS second_rate FROM plays GROUP BY 1)
SELECT receiver, coalesce(first_rate, second_rate) AS rate FROM a""")
def a08(spark, sf_dir):
    n = lambda c, v: F.count_if(F.col(c) == v)
    preferred = ratio(n("location", "R"), n("zone", "F"))
    return plays(spark, sf_dir).groupBy("receiver").agg(F.coalesce(preferred, n("location", "A") / F.count("*")).alias("rate"))


@query("A09", """WITH x AS (SELECT c_nationkey::BIGINT AS team, unnest(string_split(regexp_replace(c_name || ';' || c_mktsegment, '\\s+', '', 'g'), ';')) AS token FROM customer)
SELECT team, token, count(*) AS n FROM x WHERE token <> '' GROUP BY ALL""")
def a09(spark, sf_dir):
    """A separated list per row, exploded and counted over the whole table."""
    listed = F.regexp_replace(F.concat_ws(";", "c_name", "c_mktsegment"), r"\s+", "")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("team"), F.explode(F.split(listed, ";")).alias("token"))
    return rows.where("token <> ''").groupBy("team", "token").agg(F.count("*").alias("n"))


@query("A10", f"WITH {FACT}, g AS (SELECT team, season, game, sum(qty) AS qty FROM fact GROUP BY ALL) SELECT team, season, avg(qty) AS per_game, count(*) AS games FROM g GROUP BY ALL")
def a10(spark, sf_dir):
    game = facts(spark, sf_dir).groupBy("team", "season", "game").agg(F.sum("qty").alias("qty"))
    return game.groupBy("team", "season").agg(F.avg("qty").alias("per_game"), F.count("*").alias("games"))


@query("A11", f"""WITH {PLAYS}, g AS (SELECT opponent, location, season, period, game, sum(yards) AS yards FROM plays GROUP BY ALL),
p AS (SELECT opponent, location, season, period, sum(yards) AS s, count(*) AS n FROM g GROUP BY ALL)
SELECT opponent, location, season, period, sum(s) OVER w / sum(n) OVER w AS allowed FROM p WINDOW w AS (PARTITION BY opponent, location, season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def a11(spark, sf_dir):
    """Allowed per game, games summed first, over strictly earlier periods."""
    game = plays(spark, sf_dir).groupBy("opponent", "location", "season", "period", "game").agg(F.sum("yards").alias("y"))
    period = game.groupBy("opponent", "location", "season", "period").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    w = prior_window(("opponent", "location", "season"), ("period",))
    return period.select("opponent", "location", "season", "period", ratio(F.sum("s").over(w), F.sum("n").over(w)).alias("allowed"))


@query("A12", f"""WITH {MONTHS}, top AS (SELECT season, max(period) AS top FROM months GROUP BY 1), spine AS (SELECT season, unnest(range(1, top + 2)) AS period FROM top),
m AS (SELECT s.season, s.period, x.grp, x.entity, sum(x.qty) AS s, count(x.qty) AS n FROM spine s JOIN months x ON x.season = s.season AND x.period < s.period GROUP BY ALL)
SELECT season, period, grp, round(avg(s / n) + 1e-9, 6) AS league_mean FROM m WHERE n > 0 GROUP BY ALL""")
def a12(spark, sf_dir, month=None):
    """Mean of entities' earlier means per period; entities without a row in a period still count.

    An entity's mean changes after its rows only: the changes are summed up per period and group, and added up over the
    periods of a season.
    """
    rows = months(facts(spark, sf_dir)) if month is None else month
    own = Window.partitionBy("season", "grp", "entity").orderBy("period")
    rows = rows.select("season", "grp", "entity", "period", F.avg("qty").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("mean"))
    before = F.lag("mean").over(own)
    # means are added as decimals, so that a mean that goes takes away what it brought
    exact = lambda c: F.coalesce(c.cast("decimal(30,14)"), F.lit(0))
    there = lambda c: c.isNotNull().cast("int")
    moved = rows.select("season", "grp", (F.col("period") + 1).alias("period"), (exact(F.col("mean")) - exact(before)).alias("d"), (there(F.col("mean")) - there(before)).alias("n"))
    steps = moved.groupBy("season", "grp", "period").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    top = steps.groupBy("season").agg(F.max("period").alias("top"))
    spine = steps.select("season", "grp").distinct().join(F.broadcast(top), "season").select("season", "grp", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))).alias("period"))
    upto = Window.partitionBy("season", "grp").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    total = spine.join(steps, ["season", "grp", "period"], "left").select("season", "period", "grp", F.sum("d").over(upto).alias("d"), F.sum("n").over(upto).alias("n"))
    return total.where("n > 0").select("season", "period", "grp", F.round(F.col("d").cast("double") / F.col("n") + 1e-9, 6).alias("league_mean"))


@query("A13", f"""WITH {MONTHS}, p AS (SELECT season, period, sum(qty) AS s, count(DISTINCT team) AS n FROM months GROUP BY ALL)
SELECT season, period, sum(s) OVER w / sum(n) OVER w AS mean_before FROM p WINDOW w AS (PARTITION BY season ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def a13(spark, sf_dir, month=None):
    month = months(facts(spark, sf_dir)) if month is None else month
    rows = month.groupBy("season", "period").agg(F.sum("qty").alias("s"), F.count_distinct("team").alias("n"))
    w = prior_window(("season",), ("period",))
    return rows.select("season", "period", ratio(F.sum("s").over(w), F.sum("n").over(w)).alias("mean_before"))


@query("A14", """WITH c AS (SELECT s_nationkey::BIGINT AS team, nullif(l_returnflag, 'N') AS roof, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'N' GROUP BY ALL),
m AS (SELECT team, roof FROM c QUALIFY row_number() OVER (PARTITION BY team ORDER BY n DESC, roof) = 1)
SELECT l_orderkey AS game, l_linenumber::BIGINT AS play, coalesce(nullif(l_returnflag, 'N'), m.roof) AS roof FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN m ON m.team = s_nationkey""")
def a14(spark, sf_dir):
    """Missing values filled with the key's mode; ties to the smaller value."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).select(
        F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play"), F.col("s_nationkey").alias("team"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("roof"),
    )
    modes = mode_per_key(rows, ["team"], "roof").withColumnRenamed("roof", "mode")
    return rows.join(modes, "team", "left").select("game", "play", F.coalesce("roof", "mode").alias("roof"))


@query("A15", """SELECT l_partkey AS part, avg(l_linenumber)::DOUBLE AS mean_pick, count(DISTINCT l_orderkey) AS drafts, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS first_owner FROM lineitem GROUP BY 1""")
def a15(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.avg("l_linenumber").alias("mean_pick"), F.count_distinct("l_orderkey").alias("drafts"),
        F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first_owner"),
    )


@query("A16", f"WITH {FACT} SELECT entity, season, sum(qty) AS qty, max(grp) AS grp FROM fact GROUP BY entity, season HAVING count(*) >= 2")
def a16(spark, sf_dir):
    rows = facts(spark, sf_dir).groupBy("entity", "season").agg(F.sum("qty").alias("qty"), F.max("grp").alias("grp"), F.count("*").alias("n"))
    return rows.where("n >= 2").drop("n")


@query("A17", f"WITH {FACT} SELECT entity, round(sum(pow(0.7, 2001 - season) * qty) / sum(CASE WHEN qty IS NOT NULL THEN pow(0.7, 2001 - season) END), 6) AS weighted FROM fact GROUP BY entity")
def a17(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("entity").agg(F.round(recency_mean("qty", 2001 - F.col("season"), 0.7), 6).alias("weighted"))


@query("A18", f"""WITH {FACT}, c AS (SELECT grp, team, season, sum(qty) AS total, count(qty) AS n FROM fact GROUP BY ALL),
p AS (SELECT *, sum(total) OVER (PARTITION BY grp, season) / sum(n) OVER (PARTITION BY grp, season) AS prior FROM c)
SELECT grp, team, season, n, prior, total / nullif(n, 0) AS mean, coalesce(n / (n + 8.0::DOUBLE) * (total / nullif(n, 0)) + (1 - n / (n + 8.0::DOUBLE)) * prior, prior) AS shrunk FROM p""")
def a18(spark, sf_dir):
    return shrunk_means(facts(spark, sf_dir), ("grp", "team", "season"), ("grp", "season"), "qty", 8.0)


STATE_SQL = "floor(yards / 10)::BIGINT AS field, CASE WHEN disc < 3 THEN 'low' WHEN disc < 7 THEN 'mid' ELSE 'high' END AS score"


@query("A19", f"""WITH {PLAYS}, s AS (SELECT *, {STATE_SQL} FROM plays), g AS (SELECT stddev_samp(yards) AS sd FROM s)
SELECT field, score, count(*) AS n, round(avg(yards), 6) AS mean, round(coalesce(stddev_samp(yards), (SELECT sd FROM g)), 6) AS std, count(*) FILTER (WHERE location = 'R') / count(*) AS event_rate FROM s GROUP BY ALL
UNION ALL SELECT field, 'all', count(*), round(avg(yards), 6), round(coalesce(stddev_samp(yards), (SELECT sd FROM g)), 6), count(*) FILTER (WHERE location = 'R') / count(*) FROM s GROUP BY ALL""")
def a19(spark, sf_dir):
    """Transition table over bucketed states, coarse and fine from one scan."""
    score = F.when(F.col("disc") < 3, "low").when(F.col("disc") < 7, "mid").otherwise("high")
    rows = plays(spark, sf_dir).withColumn("field", F.floor(F.col("yards") / 10)).withColumn("score", score)
    overall = rows.agg(F.stddev_samp("yards").alias("overall"))
    cells = rows.groupingSets([["field", "score"], ["field"]], "field", "score").agg(
        F.count("*").alias("n"), F.avg("yards").alias("mean"), F.stddev_samp("yards").alias("std"), (F.count_if(F.col("location") == "R") / F.count("*")).alias("event_rate"),
    )
    std = F.round(F.coalesce("std", "overall"), 6).alias("std")
    return cells.crossJoin(F.broadcast(overall)).select("field", F.coalesce("score", F.lit("all")).alias("score"), "n", F.round("mean", 6).alias("mean"), std, "event_rate")


@query("A20", f"WITH {PLAYS}, s AS (SELECT *, {STATE_SQL} FROM plays), c AS (SELECT field, score, count(*) AS n, avg(yards) AS p FROM s GROUP BY ALL), f AS (SELECT field, sum(p * n) / sum(n) AS refit FROM c GROUP BY 1), r AS (SELECT field, avg(yards) AS raw FROM s GROUP BY 1) SELECT field, round(refit, 6) AS refit, round(raw, 6) AS raw, abs(refit - raw) < 1e-6 AS agrees FROM f JOIN r USING (field)")
def a20(spark, sf_dir):
    """Count-weighted re-aggregation of the fitted cells against the raw rates."""
    score = F.when(F.col("disc") < 3, "low").when(F.col("disc") < 7, "mid").otherwise("high")
    rows = plays(spark, sf_dir).withColumn("field", F.floor(F.col("yards") / 10)).withColumn("score", score)
    cells = rows.groupBy("field", "score").agg(F.count("*").alias("n"), F.avg("yards").alias("p"))
    refit = cells.groupBy("field").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("refit"))
    raw = rows.groupBy("field").agg(F.avg("yards").alias("raw"))
    both = refit.join(raw, "field")
    return both.select("field", F.round("refit", 6).alias("refit"), F.round("raw", 6).alias("raw"), (F.abs(F.col("refit") - F.col("raw")) < 1e-6).alias("agrees"))


@query("A21", f"""WITH {FACT}, d AS (SELECT *, min(season) OVER (PARTITION BY entity) AS debut FROM fact), m AS (SELECT grp, avg(qty) AS qty, avg(lines) AS lines, avg(returned) AS returned FROM d WHERE season = debut GROUP BY grp),
u AS (UNPIVOT m ON qty, lines, returned INTO NAME stat VALUE v)
SELECT grp, stat, round(CASE WHEN v < 0.95 * max(v) OVER (PARTITION BY stat) THEN 0 ELSE greatest(v, 0.1) END, 6) AS prior FROM u""")
def a21(spark, sf_dir):
    """Means of debut seasons per group, floored; values far below the statistic's peak are noise."""
    rows = facts(spark, sf_dir).withColumn("debut", F.min("season").over(Window.partitionBy("entity"))).where("season = debut")
    means = rows.groupBy("grp").agg(*(F.avg(c).alias(c) for c in ("qty", "lines", "returned")))
    long = means.unpivot(["grp"], ["qty", "lines", "returned"], "stat", "v")
    peak = F.max("v").over(Window.partitionBy("stat"))
    return long.select("grp", "stat", F.round(F.when(F.col("v") < 0.95 * peak, 0.0).otherwise(F.greatest("v", F.lit(0.1))), 6).alias("prior"))


@query("A22", f"""WITH {FACT}, a AS (SELECT team, grp, entity, sum(qty) AS q FROM fact WHERE season = 1999 GROUP BY ALL)
SELECT team, grp, coalesce(sum(q) FILTER (WHERE entity NOT IN (SELECT entity FROM fact WHERE season = 2000)), 0) / nullif(sum(q), 0) AS vacated FROM a GROUP BY ALL""")
def a22(spark, sf_dir):
    rows = facts(spark, sf_dir)
    prior = rows.where("season = 1999").groupBy("team", "grp", "entity").agg(F.sum("qty").alias("q"))
    still = rows.where("season = 2000").select("entity", F.lit(True).alias("still")).distinct()
    marked = prior.join(still, "entity", "left")
    gone = F.coalesce(F.sum(F.when(F.col("still").isNull(), F.col("q"))), F.lit(0.0))
    return marked.groupBy("team", "grp").agg(ratio(gone, F.sum("q")).alias("vacated"))


@query("A23", f"""WITH {FACT}, e AS (SELECT entity, any_value(grp) AS grp, sum(qty) AS total, count(*) AS games FROM fact GROUP BY entity HAVING sum(qty) IS NOT NULL),
b AS (SELECT *, ntile(4) OVER (ORDER BY total, entity)::BIGINT AS bin FROM e)
SELECT coalesce(grp, '*') AS grp, coalesce(bin, 0) AS bin, sum(total) / sum(games) AS rate, count(*) AS n FROM b GROUP BY GROUPING SETS ((grp, bin), (bin), ())""")
def a23(spark, sf_dir):
    """Curve by group and quantile bin, by bin, and overall, from one aggregation; bins by exact cut ranks."""
    rows = facts(spark, sf_dir).groupBy("entity", "grp").agg(F.sum("qty").alias("total"), F.count("*").alias("games")).where("total is not null")
    binned = ordinals(rows, (), ["total", "entity"], "place", "all").withColumn("bin", tile("place", "all", 4))
    cells = binned.groupingSets([["grp", "bin"], ["bin"], []], "grp", "bin").agg((F.sum("total") / F.sum("games")).alias("rate"), F.count("*").alias("n"))
    return cells.select(F.coalesce("grp", F.lit("*")).alias("grp"), F.coalesce("bin", F.lit(0).cast("long")).alias("bin"), "rate", "n")


@query("A24", f"""WITH {FACT}, s0 AS (SELECT entity, season, avg(qty) AS rate, count(qty) AS n FROM fact GROUP BY ALL), s AS (SELECT *, season - min(season) OVER (PARTITION BY entity) AS age FROM s0),
o AS (SELECT b.age, b.rate / a.rate AS r FROM s a JOIN s b ON a.entity = b.entity AND b.season = a.season + 1 WHERE a.n >= 2 AND b.n >= 2 AND a.rate > 0 AND b.rate / a.rate BETWEEN 0.25 AND 4)
SELECT age, count(*) AS n, round(avg(r), 6) AS curve FROM o GROUP BY age HAVING count(*) >= 5""")
def a24(spark, sf_dir):
    season = facts(spark, sf_dir).groupBy("entity", "season").agg(F.avg("qty").alias("rate"), F.count("qty").alias("n"))
    season = season.withColumn("age", F.col("season") - F.min("season").over(Window.partitionBy("entity")))
    w = Window.partitionBy("entity").orderBy("season")
    before = F.lag(F.struct("season", "rate", "n")).over(w)
    rows = season.withColumn("before", before).where("before.season = season - 1 and before.n >= 2 and n >= 2 and before.rate > 0")
    rows = rows.withColumn("r", F.col("rate") / F.col("before.rate")).where(F.col("r").between(0.25, 4))
    return rows.groupBy("age").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("curve")).where("n >= 5")


@query("A25", f"""WITH {FACT}, c AS (SELECT entity, season, count(*) FILTER (WHERE lines >= 2) AS games FROM fact GROUP BY ALL), f AS (SELECT entity, min(season) AS entry FROM fact GROUP BY 1),
g AS (SELECT f.entity, w.lag, w.w, coalesce(c.games, 0) AS games FROM f JOIN (VALUES (1, 5), (2, 4), (3, 3)) w(lag, w) ON 2001 - w.lag >= f.entry LEFT JOIN c ON c.entity = f.entity AND c.season = 2001 - w.lag),
m AS (SELECT sum(w * games)::DOUBLE / sum(w) AS league FROM g)
SELECT entity, (sum(w * games) + 6 * (SELECT league FROM m)) / (sum(w) + 6) AS expected FROM g GROUP BY entity""")
def a25(spark, sf_dir):
    """Weighted games of three earlier seasons, an opportunity only after entry, shrunk to the league."""
    rows = facts(spark, sf_dir)
    games = rows.groupBy("entity", "season").agg(F.count_if(F.col("lines") >= 2).alias("games"))
    entry = rows.groupBy("entity").agg(F.min("season").alias("entry"))
    lags = F.explode(F.array(*(F.struct(F.lit(2001 - k).cast("long").alias("season"), F.lit(w).alias("w")) for k, w in ((1, 5), (2, 4), (3, 3)))))
    grid = entry.select("entity", "entry", lags.alias("lag")).select("entity", "entry", "lag.*").where("season >= entry")
    filled = grid.join(games, ["entity", "season"], "left").withColumn("games", F.coalesce("games", F.lit(0)))
    sums = filled.groupBy("entity").agg(F.sum(F.col("w") * F.col("games")).alias("wg"), F.sum("w").alias("w"))
    league = sums.agg((F.sum("wg") / F.sum("w")).alias("league"))
    return sums.crossJoin(F.broadcast(league)).select("entity", ((F.col("wg") + 6 * F.col("league")) / (F.col("w") + 6)).alias("expected"))


@query("A26", f"""WITH {FACT}, c AS (SELECT entity, season, count(*) AS games FROM fact GROUP BY ALL), q AS (SELECT avg(coalesce(b.games, 0)) AS anchor FROM c a LEFT JOIN c b ON b.entity = a.entity AND b.season = 2000 WHERE a.season = 1999 AND a.games >= 3),
p AS (SELECT entity, games::DOUBLE AS projected FROM c WHERE season = 2000)
SELECT entity, projected * (SELECT anchor FROM q) / (SELECT avg(projected) FROM p) AS calibrated FROM p""")
def a26(spark, sf_dir):
    """Projections scaled to the mean of entities that qualified the season before."""
    games = facts(spark, sf_dir).groupBy("entity", "season").agg(F.count("*").alias("games"))
    qualified = games.where("season = 1999 and games >= 3").select("entity")
    now = games.where("season = 2000").select("entity", F.col("games").alias("projected"))
    anchor = qualified.join(now, "entity", "left").agg(F.avg(F.coalesce("projected", F.lit(0))).alias("anchor"))
    scale = anchor.crossJoin(now.agg(F.avg("projected").alias("mean")))
    return now.crossJoin(F.broadcast(scale)).select("entity", (F.col("projected") * F.col("anchor") / F.col("mean")).alias("calibrated"))


@query("A27", """WITH d AS (SELECT l_suppkey AS owner, l_orderkey AS draft, l_returnflag AS position, min(l_linenumber) AS first_pick, count(*) AS n, count(*) FILTER (WHERE l_linenumber <= 2) AS early FROM lineitem GROUP BY ALL),
f AS (SELECT owner, avg(first_pick) FILTER (WHERE position = 'R') AS first_r, sum(n)::BIGINT AS picks, sum(early) / sum(n) AS early_share, count(DISTINCT draft) AS drafts FROM d GROUP BY owner),
l AS (SELECT avg(first_pick) AS league FROM d WHERE position = 'R')
SELECT owner, drafts, picks, early_share, drafts / (drafts + 5.0::DOUBLE) * coalesce(first_r, league) + (1 - drafts / (drafts + 5.0::DOUBLE)) * league AS first_r FROM f, l""")
def a27(spark, sf_dir):
    """Owner profiles: first picks per draft, early share, shrunk to the league."""
    line = table(spark, sf_dir, "lineitem")
    draft = line.groupBy(F.col("l_suppkey").alias("owner"), F.col("l_orderkey").alias("draft"), F.col("l_returnflag").alias("position")).agg(
        F.min("l_linenumber").alias("first_pick"), F.count("*").alias("n"), F.count_if(F.col("l_linenumber") <= 2).alias("early")
    )
    first = F.when(F.col("position") == "R", F.col("first_pick"))
    owner = draft.groupBy("owner").agg(
        F.avg(first).alias("own"), F.sum("n").alias("picks"), (F.sum("early") / F.sum("n")).alias("early_share"), F.count_distinct("draft").alias("drafts")
    )
    league = draft.agg(F.avg(first).alias("league"))
    weight = F.col("drafts") / (F.col("drafts") + 5.0)
    shrunk = weight * F.coalesce("own", "league") + (1 - weight) * F.col("league")
    return owner.crossJoin(F.broadcast(league)).select("owner", "drafts", "picks", "early_share", shrunk.alias("first_r"))


GAMES = """games AS (SELECT season, period, a.team AS home, b.team AS away, a.games AS home_score, b.games AS away_score FROM
 (SELECT *, (place + 1) // 2 AS meeting FROM placed WHERE place % 2 = 1) a JOIN (SELECT *, (place + 1) // 2 AS meeting FROM placed WHERE place % 2 = 0) b USING (season, period, meeting))"""


def games(spark, sf_dir):
    """Meetings of teams in a period, scored by their number of orders."""
    rows = team_rounds(spark, sf_dir).withColumn("meeting", F.floor((F.col("place") + 1) / 2))
    side = lambda odd, who: rows.where(F.col("place") % 2 == odd).select("season", "period", "meeting", F.col("team").alias(who), F.col("games").alias(f"{who}_score"))
    return side(1, "home").join(side(0, "away"), ["season", "period", "meeting"]).drop("meeting")


WINS = f"""WITH {FACT}, {ROUND}, {GAMES}, s AS (SELECT season, home AS team, CASE WHEN home_score > away_score THEN 1.0 WHEN home_score = away_score THEN 0.5 ELSE 0.0 END AS w FROM games
 UNION ALL SELECT season, away, CASE WHEN away_score > home_score THEN 1.0 WHEN home_score = away_score THEN 0.5 ELSE 0.0 END FROM games), wins AS (SELECT season, team, sum(w)::DOUBLE AS wins FROM s GROUP BY ALL)"""


def team_wins(spark, sf_dir):
    """Wins per team and season, ties half; one row per side by one explode."""
    tie = F.when(F.col("home_score") == F.col("away_score"), 0.5)
    home = F.coalesce(tie, F.when(F.col("home_score") > F.col("away_score"), 1.0).otherwise(0.0))
    sides = F.explode(F.array(F.struct(F.col("home").alias("team"), home.alias("w")), F.struct(F.col("away").alias("team"), (1 - home).alias("w"))))
    return games(spark, sf_dir).select("season", sides.alias("s")).groupBy("season", "s.team").agg(F.sum("s.w").alias("wins"))


@query("A28", WINS + """ SELECT season, team, wins, row_number() OVER (PARTITION BY season, n_regionkey ORDER BY wins DESC, team) <= 2 AS made FROM wins JOIN nation ON n_nationkey = team""")
def a28(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = team_wins(spark, sf_dir).join(F.broadcast(nation), F.col("team") == F.col("n_nationkey"))
    place = F.row_number().over(Window.partitionBy("season", "n_regionkey").orderBy(F.desc("wins"), "team"))
    return rows.select("season", "team", "wins", (place <= 2).alias("made"))


EDGE = f"""{FACT}, edge AS (SELECT grp, season, game, entity, qty, avg(qty) OVER (PARTITION BY entity, season ORDER BY period, game ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pred,
 lag(qty) OVER (PARTITION BY entity, season ORDER BY period, game) AS naive FROM fact)"""


def edges(spark, sf_dir):
    """Each game with a trailing-three prediction and a naive one."""
    w = Window.partitionBy("entity", "season").orderBy("period", "game")
    rows = facts(spark, sf_dir)
    return rows.select("grp", "season", "game", "entity", "qty", F.avg("qty").over(w.rowsBetween(-3, -1)).alias("pred"), F.lag("qty").over(w).alias("naive"))


@query("A29", f"""WITH {EDGE}, d AS (SELECT grp, season, qty - pred AS e FROM edge WHERE qty IS NOT NULL AND pred IS NOT NULL)
SELECT coalesce(grp, '*') AS grp, coalesce(season, 0) AS season, round(avg(e), 6) AS mean, round(median(e), 6) AS median, count(*) FILTER (WHERE e > 0) AS over, count(*) FILTER (WHERE e < 0) AS under FROM d GROUP BY GROUPING SETS ((season), (grp, season))""")
def a29(spark, sf_dir):
    rows = edges(spark, sf_dir).withColumn("e", F.col("qty") - F.col("pred")).where("e is not null")
    rows = Workspace(spark, "signed").save(rows.select("grp", "season", "e"), "rows")
    cells = rows.groupingSets([["season"], ["grp", "season"]], "grp", "season").agg(
        F.round(F.avg("e"), 6).alias("mean"), F.count_if(F.col("e") > 0).alias("over"), F.count_if(F.col("e") < 0).alias("under")
    )
    # a row is in its season's cell and in its group's
    cell = F.explode(F.array(F.struct(F.lit(None).cast("string").alias("grp"), "season"), F.struct("grp", "season")))
    both = lambda df: df.select(cell.alias("cell"), "e", "__c", "__part").select("cell.*", "e", "__c", "__part")
    middle = exact_quantiles(rows, ["grp", "season"], "e", (0.5,), members=both)
    cells = null_safe_join(cells, middle.select("grp", "season", F.round(F.col("q")[0], 6).alias("median")), ["grp", "season"])
    return cells.select(F.coalesce("grp", F.lit("*")).alias("grp"), F.coalesce("season", F.lit(0).cast("long")).alias("season"), "mean", "median", "over", "under")


CELLS = f"""WITH {EDGE}, c AS (SELECT grp, season, 'mae' AS metric, avg(abs(qty - pred)) AS model, avg(abs(qty - naive)) AS base FROM edge WHERE qty IS NOT NULL AND pred IS NOT NULL AND naive IS NOT NULL GROUP BY ALL)"""


def cells(spark, sf_dir):
    rows = edges(spark, sf_dir).where("qty is not null and pred is not null and naive is not null")
    return rows.groupBy("grp", "season").agg(
        F.lit("mae").alias("metric"), F.avg(F.abs(F.col("qty") - F.col("pred"))).alias("model"), F.avg(F.abs(F.col("qty") - F.col("naive"))).alias("base")
    )


@query("A30", CELLS + " SELECT grp, count(*) AS seasons, count(*) FILTER (WHERE model < base) AS beats, bool_and(model < base) AS beats_all FROM c GROUP BY grp HAVING count(DISTINCT metric) = 1")
def a30(spark, sf_dir):
    """Seasons won per group; a group of mixed metrics is refused at run time."""
    won = F.col("model") < F.col("base")
    rows = cells(spark, sf_dir).groupBy("grp").agg(
        F.count("*").alias("seasons"), F.count_if(won).alias("beats"), F.bool_and(won).alias("beats_all"), F.count_distinct("metric").alias("kinds")
    )
    seasons = F.when(F.col("kinds") > 1, F.raise_error(F.lit("mixed metrics in one cell"))).otherwise(F.col("seasons"))
    return rows.select("grp", seasons.alias("seasons"), "beats", "beats_all")


@query("A31", f"""WITH {EDGE}, d AS (SELECT entity, qty - pred AS e FROM edge WHERE qty IS NOT NULL AND pred IS NOT NULL), g AS (SELECT entity, count(*) AS n, avg(e) AS m, var_samp(e) AS v FROM d GROUP BY 1 HAVING count(*) >= 2)
SELECT round(sum((n - 1) * v) / sum(n - 1), 4) AS within_var, round(greatest(var_samp(m) - sum((n - 1) * v) / sum(n - 1) * avg(1.0::DOUBLE / n), 0), 4) AS between_var, count(*) AS groups FROM g""")
def a31(spark, sf_dir):
    """Within- and between-group variance of residuals, never negative."""
    rows = edges(spark, sf_dir).withColumn("e", F.col("qty") - F.col("pred")).where("e is not null")
    group = rows.groupBy("entity").agg(F.count("*").alias("n"), F.avg("e").alias("m"), F.var_samp("e").alias("v")).where("n >= 2")
    within = F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)
    between = F.greatest(F.var_samp("m") - within * F.avg(1 / F.col("n")), F.lit(0.0))
    return group.agg(F.round(within, 4).alias("within_var"), F.round(between, 4).alias("between_var"), F.count("*").alias("groups"))


@query("A32", f"WITH {EDGE} SELECT round(stddev_pop(qty - pred), 6) AS pooled_std FROM edge")
def a32(spark, sf_dir):
    return edges(spark, sf_dir).agg(F.round(F.stddev_pop(F.col("qty") - F.col("pred")), 6).alias("pooled_std"))


@query("A33", """SELECT user_id, count(*) AS n_stats, max(v) FILTER (WHERE event_type = 'view') AS view_cents FROM (
 SELECT user_id, event_type, max_by(round(value * 100)::BIGINT, (ts, event_id)) AS v FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY user_id""")
def a33(spark, sf_dir):
    """The newest value per entity and statistic of approved runs, as a map per entity."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'")
    newest = rows.groupBy("user_id", "event_type").agg(F.max_by(F.round(F.col("value") * 100).cast("long"), F.struct("ts", "event_id")).alias("v"))
    maps = newest.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("stats"))
    return maps.select("user_id", F.size("stats").cast("long").alias("n_stats"), F.try_element_at("stats", F.lit("view")).alias("view_cents"))
