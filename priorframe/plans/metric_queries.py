"""Metrics and evaluation (M), with their SQL."""

from __future__ import annotations

from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators import metrics as M
from ..operators.ordered import average_ranks, causal_quantiles, exact_quantiles, null_safe_join
from ..operators.rank import hit_rate, points_lost
from ..operators.resolve import co_movement
from ..operators.temporal import lag_join
from ..sources.tables import Workspace
from .aggregate_queries import CELLS, EDGE, WINS, cells, edges, team_wins
from .facts import FACT, facts, table
from .rank_queries import BOARD, board
from .registry import query
from .scalar_queries import CDF_SQL, ODDS, odds

KEEP = "qty IS NOT NULL AND pred IS NOT NULL AND naive IS NOT NULL"
GOOD = "qty is not null and pred is not null and naive is not null"


def _good(spark, sf_dir):
    return edges(spark, sf_dir).where(GOOD)


@query("M01", f"WITH {EDGE} SELECT grp, season, round(avg(abs(pred - qty)), 6) AS mae, round(sqrt(avg(pow(pred - qty, 2))), 6) AS rmse, round(avg(pred - qty), 6) AS bias FROM edge WHERE {KEEP} GROUP BY ALL")
def m01(spark, sf_dir):
    rows = _good(spark, sf_dir).groupBy("grp", "season").agg(*M.error_metrics("qty", "pred"))
    return rows.select("grp", "season", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")))


@query("M02", f"WITH {EDGE} SELECT grp, round(avg(greatest(0.9 * (qty - pred), -0.1 * (qty - pred))), 6) AS pinball FROM edge WHERE {KEEP} GROUP BY ALL")
def m02(spark, sf_dir):
    return _good(spark, sf_dir).groupBy("grp").agg(F.round(M.pinball(F.col("qty"), F.col("pred"), 0.9), 6).alias("pinball"))


@query("M03", f"WITH {EDGE} SELECT grp, round(avg(2 * (CASE WHEN qty > 0 THEN qty * ln(qty / greatest(pred, 1e-9)) ELSE 0 END - (qty - greatest(pred, 1e-9)))), 5) AS deviance FROM edge WHERE {KEEP} GROUP BY ALL")
def m03(spark, sf_dir):
    return _good(spark, sf_dir).groupBy("grp").agg(F.round(M.poisson_deviance(F.col("qty"), F.col("pred")), 5).alias("deviance"))


@query("M04", f"""WITH {EDGE}, s AS (SELECT grp, qty, [pred, naive, pred + 10, naive - 20] AS xs FROM edge WHERE {KEEP})
SELECT grp, round(avg(list_avg(list_transform(xs, lambda x: abs(x - qty))) - list_avg(list_transform(xs, lambda x: list_avg(list_transform(xs, lambda y: abs(x - y))))) / 2), 5) AS crps FROM s GROUP BY grp""")
def m04(spark, sf_dir):
    samples = F.array(F.col("pred"), F.col("naive"), F.col("pred") + 10, F.col("naive") - 20)
    return _good(spark, sf_dir).groupBy("grp").agg(F.round(F.avg(M.crps_samples(samples, F.col("qty"))), 5).alias("crps"))


@query("M05", f"""WITH {EDGE}, z AS (SELECT grp, (qty - pred) / 60 AS z FROM edge WHERE {KEEP}), x AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x FROM z), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM x),
c AS (SELECT grp, z, CASE WHEN z >= 0 THEN {CDF_SQL} ELSE 1 - ({CDF_SQL}) END AS p FROM t)
SELECT grp, round(avg(60 * (z * (2 * p - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))), 5) AS crps FROM c GROUP BY grp""")
def m05(spark, sf_dir):
    return _good(spark, sf_dir).groupBy("grp").agg(F.round(F.avg(M.crps_gaussian(F.col("qty"), F.col("pred"), F.lit(60.0))), 5).alias("crps"))


@query("M06", f"WITH {EDGE} SELECT grp, season, avg((qty BETWEEN pred - 40 AND pred + 40)::INTEGER) AS covered FROM edge WHERE {KEEP} GROUP BY ALL")
def m06(spark, sf_dir):
    rows = _good(spark, sf_dir).withColumn("low", F.col("pred") - 40).withColumn("high", F.col("pred") + 40)
    return rows.groupBy("grp", "season").agg(M.coverage("qty", "low", "high").alias("covered"))


@query("M07", f"WITH {EDGE} SELECT grp, CASE WHEN grp IN ('BUILDING', 'FURNITURE') THEN 'deviance' ELSE 'mae' END AS metric, round(CASE WHEN grp IN ('BUILDING', 'FURNITURE') THEN avg(2 * (CASE WHEN qty > 0 THEN qty * ln(qty / greatest(pred, 1e-9)) ELSE 0 END - (qty - greatest(pred, 1e-9)))) ELSE avg(abs(qty - pred)) END, 5) AS score FROM edge WHERE {KEEP} GROUP BY grp")
def m07(spark, sf_dir):
    """Counts are scored by their deviance, other statistics by the absolute error."""
    counts = F.col("grp").isin("BUILDING", "FURNITURE")
    rows = _good(spark, sf_dir).groupBy("grp").agg(M.poisson_deviance(F.col("qty"), F.col("pred")).alias("d"), F.avg(F.abs(F.col("qty") - F.col("pred"))).alias("m"))
    return rows.select("grp", F.when(counts, "deviance").otherwise("mae").alias("metric"), F.round(F.when(counts, F.col("d")).otherwise(F.col("m")), 5).alias("score"))


@query("M08", f"""WITH {EDGE} SELECT season, grp, count(*) AS n, round(avg(abs(pred - qty)), 6) AS mae, round(sqrt(avg(pow(pred - qty, 2))), 6) AS rmse, round(avg(pred - qty), 6) AS bias, round(avg(abs(naive - qty)), 6) AS naive_mae,
 round((avg(abs(naive - qty)) - avg(abs(pred - qty))) / avg(abs(naive - qty)) * 100, 5) AS improvement, round(avg((abs(qty - pred) <= 40)::INTEGER), 6) AS covered, round(corr(qty, pred), 6) AS rho, max(abs(pred - qty)) AS worst, round(median(abs(pred - qty)), 6) AS median_error
 FROM edge WHERE {KEEP} GROUP BY season, grp HAVING count(*) >= 2""")
def m08(spark, sf_dir):
    """Ten metrics per season and group: nine from one aggregation, the median from counted ranges."""
    saved = Workspace(spark, "backtest").save(_good(spark, sf_dir).select("season", "grp", "qty", "pred", "naive"), "rows")
    gap, naive = F.abs(F.col("pred") - F.col("qty")), F.avg(F.abs(F.col("naive") - F.col("qty")))
    rows = saved.groupBy("season", "grp").agg(
        F.count("*").alias("n"), *M.error_metrics("qty", "pred"), naive.alias("naive_mae"), F.avg((gap <= 40).cast("int")).alias("covered"), F.corr("qty", "pred").alias("rho"),
        F.max(gap).alias("worst"),
    ).where("n >= 2")
    middle = exact_quantiles(saved.select("season", "grp", gap.alias("gap")), ["season", "grp"], "gap", (0.5,))
    rows = null_safe_join(rows, middle.select("season", "grp", F.col("q")[0].alias("median_error")), ["season", "grp"])
    better = F.round((F.col("naive_mae") - F.col("mae")) / F.col("naive_mae") * 100, 5).alias("improvement")
    return rows.select("season", "grp", "n", "worst", better, *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "naive_mae", "covered", "rho", "median_error")))


M09_SQL = f"""WITH {EDGE}, s AS (SELECT entity, season, avg(qty) AS mean_qty, count(qty) AS n FROM fact GROUP BY ALL),
m AS (SELECT e.*, p.mean_qty AS last_season FROM edge e LEFT JOIN s p ON p.entity = e.entity AND p.season = e.season - 1 AND p.n >= 2),
k AS (SELECT *, ({KEEP} AND last_season IS NOT NULL) AS common FROM m)
SELECT grp, season, count(*) FILTER (WHERE common) AS n, round(avg(abs(qty - pred)) FILTER (WHERE common), 6) AS model_mae, round(avg(abs(qty - naive)) FILTER (WHERE common), 6) AS naive_mae,
 round(avg(abs(qty - last_season)) FILTER (WHERE common), 6) AS season_mae, count(*) FILTER (WHERE qty IS NOT NULL AND pred IS NOT NULL) AS n_model, count(*) FILTER (WHERE qty IS NOT NULL AND naive IS NOT NULL) AS n_naive,
 count(*) FILTER (WHERE qty IS NOT NULL AND last_season IS NOT NULL) AS n_season FROM k GROUP BY grp, season"""


@query("M09", M09_SQL)
def m09(spark, sf_dir):
    """A forecast, a naive one and last season's mean on their common rows, with each one's own count."""
    rows = facts(spark, sf_dir)
    season = rows.groupBy("entity", "season").agg(F.avg("qty").alias("mean_qty"), F.count("qty").alias("n")).where("n >= 2")
    joined = lag_join(edges(spark, sf_dir), season, ["entity"], "season", 1, {"mean_qty": "last_season"})
    common = M.both_present("qty", "pred", "naive", "last_season")
    mae = lambda c: F.round(F.avg(F.when(common, F.abs(F.col("qty") - F.col(c)))), 6)
    n = lambda c: F.count_if(M.both_present("qty", c))
    return joined.groupBy("grp", "season").agg(
        F.count_if(common).alias("n"), mae("pred").alias("model_mae"), mae("naive").alias("naive_mae"), mae("last_season").alias("season_mae"),
        n("pred").alias("n_model"), n("naive").alias("n_naive"), n("last_season").alias("n_season"),
    )


@query("M10", f"WITH {FACT}, s AS (SELECT entity, season, avg(qty) AS m, count(qty) AS n FROM fact GROUP BY ALL) SELECT s.entity, s.season, p.m AS previous FROM s LEFT JOIN s p ON p.entity = s.entity AND p.season = s.season - 1 AND p.n >= 2")
def m10(spark, sf_dir):
    season = facts(spark, sf_dir).groupBy("entity", "season").agg(F.avg("qty").alias("m"), F.count("qty").alias("n"))
    return lag_join(season.select("entity", "season"), season.where("n >= 2"), ["entity"], "season", 1, {"m": "previous"})


@query("M11", f"""WITH {FACT}, s AS (SELECT entity, season, any_value(grp) AS grp, sum(qty) AS total, count(qty) AS games FROM fact GROUP BY entity, season), p AS (SELECT grp, season, sum(total) / sum(games) AS prior FROM s GROUP BY ALL),
k AS (SELECT s.entity, s.grp, s.season, sum(w * l.total) AS wt, sum(w * l.games) AS wg FROM s JOIN (VALUES (1, 5), (2, 4), (3, 3)) v(lag, w) ON true JOIN s l ON l.entity = s.entity AND l.season = s.season - v.lag GROUP BY ALL)
SELECT k.entity, k.season, round((wt + 30 * prior) / (wg + 30), 6) AS marcel FROM k JOIN p ON p.grp = k.grp AND p.season = k.season - 1 WHERE wg > 0""")
def m11(spark, sf_dir):
    """Three earlier seasons weighted 5/4/3 by games, shrunk by thirty games to the group's last season."""
    season = facts(spark, sf_dir).groupBy("entity", "season").agg(F.any_value("grp").alias("grp"), F.sum("qty").alias("total"), F.count("qty").alias("games"))
    prior = season.groupBy("grp", (F.col("season") + 1).alias("season")).agg((F.sum("total") / F.sum("games")).alias("prior"))
    rows = season.select("entity", "season", "grp")
    for k in (1, 2, 3):
        rows = lag_join(rows, season, ["entity"], "season", k, {"total": f"t{k}", "games": f"g{k}"})
    weigh = lambda c: sum((w * F.coalesce(F.col(f"{c}{k}"), F.lit(0)) for k, w in ((2, 4), (3, 3))), 5 * F.coalesce(F.col(f"{c}1"), F.lit(0)))
    rows = rows.withColumn("wt", weigh("t")).withColumn("wg", weigh("g")).where("wg > 0").join(prior, ["grp", "season"])
    return rows.select("entity", "season", F.round((F.col("wt") + 30 * F.col("prior")) / (F.col("wg") + 30), 6).alias("marcel"))


RES = f"""{EDGE}, res AS (SELECT grp, season, game, pred, qty, qty - pred AS r FROM edge WHERE {KEEP}), tgt AS (SELECT DISTINCT season AS target FROM res)"""


@query("M12", f"""WITH {RES}, q AS (SELECT target AS season, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi, count(*) AS n FROM res JOIN tgt ON res.season < target GROUP BY 1 HAVING count(*) >= 20)
SELECT game, round(pred + lo, 6) AS low, round(pred + hi, 6) AS high FROM res JOIN q USING (season)""")
def m12(spark, sf_dir):
    """Bounds from residuals of earlier seasons only."""
    rows = _good(spark, sf_dir).select("game", "season", "pred", (F.col("qty") - F.col("pred")).alias("r"))
    rows = Workspace(spark, "bounds").save(rows, "rows")
    q = causal_quantiles(rows, "season", "r", (0.1, 0.9), 20)
    joined = rows.join(F.broadcast(q), "season")
    return joined.select("game", F.round(F.col("pred") + F.col("q")[0], 6).alias("low"), F.round(F.col("pred") + F.col("q")[1], 6).alias("high"))


@query("M13", f"""WITH {RES}, cuts AS (SELECT target AS season, quantile_cont(pred, [0.2, 0.4, 0.6, 0.8]) AS c FROM res JOIN tgt ON res.season < target GROUP BY 1 HAVING count(*) >= 100),
b AS (SELECT r.*, t.season AS target, len(list_filter(list_distinct(t.c), lambda x: x <= r.pred)) AS bk FROM res r JOIN cuts t ON r.season <= t.season),
pool AS (SELECT target, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM b WHERE season < target GROUP BY 1), bq AS (SELECT target, bk, quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi FROM b WHERE season < target GROUP BY 1, 2 HAVING count(*) >= 100)
SELECT game, round(greatest(pred + coalesce(bq.lo, pool.lo), 0), 6) AS low, round(greatest(pred + coalesce(bq.hi, pool.hi), 0), 6) AS high FROM b JOIN pool USING (target) LEFT JOIN bq ON bq.target = b.target AND bq.bk = b.bk WHERE season = b.target""")
def m13(spark, sf_dir):
    """Bounds by quintile of earlier predictions where a bucket has enough residuals, else pooled; never below zero.

    A row counts in its bucket of every later season; these counts are summed up by ranges of the residual before any shuffle.
    """
    work = Workspace(spark, "buckets")
    rows = work.save(_good(spark, sf_dir).select("game", "season", "pred", (F.col("qty") - F.col("pred")).alias("r")), "rows")
    cuts = causal_quantiles(rows, "season", "pred", (0.2, 0.4, 0.6, 0.8), 100).select(F.col("season").alias("target"), F.array_distinct("q").alias("cuts"))
    cuts = work.save(cuts, "cuts")  # a row a season
    bucket = F.size(F.filter("cuts", lambda x: x <= F.col("pred")))
    later = lambda df: df.join(F.broadcast(cuts), F.col("season") < F.col("target")).withColumn("bk", bucket)
    pool = causal_quantiles(rows, "season", "r", (0.05, 0.95), 100).select(F.col("season").alias("target"), F.col("q").alias("pool"))
    own = exact_quantiles(rows.select("season", "pred", "r"), ["target", "bk"], "r", (0.05, 0.95), 100, members=later).select("target", "bk", F.col("q").alias("own"))
    now = rows.join(F.broadcast(cuts), F.col("season") == F.col("target")).withColumn("bk", bucket)
    now = now.join(F.broadcast(pool), "target").join(F.broadcast(own), ["target", "bk"], "left")
    q = F.coalesce("own", "pool")
    bound = lambda k: F.round(F.greatest(F.col("pred") + q[k], F.lit(0.0)), 6)
    return now.select("game", bound(0).alias("low"), bound(1).alias("high"))


@query("M14", f"""WITH {RES}, o AS (SELECT grp, abs(r) AS a, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY abs(r)) AS k FROM res)
SELECT grp, round(a, 6) AS radius FROM o WHERE n >= 20 AND k = least(ceil((n + 1) * 0.8), n)""")
def m14(spark, sf_dir):
    rows = _good(spark, sf_dir).withColumn("r", F.col("qty") - F.col("pred"))
    return M.order_statistic_radius(rows, ("grp",), "r", 0.8, 20).withColumn("radius", F.round("radius", 6))


@query("M15", f"""WITH {ODDS}, c AS (SELECT p, (least(floor(p * 10), 9))::BIGINT AS bin, (over_odds > 0)::INTEGER AS hit FROM odds) SELECT bin, round(avg(p), 6) AS mean_p, avg(hit) AS observed, count(*) AS n FROM c GROUP BY bin""")
def m15(spark, sf_dir):
    rows = odds(spark, sf_dir).withColumn("hit", (F.col("over_odds") > 0).cast("int"))
    return M.calibration_table(rows, "p", "hit", 10).withColumn("mean_p", F.round("mean_p", 6))


@query("M16", f"""WITH {BOARD}, b AS (SELECT position, rank() OVER (PARTITION BY position ORDER BY projection) + (count(*) OVER (PARTITION BY position, projection) - 1) / 2 AS a, rank() OVER (PARTITION BY position ORDER BY realized) + (count(*) OVER (PARTITION BY position, realized) - 1) / 2 AS b FROM board WHERE realized IS NOT NULL)
SELECT position, round(corr(a, b), 6) AS spearman, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 5""")
def m16(spark, sf_dir):
    rows = board(spark, sf_dir).where("realized is not null")
    rows = rows.select("entity", "position", "projection", "realized")
    rows = average_ranks(average_ranks(rows, ("position",), "projection", "a"), ("position",), "realized", "b")
    return rows.groupBy("position").agg(F.round(F.corr("a", "b"), 6).alias("spearman"), F.count("*").alias("n")).where("n >= 5")


@query("M17", f"WITH {BOARD} SELECT position, sum(realized) / sum(projection) AS ratio FROM board WHERE realized IS NOT NULL GROUP BY 1")
def m17(spark, sf_dir):
    return board(spark, sf_dir).where("realized is not null").groupBy("position").agg((F.sum("realized") / F.sum("projection")).alias("ratio"))


WEIGHT_SQL = " + ".join(f"(u > {c!r}::DOUBLE)::INTEGER" for c in M.POISSON_ONE)


@query("M18", f"""WITH {EDGE}, s AS (SELECT grp, entity, sum(abs(qty - naive) - abs(qty - pred)) AS s, count(*) AS n FROM edge WHERE {KEEP} GROUP BY ALL),
w AS (SELECT grp, r, s, n, ('0x' || substr(md5(entity || '|' || r || '|11'), 1, 10))::BIGINT / 1099511627776::DOUBLE AS u FROM s, range(1, 201) t(r)),
m AS (SELECT grp, r, sum(({WEIGHT_SQL}) * s) / nullif(sum(({WEIGHT_SQL}) * n), 0) AS m FROM w GROUP BY ALL), b AS (SELECT grp, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY grp)
SELECT grp, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM b JOIN (SELECT grp, sum(s) / sum(n) AS mean FROM s GROUP BY grp) USING (grp)""")
def m18(spark, sf_dir):
    """Mean advantage over the naive forecast per group with a cluster bootstrap over entities."""
    rows = _good(spark, sf_dir).withColumn("gain", F.abs(F.col("qty") - F.col("naive")) - F.abs(F.col("qty") - F.col("pred")))
    out = M.bootstrap_mean(rows, ["entity"], "gain", 200, 11, by=["grp"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query("M19", f"""WITH {ODDS}, s AS (SELECT game, play, p, (over_odds > 0 AND under_odds > 0)::INTEGER AS hit, CASE WHEN over_odds > 0 THEN over_odds / 100 ELSE 100 / -over_odds END AS b, CASE WHEN over_odds < 0 THEN -over_odds / (-over_odds + 100) ELSE 100 / (over_odds + 100) END AS imp FROM odds),
t AS (SELECT *, round((CASE WHEN hit = 1 THEN b ELSE -1 END) * 1000000)::BIGINT AS pnl FROM s WHERE p - imp > 0.05),
g AS (SELECT game % 50 AS book, game, sum(pnl)::BIGINT AS pnl, count(*) AS n FROM t GROUP BY ALL), e AS (SELECT *, sum(pnl) OVER (PARTITION BY book ORDER BY game) AS eq FROM g), d AS (SELECT *, max(eq) OVER (PARTITION BY book ORDER BY game) AS peak FROM e)
SELECT book, sum(n)::BIGINT AS bets, sum(pnl)::BIGINT AS micro_pnl, round(sum(pnl) / 1000000 / sum(n), 6) AS roi, min(eq - peak)::BIGINT AS drawdown FROM d GROUP BY book""")
def m19(spark, sf_dir):
    """Bets above an edge threshold per book: profit, return and drawdown; money in millionths."""
    rows = odds(spark, sf_dir).withColumn("b", S.profit_per_unit(F.col("over_odds"))).withColumn("imp", S.american_to_probability(F.col("over_odds")))
    hit = (F.col("over_odds") > 0) & (F.col("under_odds") > 0)
    bets = rows.where(F.col("p") - F.col("imp") > 0.05).withColumn("pnl", F.round(F.when(hit, F.col("b")).otherwise(-1.0) * 1_000_000).cast("long"))
    game = bets.groupBy((F.col("game") % 50).alias("book"), "game").agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"))
    w = Window.partitionBy("book").orderBy("game").rowsBetween(Window.unboundedPreceding, 0)
    curve = game.withColumn("eq", F.sum("pnl").over(w)).withColumn("peak", F.max("eq").over(w))
    return curve.groupBy("book").agg(
        F.sum("n").alias("bets"), F.sum("pnl").alias("micro_pnl"), F.round(F.sum("pnl") / 1_000_000 / F.sum("n"), 6).alias("roi"), F.min(F.col("eq") - F.col("peak")).alias("drawdown")
    )


@query("M20", f"""WITH {ODDS}, c AS (SELECT play, least(greatest(p, 0.001), 0.999) AS p, (over_odds > 0)::INTEGER AS y FROM odds)
SELECT play, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, avg(((p >= 0.5) = (y = 1))::INTEGER) AS accuracy FROM c GROUP BY play""")
def m20(spark, sf_dir):
    p, y = F.col("q"), F.col("y")
    rows = odds(spark, sf_dir).select("play", F.least(F.greatest("p", F.lit(0.001)), F.lit(0.999)).alias("q"), (F.col("over_odds") > 0).cast("int").alias("y"))
    log_loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    right = ((p >= 0.5) == (y == 1)).cast("int")
    return rows.groupBy("play").agg(F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(log_loss), 6).alias("log_loss"), F.avg(right).alias("accuracy"))


@query("M21", f"WITH {EDGE} SELECT season, round(avg(abs(qty - pred)), 6) AS model, round(avg(abs(qty - naive)), 6) AS line, count(*) AS lined FROM edge WHERE {KEEP} AND game IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY season")
def m21(spark, sf_dir):
    lined = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("game"))
    rows = _good(spark, sf_dir).join(lined, "game", "left_semi")
    mae = lambda c: F.round(F.avg(F.abs(F.col("qty") - F.col(c))), 6)
    return rows.groupBy("season").agg(mae("pred").alias("model"), mae("naive").alias("line"), F.count("*").alias("lined"))


@query("M22", WINS + " SELECT a.season, avg(abs(a.wins - b.wins)) AS mae, count(*) AS teams FROM wins a JOIN wins b ON a.team = b.team AND b.season = a.season - 1 GROUP BY a.season")
def m22(spark, sf_dir):
    """Last season's wins as the projection of this one's."""
    rows = team_wins(spark, sf_dir)
    both = lag_join(rows, rows, ["team"], "season", 1, {"wins": "projected"}).where("projected is not null")
    return both.groupBy("season").agg(F.avg(F.abs(F.col("wins") - F.col("projected"))).alias("mae"), F.count("*").alias("teams"))


@query("M23", CELLS + " SELECT grp, season, model <= base * 1.02 AS released, round(model / base - 1, 6) AS change FROM c")
def m23(spark, sf_dir):
    """A candidate is released if its error exceeds the frozen baseline's by at most two percent."""
    return cells(spark, sf_dir).select("grp", "season", (F.col("model") <= F.col("base") * 1.02).alias("released"), F.round(F.col("model") / F.col("base") - 1, 6).alias("change"))


@query("M24", CELLS + " SELECT grp, avg(model) + 0.5 * stddev_samp(model - base) > avg(base) AS fallback FROM c GROUP BY grp")
def m24(spark, sf_dir):
    worse = F.avg("model") + 0.5 * F.stddev_samp(F.col("model") - F.col("base")) > F.avg("base")
    return cells(spark, sf_dir).groupBy("grp").agg(worse.alias("fallback"))


@query("M25", CELLS + " SELECT grp, season, (base - model) / base * 100 >= 5 AS promoted FROM c")
def m25(spark, sf_dir):
    return cells(spark, sf_dir).select("grp", "season", M.improvement_gate(F.col("model"), F.col("base"), 5.0).alias("promoted"))


@query("M26", f"WITH {EDGE}, d AS (SELECT grp, 0.75 * pred + 0.25 * naive AS served, pred AS stored FROM edge WHERE {KEEP}) SELECT grp, round(avg(served - stored), 6) AS mean_delta, round(max(abs(served - stored)), 6) AS max_delta, round(corr(served, stored), 6) AS rho FROM d GROUP BY grp")
def m26(spark, sf_dir):
    """Base predictions recombined by their coefficients against the stored ones."""
    rows = _good(spark, sf_dir).select("grp", (0.75 * F.col("pred") + 0.25 * F.col("naive")).alias("served"), F.col("pred").alias("stored"))
    d = F.col("served") - F.col("stored")
    return rows.groupBy("grp").agg(F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.max(F.abs(d)), 6).alias("max_delta"), F.round(F.corr("served", "stored"), 6).alias("rho"))


@query("M27", f"""WITH {BOARD}, b AS (SELECT * FROM board WHERE realized IS NOT NULL AND adp IS NOT NULL), r AS (SELECT position, realized, row_number() OVER (PARTITION BY position ORDER BY projection DESC, entity) <= 20 AS m, row_number() OVER (PARTITION BY position ORDER BY adp DESC, entity) <= 20 AS k, row_number() OVER (PARTITION BY position ORDER BY realized DESC, entity) <= 20 AS t FROM b)
SELECT position, count(*) FILTER (WHERE m AND t) / 20 AS model_hits, count(*) FILTER (WHERE k AND t) / 20 AS market_hits, sum(realized) FILTER (WHERE t) - sum(realized) FILTER (WHERE m) AS model_lost, count(*) FILTER (WHERE m AND t) > count(*) FILTER (WHERE k AND t) AS beats FROM r GROUP BY 1""")
def m27(spark, sf_dir):
    rows = board(spark, sf_dir).where("realized is not null and adp is not null")
    model = hit_rate(rows, ("position",), F.desc("projection"), F.desc("realized"), 20).withColumnRenamed("hit_rate", "model_hits")
    market = hit_rate(rows, ("position",), F.desc("adp"), F.desc("realized"), 20).withColumnRenamed("hit_rate", "market_hits")
    lost = points_lost(rows, ("position",), "projection", "realized", 20).withColumnRenamed("points_lost", "model_lost")
    joined = model.join(market, "position").join(lost, "position")
    return joined.select("position", "model_hits", "market_hits", "model_lost", (F.col("model_hits") > F.col("market_hits")).alias("beats"))


@query("M28", f"""WITH {EDGE}, t AS (SELECT season * 100 + 0 AS s, season, entity % 25 AS team, game % 97 AS at, avg(qty - pred) AS x FROM edge WHERE {KEEP} GROUP BY ALL)
SELECT a.team AS a, b.team AS b, count(*) AS n, round(least(count(*) / 200.0::DOUBLE, 1) * corr(a.x, b.x) + (1 - least(count(*) / 200.0::DOUBLE, 1)) * 0.1, 6) AS blended FROM t a JOIN t b ON a.season = b.season AND a.at = b.at AND a.team < b.team GROUP BY ALL HAVING count(*) >= 20""")
def m28(spark, sf_dir):
    """Residual correlation of two groups, blended with a structural prior by how often they met."""
    rows = _good(spark, sf_dir).groupBy("season", (F.col("entity") % 25).alias("team"), (F.col("game") % 97).alias("at")).agg(F.avg(F.col("qty") - F.col("pred")).alias("x"))
    pairs = co_movement(rows, ["season", "at"], "team", "x", 20)
    weight = F.least(F.col("n") / 200.0, F.lit(1.0))
    return pairs.select("a", "b", "n", F.round(weight * F.col("rho") + (1 - weight) * 0.1, 6).alias("blended"))


def _score_sql(c: str) -> str:
    """SQL of the normal score of a column's average rank in its group."""
    return f"(rank() OVER (PARTITION BY grp ORDER BY {c}) + (count(*) OVER (PARTITION BY grp, {c}) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY grp) + 1) AS {c}"


@query("M29", f"""WITH {EDGE}, p AS (SELECT grp, {", ".join(map(_score_sql, ("qty", "pred", "naive")))} FROM edge WHERE {KEEP}),
z AS (SELECT grp, {", ".join(f"{S.quantile_sql(c)} AS {c}" for c in ("qty", "pred", "naive"))} FROM p)
SELECT grp, {", ".join(f"round(0.95 * corr({a}, {b}), 6) AS {a}_{b}" for a, b in (("qty", "pred"), ("qty", "naive"), ("pred", "naive")))} FROM z GROUP BY grp""")
def m29(spark, sf_dir):
    """Normal scores of ranks and their correlations, shrunk to the identity."""
    rows = _good(spark, sf_dir).select("game", "grp", "qty", "pred", "naive")
    for c in ("qty", "pred", "naive"):
        rows = average_ranks(rows, ("grp",), c, f"{c}_rank", total=f"{c}_n")
    scored = rows.select("grp", *(S.normal_quantile(F.col(f"{c}_rank") / (F.col(f"{c}_n") + 1)).alias(c) for c in ("qty", "pred", "naive")))
    pairs = (("qty", "pred"), ("qty", "naive"), ("pred", "naive"))
    return scored.groupBy("grp").agg(*(F.round(0.95 * F.corr(a, b), 6).alias(f"{a}_{b}") for a, b in pairs))


@query("M30")
def m30(spark, sf_dir):
    """Time to an entity's next game with censoring, and an accelerated failure time model of it (not a Cox model)."""
    w = Window.partitionBy("entity", "season").orderBy("period", "game")
    rows = facts(spark, sf_dir).where("qty is not null").withColumn("next", F.lead("period").over(w))
    rows = rows.select(
        "game", F.col("qty").alias("x"), (F.coalesce("next", F.lit(13)) - F.col("period") + 1).cast("double").alias("wait"), F.col("next").isNotNull().cast("double").alias("event")
    )
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = AFTSurvivalRegression(labelCol="wait", censorCol="event", featuresCol="features", maxIter=20).fit(ready)
    return model.transform(ready).select("game", "wait", "event", F.col("prediction").alias("expected_wait"))
