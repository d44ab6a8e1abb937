"""Model-stage dataflow (L). Fits differ in their last digits between machines, so only those without one have SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import functions as F

from ..functions.scalar import normal_cdf
from ..operators import learn as L
from ..sources.tables import Workspace
from .aggregate_queries import EDGE, GAMES, edges, games
from .facts import FACT, facts
from .join_queries import ROUND
from .registry import query
from .scalar_queries import CDF_SQL

INPUTS = ["pred", "naive", "share"]


def frame(spark, sf_dir):
    """Rows to learn from: earlier means as inputs, the game's value as label, null inputs kept."""
    rows = edges(spark, sf_dir).where("qty is not null")
    return rows.withColumn("share", (F.col("entity") % 10).cast("double")).withColumn("label", F.col("qty"))


def _split(spark, sf_dir, inputs):
    """Training rows and a holdout season, both filled with the training medians."""
    rows = Workspace(spark, "holdout").save(frame(spark, sf_dir), "rows")
    middle = L.medians(rows.where("season < 2001"), inputs)
    return L.filled(rows.where("season < 2001"), middle), L.filled(rows.where("season = 2001"), middle)


@query("L01", f"WITH {FACT}, s AS (SELECT DISTINCT season FROM fact), p AS (SELECT a.season AS valid_season, b.season AS train_season FROM s a JOIN s b ON b.season < a.season) SELECT count(*) OVER (PARTITION BY valid_season) AS fold, train_season, valid_season FROM p")
def l01(spark, sf_dir):
    return L.season_folds(facts(spark, sf_dir), "season")


@query("L02")
def l02(spark, sf_dir):
    learner = lambda n: GBTRegressor(labelCol="label", featuresCol="features", maxIter=5, maxDepth=3, seed=3)
    rows = frame(spark, sf_dir)
    out = L.walk_forward(rows, "season", INPUTS, "label", learner)
    return out.select("game", "season", F.round("prediction", 4).alias("prediction"), "max_train_season")


@query("L03", f"WITH {EDGE}, m AS (SELECT median(pred) AS mid FROM edge WHERE season < 2000 AND qty IS NOT NULL) SELECT game, coalesce(pred, (SELECT mid FROM m)) AS filled, pred IS NULL AS imputed FROM edge WHERE season >= 2000 AND qty IS NOT NULL")
def l03(spark, sf_dir):
    """Missing inputs filled with the medians of the training seasons."""
    rows = Workspace(spark, "imputed").save(frame(spark, sf_dir), "rows")
    out = L.filled(rows.where("season >= 2000"), L.medians(rows.where("season < 2000"), INPUTS))
    return out.select("game", F.col("pred__filled").alias("filled"), (F.col("pred").isNull() & F.col("pred__filled").isNotNull()).alias("imputed"))


@query("L04")
def l04(spark, sf_dir):
    """Ridge on a holdout season against the training mean."""
    train, holdout = _split(spark, sf_dir, INPUTS)
    stats = train.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()
    out = Pipeline(stages=[*L.prepared(INPUTS), L.ridge(10.0, stats.n, "label")]).fit(train).transform(holdout)
    mae = lambda c: F.avg(F.abs(F.col("label") - c))
    return out.groupBy("grp").agg(F.round(mae(F.col("prediction")), 4).alias("ridge"), F.round(mae(F.lit(stats.mean)), 4).alias("floor"))


@query("L05")
def l05(spark, sf_dir):
    """A second-stage ridge over two bases' out-of-fold predictions, itself out of fold."""
    rows = frame(spark, sf_dir)
    stage = lambda df, inputs, alpha: L.walk_forward(df, "season", inputs, "label", lambda n: L.ridge(alpha, n, "label"))
    base = stage(rows, ["pred", "naive"], 1.0).withColumnRenamed("prediction", "base_a").drop("max_train_season")
    both = stage(base, ["share"], 1.0).withColumnRenamed("prediction", "base_b").drop("max_train_season")
    out = stage(both, ["base_a", "base_b"], 5.0)
    return out.select("game", "season", F.round("prediction", 4).alias("prediction"), "max_train_season")


@query("L06", f"WITH {EDGE} SELECT game, 2.5::DOUBLE + coalesce(pred, 0) * 0.5::DOUBLE + coalesce(naive, 0) * 0.25::DOUBLE AS prediction, pred IS NULL OR naive IS NULL AS degraded FROM edge")
def l06(spark, sf_dir):
    prediction, degraded = L.weighted_cell({"pred": 0.5, "naive": 0.25, "entity": 0.0}, 2.5)
    return edges(spark, sf_dir).select("game", prediction.alias("prediction"), degraded.alias("degraded"))


@query("L07", f"""WITH {FACT}, {ROUND}, {GAMES}, m AS (SELECT season + 1 AS season, team, avg(s) AS mean FROM (SELECT season, home AS team, home_score AS s FROM games UNION ALL SELECT season, away, away_score FROM games) GROUP BY ALL),
z AS (SELECT g.season, g.period, g.home, g.away, (h.mean - a.mean) / 4 AS z FROM games g JOIN m h ON h.season = g.season AND h.team = g.home JOIN m a ON a.season = g.season AND a.team = g.away),
x AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x FROM z), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM x)
SELECT season, period, home, away, round(CASE WHEN z >= 0 THEN {CDF_SQL} ELSE 1 - ({CDF_SQL}) END, 6) AS p_home FROM t""")
def l07(spark, sf_dir):
    """Win probability of paired score predictions: the normal distribution of their difference."""
    rows = games(spark, sf_dir)
    means = rows.select("season", F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("home_score").alias("s")), F.struct(F.col("away").alias("team"), F.col("away_score").alias("s")))).alias("x"))
    means = means.groupBy((F.col("season") + 1).alias("season"), F.col("x.team").alias("team")).agg(F.avg("x.s").alias("mean"))
    side = lambda who: means.select("season", F.col("team").alias(who), F.col("mean").alias(f"{who}_mean"))
    joined = rows.join(side("home"), ["season", "home"]).join(side("away"), ["season", "away"])
    return joined.select("season", "period", "home", "away", F.round(normal_cdf((F.col("home_mean") - F.col("away_mean")) / 4.0), 6).alias("p_home"))


@query("L08")
def l08(spark, sf_dir):
    """What a group of inputs adds: the holdout error with and without it, on the same rows."""
    train, holdout = _split(spark, sf_dir, INPUTS)
    n = train.count()
    errors = []
    for name, inputs in (("without", ["pred"]), ("with", INPUTS)):
        out = Pipeline(stages=[*L.prepared(inputs), L.ridge(10.0, n, "label")]).fit(train).transform(holdout)
        errors.append(out.agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias(name)))
    return errors[0].crossJoin(errors[1]).select("without", "with", (F.col("without") - F.col("with") > 0.01).alias("keeps"))


@query("L09")
def l09(spark, sf_dir):
    """A calibrated availability classifier and a role regression."""
    train, holdout = (df.withColumn("active", (F.col("qty") > 60).cast("double")) for df in _split(spark, sf_dir, INPUTS))
    model = Pipeline(stages=[*L.prepared(INPUTS), LogisticRegression(labelCol="active", featuresCol="features", maxIter=20)]).fit(train)
    raw = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("features", "prediction", "rawPrediction", "probability")
    isotonic = IsotonicRegression(labelCol="active", featuresCol="p", predictionCol="calibrated").fit(raw(train))
    role = Pipeline(stages=[*L.prepared(["pred", "share"]), L.ridge(1.0, train.count(), "label")]).fit(train)
    scored = isotonic.transform(raw(holdout))
    out = role.transform(scored)
    return out.select("game", F.round("calibrated", 4).alias("p_active"), F.round("prediction", 4).alias("role"))
