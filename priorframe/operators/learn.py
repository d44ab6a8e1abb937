"""Dataflow around learners: expanding folds, out-of-fold predictions, train-only imputation, floors and stacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Workspace
from .ordered import causal_quantiles, exact_quantiles


def season_folds(df: DataFrame, season: str) -> DataFrame:
    """``(fold, train_season, valid_season)``: every season with all the seasons before it."""
    seasons = df.select(F.col(season).alias("valid_season")).distinct()
    earlier = seasons.select(F.col("valid_season").alias("train_season"))
    pairs = seasons.join(F.broadcast(earlier), F.col("train_season") < F.col("valid_season"))
    first = pairs.groupBy("valid_season").agg(F.count("*").alias("fold"))
    return pairs.join(F.broadcast(first), "valid_season").select("fold", "train_season", "valid_season")


def ridge(alpha: float, n: int, label: str, features: str = "features", prediction: str = "prediction") -> LinearRegression:
    """Least squares with an L2 penalty alpha on the sum of squares: the library's objective is a mean, hence alpha / n."""
    return LinearRegression(
        labelCol=label, featuresCol=features, predictionCol=prediction, elasticNetParam=0.0, regParam=alpha / max(n, 1), standardization=False
    )


def prepared(inputs: Sequence[str]) -> list:
    """The stage from filled columns to a vector."""
    return [VectorAssembler(inputCols=[f"{c}__filled" for c in inputs], outputCol="features")]


def medians(train: DataFrame, inputs: Sequence[str]) -> dict[str, float]:
    """The exact interpolated median of each input over the training rows; without values, zero."""
    found = {c: exact_quantiles(train.select(c), (), c, (0.5,)).first() for c in inputs}
    return {c: r.q[0] if r else 0.0 for c, r in found.items()}


def filled(df: DataFrame, middle: dict[str, float]) -> DataFrame:
    """df with ``<input>__filled``: the input, or the training median where it is missing."""
    return df.withColumns({f"{c}__filled": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(v)) for c, v in middle.items()})


def season_medians(df: DataFrame, season: str, inputs: Sequence[str]) -> dict[int, dict[str, float]]:
    """For each season, the medians of the inputs over all earlier seasons; one pass an input for all folds."""
    out: dict[int, dict[str, float]] = {}
    for c in inputs:
        for r in causal_quantiles(df.select(season, c), season, c, (0.5,), 1).collect():  # a row a season
            out.setdefault(r[season], {})[c] = r.q[0]
    return out


def walk_forward(
    df: DataFrame, season: str, inputs: Sequence[str], label: str, learner: Callable[[int], Estimator], workspace: Workspace | None = None
) -> DataFrame:
    """Out-of-fold predictions of each season by a model of the seasons before, stamped with the last season it saw.

    The rows are written once and every fold reads that table; the predictions are written too, so that a stage after
    this one learns from a table. Seasons without earlier labelled rows have none.
    """
    work = workspace or Workspace(df.sparkSession, "folds")
    source = work.save(df, "rows")
    known = source.where(F.col(label).isNotNull()).groupBy(season).agg(F.count("*").alias("n")).collect()  # a row a season
    middle = season_medians(source.where(F.col(label).isNotNull()), season, inputs)
    valid = sorted(r[season] for r in source.select(season).where(F.col(season).isNotNull()).distinct().collect())
    parts = []
    for k in valid:
        seen = {r[season]: r.n for r in known if r[season] is not None and r[season] < k}
        if not seen:
            continue
        fill = {c: middle.get(k, {}).get(c, 0.0) for c in inputs}
        train = filled(source.where((F.col(season) < k) & F.col(label).isNotNull()), fill)
        model = Pipeline(stages=[*prepared(inputs), learner(sum(seen.values()))]).fit(train)
        out = model.transform(filled(source.where(F.col(season) == k), fill))
        parts.append(out.select(*df.columns, "prediction", F.lit(max(seen)).cast("long").alias("max_train_season")))
    none = source.limit(0).select("*", F.lit(None).cast("double").alias("prediction"), F.lit(None).cast("long").alias("max_train_season"))
    return work.save(reduce(DataFrame.unionByName, parts or [none]), "predictions")


def weighted_cell(predictions: dict[str, float], intercept: float) -> tuple[Column, Column]:
    """Sum of weight times base prediction plus intercept, and whether a base of non-zero weight was missing."""
    used = {c: w for c, w in predictions.items() if w != 0}
    terms = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in used.items()]
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in used), F.lit(False))
    return reduce(lambda a, b: a + b, terms, F.lit(intercept)), missing
