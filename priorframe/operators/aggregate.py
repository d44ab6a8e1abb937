"""Grouped measures: guarded ratios, shares, shrinkage, modes and weighted means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def share_of(value: str, partition: Sequence[str]) -> Column:
    """A value's share of its group's total; null for an empty or zero total."""
    return ratio(F.col(value), F.sum(value).over(Window.partitionBy(*partition)))


def shrink(value: Column, n: Column, prior: Column, k: float) -> Column:
    """n/(n+k) of a cell's own value and the rest of a coarser one; the prior where the cell is empty."""
    weight = n / (n + F.lit(k))
    return F.coalesce(weight * value + (1 - weight) * prior, prior)


def shrunk_means(df: DataFrame, cell: Sequence[str], coarse: Sequence[str], value: str, k: float) -> DataFrame:
    """Cell means shrunk to the means of coarser cells, from sums of both, in one pass over the rows."""
    cells = df.groupBy(*cell).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    w = Window.partitionBy(*coarse)
    prior = ratio(F.sum("total").over(w), F.sum("n").over(w))
    rows = cells.withColumn("prior", prior).withColumn("mean", ratio(F.col("total"), F.col("n")))
    return rows.withColumn("shrunk", shrink(F.col("mean"), F.col("n"), F.col("prior"), k)).drop("total")


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent non-null value per key, ties to the smaller value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(value))


def recency_mean(value: str, age: Column, decay: float) -> Column:
    """Mean with weights decay ** age."""
    weight = F.pow(F.lit(decay), age)
    return F.sum(F.when(F.col(value).isNotNull(), weight * F.col(value))) / F.sum(F.when(F.col(value).isNotNull(), weight))
