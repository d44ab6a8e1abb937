"""Forecast metrics, causal intervals, calibration tables and gates as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import normal_cdf
from .ordered import ordinals


def both_present(*columns: str) -> Column:
    """True where every column has a finite value."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def error_metrics(actual: str, predicted: str) -> list[Column]:
    """mae, rmse and bias over pairs without nulls."""
    error = F.col(predicted) - F.col(actual)
    return [F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias")]


def pinball(actual: Column, predicted: Column, tau: float) -> Column:
    gap = actual - predicted
    return F.avg(F.greatest(tau * gap, (tau - 1) * gap))


def poisson_deviance(actual: Column, predicted: Column, floor: float = 1e-9) -> Column:
    mean = F.greatest(predicted, F.lit(floor))
    log_term = F.when(actual > 0, actual * F.log(actual / mean)).otherwise(0.0)
    return F.avg(2 * (log_term - (actual - mean)))


def crps_samples(samples: Column, actual: Column) -> Column:
    """Continuous ranked probability score of an array of samples: mean distance minus half the mean spread.

    Samples are sorted once, which turns the double sum of the spread into a weighted single one.
    """
    s, n = F.array_sort(samples), F.size(samples)
    distance = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.abs(x - actual)) / n
    spread = F.aggregate(
        F.transform(s, lambda x, i: x * (2 * i + 1 - n)), F.lit(0.0), lambda a, x: a + x
    ) / (n * n)
    return F.when(n > 0, distance - spread)


def crps_gaussian(actual: Column, mean: Column, sigma: Column) -> Column:
    z = (actual - mean) / sigma
    density = F.exp(-z * z / 2) / F.sqrt(F.lit(2.0) * F.pi())
    return sigma * (z * (2 * normal_cdf(z) - 1) + 2 * density - 1 / F.sqrt(F.pi()))


def coverage(actual: str, low: str, high: str) -> Column:
    return F.avg(F.col(actual).between(F.col(low), F.col(high)).cast("double"))


def order_statistic_radius(df: DataFrame, keys: Sequence[str], residual: str, share: float, least: int) -> DataFrame:
    """The ceil((n+1) share)-th smallest absolute residual per key, n at least ``least``; no interpolation."""
    rows = df.where(F.col(residual).isNotNull()).select(*keys, F.abs(residual).alias("__abs"))
    rows = ordinals(rows, keys, ["__abs"], "__place", "__n")
    wanted = F.least(F.ceil((F.col("__n") + 1) * share), F.col("__n"))
    return rows.where((F.col("__n") >= least) & (F.col("__place") == wanted)).select(*keys, F.col("__abs").alias("radius"))


def calibration_table(df: DataFrame, probability: str, outcome: str, bins: int) -> DataFrame:
    """Equal-width bins of a probability: mean probability, observed share, count."""
    bin_ = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(bin_).agg(F.avg(probability).alias("mean_p"), F.avg(outcome).alias("observed"), F.count("*").alias("n"))


# The cumulative distribution of Poisson(1).
POISSON_ONE = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def poisson_one_weight(cluster: Column, replicate: Column, seed: int) -> Column:
    """A Poisson(1) count from a hash of cluster, replicate and seed."""
    mark = F.md5(F.concat_ws("|", cluster.cast("string"), replicate.cast("string"), F.lit(str(seed))).cast("binary"))
    u = F.conv(F.substring(mark, 1, 10), 16, 10).cast("long") / float(1 << 40)
    out = F.lit(0)
    for cut in POISSON_ONE:
        out = out + (u > cut).cast("int")
    return out


def bootstrap_mean(df: DataFrame, cluster: Sequence[str], value: str, n_boot: int, seed: int, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Mean with a cluster bootstrap interval. Rows are summed per cluster first; only the sums meet the replicates."""
    sums = df.groupBy(*by, *cluster).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    rows = sums.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
    rows = rows.withColumn("__w", poisson_one_weight(F.concat_ws("|", *(F.col(c).cast("string") for c in cluster)), F.col("__r"), seed))
    means = rows.groupBy(*by, "__r").agg((F.sum(F.col("__w") * F.col("__s")) / F.nullif(F.sum(F.col("__w") * F.col("__n")), F.lit(0))).alias("__m"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*by).agg(F.percentile("__m", tail).alias("low"), F.percentile("__m", 1 - tail).alias("high"))
    point = sums.groupBy(*by).agg((F.sum("__s") / F.sum("__n")).alias("mean"))
    return point.join(bounds, list(by)) if by else point.crossJoin(bounds)


def improvement_gate(candidate: Column, incumbent: Column, least_percent: float) -> Column:
    """True if the candidate's error is lower by at least this percentage of the incumbent's."""
    return F.when(incumbent > 0, (incumbent - candidate) / incumbent * 100 >= least_percent).otherwise(F.lit(False))
