"""Global order over few or large groups: row numbers, tie ranks and exact quantiles without a task that holds a group.

Rows are dealt to ranges of (keys, order), sorted inside each range and written once, with a number that names the range
and the place in it. All that follows reads this one written table: two evaluations of a range partitioning sample
the data anew and need not agree on its borders. What is known of a range (its rows for each key) is a small table,
whose running sums shift the places.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import Workspace

#: monotonically_increasing_id holds the partition above this bit and the row in the partition below it.
ROW_BITS = 33


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null meets null; right's other columns must have other names than left's."""
    named = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys))
    return left.join(named, on, how).drop(*(f"__right_{k}" for k in keys))


def deal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], workspace: Workspace | None = None) -> DataFrame:
    """df in sorted ranges, written once: with ``__at`` (rises with the order) and ``__part`` (the range's number).

    The number of ranges is the session's number of shuffle partitions, fewer where they would be small.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    saved = (workspace or Workspace(df.sparkSession, "ranges")).save(rows, "ranges")
    return saved.withColumn("__part", F.shiftright("__at", ROW_BITS))


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], workspace: Workspace | None) -> DataFrame:
    """The dealt rows with ``__place`` in the group and the group's ``__size``."""
    dealt = deal(df, keys, order, workspace)
    by = ["__part", *keys]
    sizes = dealt.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy(*keys)
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*by, "__first", F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__n").over(group).alias("__size"))
    return null_safe_join(dealt, starts, by).withColumn("__place", F.col("__at") - F.col("__first") + F.col("__start") + 1)


def ordinals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str, total: str | None = None, workspace: Workspace | None = None
) -> DataFrame:
    """df with the row number of each row in its group (null keys are a group), and the group's size if asked for.

    ``order`` should end with a unique column, else rows of equal order come in any order, as with row_number.
    """
    rows = _placed(df, keys, order, workspace)
    return rows.select(*df.columns, F.col("__place").alias(out), *([F.col("__size").alias(total)] if total else []))


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, out: str, descending: bool = False, total: str | None = None, workspace: Workspace | None = None
) -> DataFrame:
    """df with the rank of its value in the group, ties sharing the mean of their places, and the group's size if asked for.

    A value that many rows have may span ranges: each range says which places it holds of a value, the first and the last
    of all are taken from these, and go back to the range's rows. So a frequent value is never one task's.
    """
    by = F.desc(value) if descending else F.asc(value)
    rows = _placed(df, keys, [by, F.xxhash64(*df.columns)], workspace)
    held = rows.groupBy("__part", *keys, value).agg(F.min("__place").alias("__low"), F.max("__place").alias("__high"))
    same = Window.partitionBy(*keys, value)
    mean = held.select("__part", *keys, value, ((F.min("__low").over(same) + F.max("__high").over(same)) / 2).alias("__mean"))
    rows = null_safe_join(rows, mean, ["__part", *keys, value])
    return rows.select(*df.columns, F.col("__mean").alias(out), *([F.col("__size").alias(total)] if total else []))


def tile(place: str, n: str, buckets: int) -> Column:
    """The equal-count bucket of a place among n: the first n mod buckets buckets have one row more."""
    size, extra = F.floor(F.col(n) / buckets), F.col(n) % buckets
    large = extra * (size + 1)
    low = F.floor((F.col(place) - 1) / (size + 1)) + 1
    high = extra + F.floor((F.col(place) - 1 - large) / F.nullif(size, F.lit(0))) + 1
    return F.when(F.col(place) <= large, low).otherwise(high).cast("long")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], least: int = 1, out: str = "q", n: str = "n",
    members: Callable[[DataFrame], DataFrame] | None = None, workspace: Workspace | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of each group with ``least`` values or more: ``(*keys, out array, n)``; nulls are left out.

    Equal rows are counted first and dealt to ranges of the value. Counts of ranges say in which range a wanted place
    lies, and only that range's rows are looked at. ``members`` may turn a row into the groups it belongs to (for example
    all later seasons), without copying rows into a shuffle: its output must have the columns ``keys``, value, ``__c``
    and ``__part``.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*df.columns).agg(F.count("*").alias("__c"))
    dealt = deal(counted, (), [value], workspace).drop("__at")
    belongs = members or (lambda rows: rows)
    sizes = belongs(dealt).groupBy(*keys, "__part").agg(F.sum("__c").alias("__n"))
    group = Window.partitionBy(*keys)
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.select(*keys, "__part", "__n", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("__all"))
    spots = [(F.col("__all") - 1) * p for p in probabilities]
    places = F.array_distinct(F.array(*(f(s).cast("long") + 1 for s in spots for f in (F.floor, F.ceil))))
    wanted = parts.where(F.col("__all") >= least).select(*keys, "__part", "__before", "__n", "__all", F.explode(places).alias("__place"))
    wanted = wanted.where(F.col("__place").between(F.col("__before") + 1, F.col("__before") + F.col("__n"))).drop("__n")
    wanted = (workspace or Workspace(df.sparkSession, "places")).save(wanted, "places")
    by = [*keys, "__part"]
    near = null_safe_join(belongs(dealt), wanted, by).groupBy(*keys, "__place", "__before", "__all", value).agg(F.sum("__c").alias("__c"))
    upto = Window.partitionBy(*keys, "__place").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    reached = near.withColumn("__upto", F.col("__before") + F.sum("__c").over(upto)).where("__upto >= __place")
    found = reached.groupBy(*keys, "__all", "__place").agg(F.min(value).cast("double").alias("__v"))
    rows = found.groupBy(*keys, "__all").agg(F.map_from_entries(F.collect_list(F.struct("__place", "__v"))).alias("__m"))  # two places a probability
    at = lambda f, s: F.element_at("__m", f(s).cast("long") + 1)
    q = [at(F.floor, s) + (at(F.ceil, s) - at(F.floor, s)) * (s - F.floor(s)) for s in spots]
    return rows.select(*keys, F.array(*q).alias(out), F.col("__all").alias(n))


def causal_quantiles(
    df: DataFrame, season: str, value: str, probabilities: Sequence[float], least: int, workspace: Workspace | None = None
) -> DataFrame:
    """For each season, quantiles over all strictly earlier seasons with ``least`` values or more: ``(season, q, n_residuals)``.

    A row counts for each later season in its range's counts; it is not copied into a shuffle.
    """
    seasons = df.select(F.col(season).alias("__target")).where("__target is not null").distinct()
    later = lambda rows: rows.join(F.broadcast(seasons), F.col(season) < F.col("__target"))
    found = exact_quantiles(df.select(season, value), ["__target"], value, probabilities, least, n="n_residuals", members=later, workspace=workspace)
    return found.withColumnRenamed("__target", season)
