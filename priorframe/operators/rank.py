"""Ranks, top-k, replacement levels and lineups as window plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import ordinals


def ordinal(partition: Sequence[str], *order: Column | str) -> Column:
    """Row number as a long, for groups that are small by nature; :func:`ordered.ordinals` numbers groups of any size."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long")


def global_ordinal(df: DataFrame, out: str, *order: Column | str) -> DataFrame:
    """Row numbers over the whole table without one task that sorts it all."""
    return ordinals(df, (), order, out)


def replacement_levels(df: DataFrame, position: str, value: str, tie: str, slots: dict[str, int], flex: Sequence[str], flex_slots: int) -> DataFrame:
    """``(position, replacement)``: the best value left per position once the slots and then the flex slots are filled."""
    starters = F.create_map(*(F.lit(x) for pair in slots.items() for x in pair))
    ranked = ordinals(df.select(position, value, tie), (position,), [F.desc_nulls_last(value), F.col(tie)], "__rank")
    rest = ranked.where(F.col("__rank") > F.coalesce(F.try_element_at(starters, F.col(position)), F.lit(0)))
    pool = rest.where(F.col(position).isin(*flex) & F.col(value).isNotNull()).orderBy(F.desc_nulls_last(value), tie).limit(flex_slots)
    left = rest.join(pool.select(tie), tie, "left_anti")
    return left.groupBy(position).agg(F.max(value).alias("replacement"))


def value_over_replacement(df: DataFrame, levels: DataFrame, position: str, value: str) -> DataFrame:
    """df with ``vor``; positions are few, so their levels are broadcast."""
    joined = df.join(F.broadcast(levels), position, "left")
    return joined.withColumn("vor", F.col(value) - F.coalesce("replacement", F.lit(0.0)))


def hit_rate(df: DataFrame, partition: Sequence[str], first: Column, second: Column, n: int) -> DataFrame:
    """Share of the top n by the first order that are in the top n by the second."""
    a = F.row_number().over(Window.partitionBy(*partition).orderBy(first, "entity")) <= n
    b = F.row_number().over(Window.partitionBy(*partition).orderBy(second, "entity")) <= n
    rows = df.select(*partition, a.alias("a"), b.alias("b"))
    return rows.groupBy(*partition).agg((F.count_if(F.col("a") & F.col("b")) / n).alias("hit_rate"))


def points_lost(df: DataFrame, partition: Sequence[str], score: str, realised: str, k: int) -> DataFrame:
    """Realised sum of the k best in hindsight minus that of the k best by score."""
    by = lambda c: F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc_nulls_last(c), "entity")) <= k
    rows = df.select(*partition, realised, by(score).alias("picked"), by(realised).alias("ideal"))
    total = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col(realised))), F.lit(0.0))
    return rows.groupBy(*partition).agg((total("ideal") - total("picked")).alias("points_lost"))


def best_lineup(df: DataFrame, roster: Sequence[str], position: str, value: str, tie: str, slots: dict[str, int], flex: Sequence[str], flex_slots: int) -> DataFrame:
    """Points of the best legal lineup per roster: position slots first, then the best of the rest in the flex slots."""
    starters = F.create_map(*(F.lit(x) for pair in slots.items() for x in pair))
    rows = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*roster, position).orderBy(F.desc_nulls_last(value), tie)))
    rows = rows.withColumn("__starts", F.col("__rank") <= F.coalesce(F.try_element_at(starters, F.col(position)), F.lit(0)))
    open_ = ~F.col("__starts") & F.col(position).isin(*flex)
    order = Window.partitionBy(*roster, open_).orderBy(F.desc_nulls_last(value), tie)
    rows = rows.withColumn("__flex", open_ & (F.row_number().over(order) <= flex_slots))
    return rows.groupBy(*roster).agg(F.coalesce(F.sum(F.when(F.col("__starts") | F.col("__flex"), F.col(value))), F.lit(0.0)).alias("points"))
