"""Windows over strictly earlier rows, as-of joins and lag joins. None of them sees the present or the future."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import null_safe_join


def prior_window(partition: Sequence[str], order: Sequence[str], n: int | None = None) -> WindowSpec:
    """Rows before the present one, all or the last ``n``."""
    start = Window.unboundedPreceding if n is None else -n
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(start, -1)


def prior_values(partition: Sequence[str], key: str, first=Window.unboundedPreceding) -> WindowSpec:
    """Rows of a lower integer key than the present one, whatever the number of rows a key has."""
    return Window.partitionBy(*partition).orderBy(key).rangeBetween(first, -1)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is null or zero."""
    return F.when(denominator != 0, numerator / denominator)


def trailing_mean(df: DataFrame, value: str, n: int, partition: Sequence[str], order: Sequence[str], out: str, skip_null: bool = False) -> DataFrame:
    """Mean of the last n rows, nulls counting as rows; with skip_null, of the last n rows that have a value."""
    if not skip_null:
        return df.withColumn(out, F.avg(value).over(prior_window(partition, order, n)))
    # the mean up to each row that has a value, among those rows alone, is carried to the rows after it; rows dealt by the
    # coarser key serve both windows
    df = df.repartition(*partition)
    there = Window.partitionBy(*partition, F.col(value).isNull()).orderBy(*order).rowsBetween(1 - n, 0)
    rows = df.withColumn("__mean", F.when(F.col(value).isNotNull(), F.avg(value).over(there)))
    return rows.withColumn(out, F.last("__mean", ignorenulls=True).over(prior_window(partition, order))).drop("__mean")


def _moment(df: DataFrame, column: str) -> Column:
    """A time as a number: microseconds of a timestamp, days of a date, a number itself."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if kind == "date" else F.col(column)


def time_slices(df: DataFrame, column: str, slices: int) -> list:
    """At most ``slices`` - 1 times that cut df's rows into parts of about equal size (a bounded sketch, a few numbers)."""
    shares = [k / slices for k in range(1, slices)]
    cuts = df.agg(F.percentile_approx(_moment(df, column), shares, 100 * slices).alias("cuts")).first().cuts
    return sorted(set(cuts or []))


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str],
    strict: bool = False, forward: bool = False, prefix: str = "", slices: int = 1,
) -> DataFrame:
    """Each left row with the values of the nearest right row before it (or after it, ``forward``) of the same keys.

    One union, one shuffle and one sort: rows do not multiply, and null times never match. ``strict`` leaves out right
    rows of the same time. Of right rows with one time the greatest values win (the smallest, ``forward``).

    With ``slices`` above one a key's rows are dealt to slices of time, so that a frequent key is many groups; what the
    slices before (after, ``forward``) hold last is carried over from a table of one row for each key and slice.
    """
    left_side = int(strict == forward)  # whether a left row sorts after right rows of the same time
    row, taken = F.struct(*left.columns), F.struct(F.col(right_time).alias("__at"), *(F.col(v) for v in values))
    cuts = time_slices(right, right_time, slices) if slices > 1 else []
    number = lambda df, c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < _moment(df, c))) if cuts else F.lit(0)
    lefts = left.select(*keys, F.col(left_time).alias("__time"), F.lit(left_side).alias("__side"), row.alias("__row"), F.lit(None).alias("__taken"), number(left, left_time).alias("__slice"))
    rights = right.where(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("__time"), F.lit(1 - left_side).alias("__side"), F.lit(None).alias("__row"), taken.alias("__taken"), number(right, right_time).alias("__slice")
    )
    by = [*keys, "__slice"]
    both = lefts.unionByName(rights)
    both = both.repartition(*by) if cuts else both  # the windows and the carried rows share this shuffle
    order = [F.col("__time").asc(), F.col("__side").asc(), F.col("__taken").asc_nulls_first()]
    if forward:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
        found = F.first("__taken", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        found = F.last("__taken", ignorenulls=True).over(w)
    rows = both.withColumn("__found", found).where(F.col("__row").isNotNull())
    if cuts:
        ends = both.groupBy(*by).agg((F.min if forward else F.max)("__taken").alias("__end"))
        along = Window.partitionBy(*keys).orderBy("__slice")
        if forward:
            carried = F.first("__end", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
        else:
            carried = F.last("__end", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        rows = null_safe_join(rows, ends.select(*by, carried.alias("__carried")), by, "left").withColumn("__found", F.coalesce("__found", "__carried"))
    seen = F.col("__time").isNotNull()
    picked = [F.when(seen, F.col(f"__found.{v}")).alias(prefix + v) for v in values]
    return rows.select("__row.*", *picked, F.when(seen, F.col("__found.__at")).alias(f"{prefix}{right_time}"))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in this order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def lag_join(df: DataFrame, history: DataFrame, keys: Sequence[str], season: str, lag: int, values: dict[str, str]) -> DataFrame:
    """df with values of ``lag`` seasons before, as ``{value: name}``; history has one row per key and season."""
    shifted = history.select(*keys, (F.col(season) + lag).alias(season), *(F.col(v).alias(n) for v, n in values.items()))
    return df.join(shifted, [*keys, season], "left")


def period_spine(df: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Every period from 1 to one after the last of each key."""
    last = df.groupBy(*keys).agg(F.max(period).alias("__last"))
    return last.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__last") + 1)).alias(period))


def run_length(df: DataFrame, state: str, partition: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Length of the run of true states that ends just before each row."""
    w = Window.partitionBy(*partition).orderBy(*order)
    island = F.sum(F.when(F.col(state), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("__island", island)
    length = F.count_if(F.col(state)).over(Window.partitionBy(*partition, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__run", length)
    return rows.withColumn(out, F.coalesce(F.lag("__run").over(w), F.lit(0))).drop("__island", "__run")


def kalman_fold(values: Column, start: Column, r: Column, q: float, p0: float) -> Column:
    """Posterior ``(mean, var)`` of a scalar filter over an array of values, oldest first, from the prior ``(start, p0)``."""

    def step(acc: Column, x: Column) -> Column:
        var = acc["var"] + q
        gain = var / (var + r)
        return F.struct((acc["mean"] + gain * (x - acc["mean"])).alias("mean"), ((1 - gain) * var).alias("var"))

    return F.aggregate(values, F.struct(start.cast("double").alias("mean"), F.lit(p0).alias("var")), step)


def filtered_form(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, prior: Column, q: float, default_r: float, p0: float, out: str, least_r: float = 1e-6
) -> DataFrame:
    """df with the filtered level before each row of a key: ``out`` with the posterior mean and variance.

    The filter starts from a prior mean and variance p0 and takes in every earlier row; a null counts as the prior mean. The
    observation variance is the sample variance of the earlier values (at least ``least_r``), or ``default_r`` below two
    values. Without earlier rows the answer is the prior. The variance changes with every row, so each row folds its
    earlier ones anew; a key's rows (one season of one entity) are one short array, built once.
    """
    before = prior_window(keys, order)
    r = F.when(F.count(value).over(before) >= 2, F.greatest(F.var_samp(value).over(before), F.lit(least_r))).otherwise(F.lit(default_r))
    names = [c for c in df.columns if c not in (*keys, *order)]
    rows = df.withColumns({"__prior": prior.cast("double"), "__r": r})
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *names, "__prior", "__r"))).alias("__rows"))
    filled = F.transform("__rows", lambda x: F.coalesce(x[value].cast("double"), x["__prior"]))
    folded = lambda x, k: F.struct(x.alias("row"), kalman_fold(F.slice(filled, 1, k), x["__prior"], x["__r"], q, p0).alias("form"))
    each = listed.select(*keys, F.explode(F.transform("__rows", folded)).alias("__x"))
    return each.select(*(F.col(c) if c in keys else F.col(f"__x.row.{c}").alias(c) for c in df.columns), F.col("__x.form").alias(out))
