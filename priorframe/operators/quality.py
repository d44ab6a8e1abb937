"""Validation, quarantine and contracts. Checks return rows; guards raise when the plan runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks; a rule that gives null is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def quarantine(df: DataFrame, rules: Mapping[str, Column], source: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected ones as ``(source, errors, payload)``. Both read one marked scan."""
    marked = df.withColumn("__errors", failed_rules(rules))
    valid = marked.where(F.size("__errors") == 0).drop("__errors")
    rejected = marked.where(F.size("__errors") > 0)
    payload = F.to_json(F.struct(*df.columns))
    return valid, rejected.select(F.lit(source).alias("source"), F.array_join("__errors", ",").alias("errors"), payload.alias("payload"))


def coalesce_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Each name from the first of its aliases that exists and is not null."""
    out = df
    for name, options in aliases.items():
        there = [F.col(c) for c in options if c in df.columns]
        out = out.withColumn(name, F.coalesce(*there) if there else F.lit(None).cast("string"))
    return out


def require(condition: Column, message: str, value: Column) -> Column:
    """The value where the condition holds; otherwise the query fails with the message."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def unknown_labels(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """``(label, n)`` of labels outside the domain, null included."""
    label = F.col(column)
    return df.where(label.isNull() | ~label.isin(*known)).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, null_rate)`` from one aggregation."""
    rates = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return rates.unpivot([], list(columns), "column", "null_rate")


def row_hash(df: DataFrame) -> Column:
    """Sixty bits of the MD5 of a row's columns in the order of their names; doubles count to six places, null is its own text."""

    def text(name: str, kind: str) -> Column:
        value = F.round(F.col(name) * 1_000_000).cast("long") if kind in ("double", "float") else F.col(name)
        return F.coalesce(value.cast("string"), F.lit("\\N"))

    joined = F.concat_ws("|", *(text(c, t) for c, t in sorted(df.dtypes)))
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and a checksum that does not depend on the order of rows."""
    return df.select(row_hash(df).alias("h")).agg(
        F.lit(name).alias("table"), F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.pmod("h", F.lit(1 << 31))), F.lit(0)).alias("checksum")
    )


def equal_on_common_rows(features: DataFrame, outcomes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(column, comparable, leaks)``: a feature leaks if it equals the outcome on every row where both are there."""
    named = outcomes.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = features.select(*keys, *columns).join(named, list(keys))
    both = {c: F.col(c).isNotNull() & F.col(f"__{c}").isNotNull() for c in columns}
    stats = [F.struct(F.lit(c).alias("column"), F.count_if(b).alias("comparable"), F.coalesce(F.bool_and(F.when(b, F.col(c) == F.col(f"__{c}"))), F.lit(False)).alias("leaks")) for c, b in both.items()]
    return joined.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def compare_means(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], rel: float, absolute: float) -> DataFrame:
    """Means per partition and column of two tables that differ by more than both tolerances, or exist in one only."""
    means = lambda df, n: df.groupBy(key).agg(*(F.avg(c).alias(c) for c in columns)).unpivot([key], list(columns), "column", n)
    both = means(a, "left_mean").join(means(b, "right_mean"), [key, "column"], "full")
    gap = F.abs(F.col("left_mean") - F.col("right_mean"))
    allowed = F.greatest(F.lit(absolute), rel * F.greatest(F.abs("left_mean"), F.abs("right_mean")))
    return both.where(F.col("left_mean").isNull() != F.col("right_mean").isNull()).unionByName(both.where(gap > allowed))
