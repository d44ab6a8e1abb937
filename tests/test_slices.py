"""As-of joins of frequent entities over slices of time, and what changes only now and then."""

import random

import pytest
from pyspark.sql import functions as F

from priorframe.operators import learn, temporal
from priorframe.sources.tables import Workspace


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
def test_slices_change_nothing(spark, strict, forward):
    rng = random.Random(3)
    when = lambda: None if rng.random() < 0.03 else rng.randrange(400)
    left = spark.createDataFrame([(n, rng.choice(["hot", "hot", "hot", "a", "late", None]), when()) for n in range(600)], "n long, k string, t long")
    rows = [(rng.choice(["hot", "hot", "a", None]), when(), rng.randrange(5)) for _ in range(500)] + [("late", 399, 1), ("late", 2, 7)]
    right = spark.createDataFrame(rows, "k string, at long, v long")
    join = lambda slices: temporal.asof_join(left, right, ["k"], "t", "at", ["v"], strict=strict, forward=forward, slices=slices)
    plain = lambda df: sorted(map(str, df.select("n", "v", "at").collect()))
    assert plain(join(13)) == plain(join(1))
    stamps = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    timed = temporal.asof_join(stamps(left, "t"), stamps(right, "at"), ["k"], "t", "at", ["v"], strict=strict, forward=forward, slices=13)
    assert plain(timed.withColumn("at", F.unix_seconds("at"))) == plain(join(1))


def test_one_entity_is_many_groups(spark):
    """Half a million rows of one entity: no slice holds more than a few per cent, and the rows are those of the formula."""
    left = spark.range(250_000).select(F.lit(1).alias("k"), (F.col("id") * 4 + 1).alias("t"))
    right = spark.range(250_000).select(F.lit(1).alias("k"), (F.col("id") * 4).alias("at"), F.col("id").alias("v"))
    got = temporal.asof_join(left, right, ["k"], "t", "at", ["v"], slices=32)
    assert got.where("at <> t - 1 or v <> (t - 1) / 4 or at is null").count() == 0 and got.count() == 250_000
    cuts = temporal.time_slices(right, "at", 32)
    share = right.select(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("at"))).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert len(cuts) >= 28 and share < 0.06 * 250_000


def test_right_side_without_rows(spark):
    left = spark.createDataFrame([(1, 5)], "k long, t long")
    right = spark.createDataFrame([], "k long, at long, v long")
    assert temporal.asof_join(left, right, ["k"], "t", "at", ["v"], slices=8).first().v is None


def test_walk_forward_medians_and_sources(spark):
    """Each fold is filled with the exact medians of earlier seasons, and the source is evaluated once."""
    rng = random.Random(1)
    rows = [(s, rng.choice([None, rng.gauss(0, 1), rng.gauss(9, 1)]), rng.gauss(3, 1)) for s in (1990, 1991, 1993) for _ in range(200)] + [(None, 1.0, 1.0)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(rows, "season long, x double, y double").withColumn("y", counted("y"))
    out = learn.walk_forward(df, "season", ["x"], "y", lambda n: learn.ridge(1.0, n, "y"), Workspace(spark, "wf")).collect()
    assert {r.season for r in out} == {1991, 1993} and {r.max_train_season for r in out if r.season == 1993} == {1991}
    assert seen.value == len(rows)
    middle = learn.season_medians(df.drop("y"), "season", ["x"])
    for season in (1991, 1993):
        values = sorted(x for s, x, _ in rows if s is not None and s < season and x is not None)
        n = len(values)
        assert middle[season]["x"] == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2)
    missing = [r for r in out if r.season == 1993 and r.x is None]
    assert missing and len({r.prediction for r in missing}) == 1


def test_the_matrix_is_shuffled_for_its_large_joins_only(spark, sf):
    """Tables of teams and periods meet the wide rows of C01 by their written size, not in a sort-merge join."""
    from priorframe.plans import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20KB")
    try:
        plan = QUERIES["C01"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    heads = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert not any(f"[{keys}" in h for h in heads for keys in ("team#", "season#", "opponent#") if "entity#" not in h), heads
    assert len(heads) <= 8, heads
