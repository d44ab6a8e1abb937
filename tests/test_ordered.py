"""Places, tie ranks and quantiles from dealt ranges, against one sort."""

import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.operators import ordered as O


@pytest.fixture
def ranges(spark):
    """More ranges than the local default, kept apart."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_million_rows_with_carried_columns(spark, ranges):
    rows = spark.range(1_000_000).select("id", (F.xxhash64("id") % 5000).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("carried"))
    got = O.ordinals(rows, (), [F.desc("v"), F.col("id")], "place", "n")
    check = got.agg(F.count("*"), F.min("place"), F.max("place"), F.count_distinct("place"), F.min("n"), F.max("n"), F.count_distinct("carried")).first()
    assert tuple(check) == (1_000_000, 1, 1_000_000, 1_000_000, 1_000_000, 1_000_000, 1_000_000)
    want = rows.select("id", F.row_number().over(Window.orderBy(F.desc("v"), "id")).alias("want"))
    assert got.join(want, "id").where("place <> want").count() == 0


def test_one_group_over_many_ranges(spark, ranges):
    """One group holds nearly all rows and one value a third of them; no range holds the group."""
    value = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(400)))
    rows = spark.range(200_000).select("id", F.when(F.col("id") % 1000 == 0, F.col("id") % 3).alias("k"), value.alias("v"))
    group = Window.partitionBy("k")
    ties = F.count("*").over(Window.partitionBy("k", "v"))
    want = rows.select("id", (F.rank().over(group.orderBy(F.desc("v"))) + (ties - 1) / 2).alias("want"), F.count("*").over(group).alias("size"))
    got = O.average_ranks(rows, ["k"], "v", "r", descending=True, total="n")
    assert got.join(want, "id").where("r <> want or n <> size").count() == 0 and got.count() == 200_000
    placed = O._placed(rows, ["k"], [F.desc("v"), F.xxhash64("id")], None)
    assert placed.where("k is null").select("__part").distinct().count() >= 8
    assert placed.where("k is null and v = 7").select("__part").distinct().count() >= 3
    bucket = O.ordinals(rows, ["k"], ["v", "id"], "p", "n").select("id", O.tile("p", "n", 7).alias("b"))
    other = rows.select("id", F.ntile(7).over(group.orderBy("v", "id")).alias("w"))
    assert bucket.join(other, "id").where("b <> w").count() == 0


def interpolated(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def test_quantiles_of_groups(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 3.0, rng.gauss(0, 5), float(rng.randrange(9))])) for _ in range(5000)] + [("few", 1.0), ("few", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q, r.n) for r in O.exact_quantiles(df, ["k"], "v", (0.0, 0.1, 0.5, 0.99, 1.0), least=2).collect()}
    want = {k: [v for key, v in rows if key == k and v is not None] for k in ("a", "b", None, "few")}
    assert set(got) == set(want)
    for k, values in want.items():
        assert got[k][1] == len(values) and got[k][0] == pytest.approx([interpolated(values, p) for p in (0.0, 0.1, 0.5, 0.99, 1.0)])
    whole = O.exact_quantiles(df.select("v"), (), "v", (0.5,)).collect()
    assert [r.q[0] for r in whole] == [pytest.approx(statistics.median(v for _, v in rows if v is not None))]
    assert O.exact_quantiles(df.limit(0), ["k"], "v", (0.5,)).count() == 0


def test_quantiles_of_earlier_seasons(spark, ranges):
    rng = random.Random(2)
    rows = [(rng.randrange(1990, 1996), rng.gauss(0, 3)) for _ in range(3000)] + [(None, 1.0), (1990, None)]
    got = {r.season: (r.q, r.n_residuals) for r in O.causal_quantiles(spark.createDataFrame(rows, "season long, r double"), "season", "r", (0.1, 0.9), 600).collect()}
    want = {s: [v for t, v in rows if t is not None and v is not None and t < s] for s in range(1990, 1996)}
    want = {s: v for s, v in want.items() if len(v) >= 600}
    assert set(got) == set(want) and len(want) == 4
    for s, values in want.items():
        assert got[s][1] == len(values) and got[s][0] == pytest.approx([interpolated(values, p) for p in (0.1, 0.9)])
