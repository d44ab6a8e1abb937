"""The driver tables seen through the roles of the library: entities, seasons, periods, groups, games and plays.

Money is counted in whole cents, so that sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: entity, season, period, game, grp, team, qty, cents, returned, lines (null without lines)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("qty"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count("*").alias("lines"),
    )
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    return joined.select(
        F.col("o_custkey").alias("entity"),
        F.year("o_orderdate").cast("long").alias("season"),
        F.month("o_orderdate").cast("long").alias("period"),
        F.col("o_orderkey").alias("game"),
        F.col("c_mktsegment").alias("grp"),
        F.col("c_nationkey").cast("long").alias("team"),
        "qty", "cents", "returned", "lines",
    )


FACT = """fact AS (
  SELECT o_custkey AS entity, year(o_orderdate)::BIGINT AS season, month(o_orderdate)::BIGINT AS period, o_orderkey AS game,
         c_mktsegment AS grp, c_nationkey::BIGINT AS team, qty, cents, returned, lines
  FROM orders JOIN customer ON c_custkey = o_custkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents,
                    count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) AS lines
             FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def months(fact: DataFrame) -> DataFrame:
    """One row per entity and period of a season: sums of the fact's values."""
    return fact.groupBy("entity", "season", "period", "grp", "team").agg(
        F.sum("qty").alias("qty"), F.sum("cents").alias("cents"), F.sum("returned").alias("returned"), F.sum("lines").alias("lines"),
        F.count("*").alias("games"),
    )


MONTHS = FACT + """, months AS (
  SELECT entity, season, period, grp, team, sum(qty) AS qty, sum(cents)::BIGINT AS cents, sum(returned)::BIGINT AS returned,
         sum(lines)::BIGINT AS lines, count(*) AS games
  FROM fact GROUP BY ALL)"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as plays: receiver, its team, the opposing team, game, season, period, location, zone, measures."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    # orders find their customers first: lines are shuffled by their order only, which is what groups of games need too
    who = orders.join(customer, orders.o_custkey == customer.c_custkey)
    rows = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(who, line.l_orderkey == orders.o_orderkey)
    return rows.select(
        F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play"), F.col("o_custkey").alias("receiver"),
        F.col("c_nationkey").cast("long").alias("team"), F.col("s_nationkey").cast("long").alias("opponent"),
        F.year("o_orderdate").cast("long").alias("season"), F.month("o_orderdate").cast("long").alias("period"),
        F.col("l_returnflag").alias("location"), F.col("l_linestatus").alias("zone"), F.col("l_suppkey").alias("defender"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").alias("yards"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
    )


PLAYS = """plays AS (
  SELECT l_orderkey AS game, l_linenumber::BIGINT AS play, o_custkey AS receiver, c_nationkey::BIGINT AS team,
         s_nationkey::BIGINT AS opponent, year(o_orderdate)::BIGINT AS season, month(o_orderdate)::BIGINT AS period,
         l_returnflag AS location, l_linestatus AS zone, l_suppkey AS defender, l_partkey AS part, l_quantity AS yards,
         round(l_extendedprice * 100)::BIGINT AS cents, round(l_discount * 100)::BIGINT AS disc
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""
