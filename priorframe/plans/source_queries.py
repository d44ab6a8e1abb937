"""Scans, sources and sinks (S), with their SQL. What is written goes to a workspace and is read back."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..sources import tables as T
from .facts import FACT, MONTHS, facts, months, table
from .registry import query

KEYS = ["entity", "season", "period"]
HALF = "CASE WHEN entity % 2 = 0 THEN qty + 1 ELSE NULL END"


def _month(spark, sf_dir):
    return months(facts(spark, sf_dir)).select(*KEYS, "qty", "lines")


@query("S01", f"WITH {FACT} SELECT season, entity, qty FROM fact WHERE season IN (1999, 2000)")
def s01(spark, sf_dir):
    w = T.Workspace(spark, "facts")
    w.save(facts(spark, sf_dir), "fact", ["season"])
    return T.scan(spark, f"{w.path}/fact", "season", [1999, 2000], ["season", "entity", "qty"]).withColumn("season", F.col("season").cast("long"))


@query("S02", f"WITH {FACT} SELECT entity, season, period, game FROM fact WHERE (season, period) < (2000, 3) AND entity IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def s02(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("entity"))
    return T.scan_before(facts(spark, sf_dir), keys, "entity", "season", "period", (2000, 3)).select("entity", "season", "period", "game")


@query("S03", "SELECT o_orderkey, o_totalprice, 'part' AS stem FROM orders")
def s03(spark, sf_dir):
    w = T.Workspace(spark, "csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").write.csv(f"{w.path}/orders", header=True)
    return T.read_named_csv(spark, f"{w.path}/orders", "o_orderkey long, o_totalprice double")


@query("S04", "SELECT p_partkey AS player, p_size AS pick FROM part")
def s04(spark, sf_dir):
    w = T.Workspace(spark, "headers")
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Player ID"), F.col("p_size").alias(" ADP")).write.csv(f"{w.path}/part", header=True, ignoreLeadingWhiteSpace=False)
    rows = spark.read.csv(f"{w.path}/part", header=True, schema="`Player ID` long, ` ADP` int", enforceSchema=True)
    names = T.resolve_headers(rows.columns, {"player": ("id", "player id"), "pick": ("adp", "avg")})
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))


@query("S05", "SELECT event_id, user_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def s05(spark, sf_dir):
    """Nested documents written as JSON and read back flat with a declared schema."""
    w = T.Workspace(spark, "json")
    nested = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", F.struct("props").alias("body"))).alias("items"))
    nested.write.json(f"{w.path}/events")
    rows = spark.read.schema("user_id long, items array<struct<event_id: bigint, body: struct<props: string>>>").json(f"{w.path}/events")
    flat = rows.select("user_id", F.explode("items").alias("i"))
    return flat.select("i.event_id", "user_id", F.from_json("i.body.props", "k bigint")["k"].alias("k"))


@query("S06", """WITH a AS (SELECT l_orderkey AS game, list(l_linenumber::BIGINT ORDER BY l_linenumber, l_quantity) AS hours, list(l_quantity ORDER BY l_linenumber, l_quantity) AS vals FROM lineitem GROUP BY 1)
SELECT game, coalesce(vals[list_position(hours, 3)], vals[1]) AS value, list_position(hours, 3) IS NOT NULL AS hour_matched FROM a""")
def s06(spark, sf_dir):
    """The value at a target hour of nested arrays, else the first, with a flag that says which."""
    order = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("h"), F.col("l_quantity").alias("v"))))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(order.alias("a"))
    at = F.array_position(F.col("a.h"), F.lit(3).cast("long"))
    return rows.select("game", F.when(at > 0, F.try_element_at("a.v", at.cast("int"))).otherwise(F.col("a")[0]["v"]).alias("value"), (at > 0).alias("hour_matched"))


_CACHE: dict[str, tuple[float, str]] = {}


@query("S07", f"WITH {FACT} SELECT entity, season, qty FROM fact WHERE season >= 2000")
def s07(spark, sf_dir):
    """A written cache keyed by content (seasons, row count, checksum) with a maximal age."""
    rows = facts(spark, sf_dir).where("season >= 2000").select("entity", "season", "qty")
    mark = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("o_orderkey", "o_custkey", "o_orderdate")).alias("x")).first()
    key = f"{spark.sparkContext.applicationId}-2000-{mark.n}-{mark.x}"
    if key not in _CACHE or time.time() - _CACHE[key][0] > 3600:
        w = T.Workspace(spark, "cache")
        w.save(rows, "rows")
        _CACHE[key] = (time.time(), f"{w.path}/rows")
    return spark.read.schema(rows.schema).parquet(_CACHE[key][1])


@query("S08", "SELECT 'orders' AS source_type, year(o_orderdate)::INTEGER AS season, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY ALL UNION ALL SELECT 'events', year(ts)::INTEGER, count(*) FROM events GROUP BY ALL")
def s08(spark, sf_dir):
    """Validated rows of two sources appended to one staging table as JSON."""
    w = T.Workspace(spark, "staging")
    orders, events = table(spark, sf_dir, "orders").where("o_totalprice > 1000"), table(spark, sf_dir, "events")
    for name, rows, stamp in (("orders", orders, "o_orderdate"), ("events", events, "ts")):
        staged = rows.select(F.lit(name).alias("source_type"), F.year(stamp).alias("season"), F.to_json(F.struct(*rows.columns)).alias("payload"))
        staged.write.mode("append").partitionBy("source_type", "season").parquet(f"{w.path}/staging")
    return spark.read.parquet(f"{w.path}/staging").groupBy("source_type", "season").agg(F.count("*").alias("n"))


@query("S09", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s09(spark, sf_dir):
    """Staged files consumed once by a checkpointed stream: a second run finds nothing new."""
    w = T.Workspace(spark, "once")
    staged = w.save(table(spark, sf_dir, "events").repartition(4), "staged")
    for _ in range(2):
        rows = spark.readStream.schema(staged.schema).parquet(f"{w.path}/staged")
        run = rows.writeStream.format("parquet").option("checkpointLocation", f"{w.path}/mark").trigger(availableNow=True).start(f"{w.path}/out")
        run.awaitTermination()
    return spark.read.schema(staged.schema).parquet(f"{w.path}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def _versioned(spark, rows):
    """The rows as a versioned table by season."""
    held = T.VersionedTable(spark, T.Workspace(spark, "versioned").path, rows.schema, "season")
    held.append(rows)
    return held


@query("S10", f"WITH {MONTHS} SELECT entity, season, period, CASE WHEN entity % 2 = 0 THEN qty + 1 ELSE qty END AS qty FROM months UNION ALL SELECT -1, 2002, 1, 5.0")
def s10(spark, sf_dir):
    """Last write wins; only the seasons that an update touches are rewritten."""
    rows = _month(spark, sf_dir).select(*KEYS, "qty")
    held = _versioned(spark, rows)
    new = spark.createDataFrame([(-1, 2002, 1, 5.0)], rows.schema)
    held.change(rows.where("entity % 2 = 0").withColumn("qty", F.col("qty") + 1).unionByName(new), lambda old, new: T.upsert(old, new, KEYS))
    return held.read()


@query("S11", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'stub' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def s11(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    stubs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("stub").alias("name")).distinct()
    return T.insert_absent(known, stubs, ["id"])


@query("S12", f"WITH {MONTHS} SELECT entity, season, period, coalesce({HALF}, qty) AS qty, lines FROM months")
def s12(spark, sf_dir):
    """New values where they are not null, season by season in one commit."""
    held = _versioned(spark, _month(spark, sf_dir))
    new = held.read().select(*KEYS, F.when(F.col("entity") % 2 == 0, F.col("qty") + 1).alias("qty"))
    held.change(new, lambda old, new: T.coalesce_update(old, new, KEYS, ["qty"]))
    return held.read()


@query("S13", """WITH t AS (SELECT user_id, max(ts) AS stamp, max_by(event_id, ts) AS rank FROM events WHERE event_type = 'view' GROUP BY 1), u AS (SELECT user_id, max(ts) AS ns, max_by(event_id, ts) AS nr FROM events WHERE event_type = 'click' GROUP BY 1),
k AS (SELECT user_id, max(ts) AS kick FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, CASE WHEN ns > stamp AND ns < kick THEN nr ELSE rank END AS rank FROM t LEFT JOIN u USING (user_id) LEFT JOIN k USING (user_id)""")
def s13(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    last = lambda kind: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("ts").alias("stamp"), F.max_by("event_id", "ts").alias("rank"))
    limit = last("purchase").select("user_id", F.col("stamp").alias("kick"))
    return T.guarded_update(last("view"), last("click"), ["user_id"], "stamp", "rank", limit, "kick").select("user_id", "rank")


@query("S14", "SELECT DISTINCT user_id, ts AS captured_at FROM events")
def s14(spark, sf_dir):
    """Snapshots appended twice: the second time nothing is new."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("captured_at"), F.to_date("ts").alias("day"))
    held = T.VersionedTable(spark, T.Workspace(spark, "snapshots").path, rows.schema, "day")
    for part in (rows, rows.where("user_id % 2 = 0")):
        held.append(part.distinct().join(held.read(), ["user_id", "captured_at"], "left_anti"))
    return held.read().select("user_id", "captured_at")


@query("S15", f"WITH {MONTHS} SELECT entity, season, period, coalesce({HALF}, qty) AS qty, lines FROM months")
def s15(spark, sf_dir):
    """Existing rows only: updates without a target row are left out."""
    held = _versioned(spark, _month(spark, sf_dir))
    new = held.read().select(*KEYS, F.when(F.col("entity") % 2 == 0, F.col("qty") + 1).alias("qty"))
    stray = spark.createDataFrame([(-1, 2002, 1, 5.0)], new.schema)
    held.change(new.unionByName(stray), lambda old, new: T.coalesce_update(old, new, KEYS, ["qty"], insert=False))
    return held.read()


@query("S16", f"WITH {MONTHS} SELECT entity, season, period, CASE WHEN NOT coalesce(lines > 5, false) THEN qty + 1 ELSE qty END AS qty FROM months")
def s16(spark, sf_dir):
    """Rows that another approved run serves are never changed."""
    held = _versioned(spark, _month(spark, sf_dir))
    new = held.read().withColumn("qty", F.col("qty") + 1)
    held.change(new, lambda old, new: T.protected_upsert(old, new, KEYS, F.col("lines") > 5)[0])
    return held.read().select(*KEYS, "qty")


@query("S17", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'approved' ELSE o_orderstatus END AS run, count(*) AS n FROM orders GROUP BY 1")
def s17(spark, sf_dir):
    """A run relabelled in one commit; the counts before and after must fit."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("run"))
    held = T.VersionedTable(spark, T.Workspace(spark, "runs").path, rows.schema, "run")
    held.append(rows)
    T.promote_run(held, "run", "P", "approved")
    return held.read().groupBy("run").agg(F.count("*").alias("n"))


@query("S18", f"WITH {FACT} SELECT season, count(*) AS n, sum(qty) AS qty FROM fact GROUP BY season")
def s18(spark, sf_dir):
    """A season archived, damaged in the table, and restored from the archive."""
    w = T.Workspace(spark, "archive")
    rows = facts(spark, sf_dir)
    w.save(rows, "fact", ["season"])
    w.save(rows.where("season = 2000"), "archived")
    path = f"{w.path}/fact"
    write = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(path)
    write(rows.where("season = 2000").limit(1))
    write(spark.read.schema(rows.schema).parquet(f"{w.path}/archived"))
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("season").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query("S19", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-21' OR event_type = 'signup'")
def s19(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return T.keep_recent(rows, "ts", F.expr("TIMESTAMP '2024-01-31'"), 10, F.col("event_type") == "signup").select("event_id")


@query("S20", "SELECT 'kept' AS kind, count(*) AS n FROM events WHERE event_id % 4 IN (0, 1) UNION ALL SELECT 'uncovered', count(*) FROM (SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_id % 4 IN (0, 1))")
def s20(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("run", (F.col("event_id") % 4).cast("int"))
    kept, uncovered = T.keep_runs(rows, "run", [0, 1], "user_id")
    return kept.agg(F.lit("kept").alias("kind"), F.count("*").alias("n")).unionByName(uncovered.agg(F.lit("uncovered").alias("kind"), F.count("*").alias("n")))


@query("S21", f"WITH {MONTHS} SELECT entity, season, period, lines FROM months WHERE season BETWEEN 1996 AND 1999")
def s21(spark, sf_dir):
    """Columns that both tables have, between the bounds of the seasons to fill."""
    source = _month(spark, sf_dir).withColumn("extra", F.lit(1))
    target = _month(spark, sf_dir).where("season > 1999").select(*KEYS, "lines", F.lit(None).cast("double").alias("absent"))
    names = T.intersect_columns(source, target)
    return source.where("season between 1996 and 1999").select(*names)


@query("S22", f"WITH {MONTHS} SELECT entity, season, period, CASE WHEN season <> 2000 THEN lines END AS lines FROM months")
def s22(spark, sf_dir):
    """One season's partition rebuilt with a column that is switched off."""
    w = T.Workspace(spark, "rebuild")
    rows = _month(spark, sf_dir).select(*KEYS, "lines")
    w.save(rows, "fact", ["season"])
    off = rows.where("season = 2000").withColumn("lines", F.lit(None).cast("bigint"))
    off.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(f"{w.path}/fact")
    return spark.read.schema(rows.schema).parquet(f"{w.path}/fact").select(*KEYS, "lines")


@query("S23", "SELECT l_orderkey AS game, l_linenumber::BIGINT AS play, l_quantity AS speed FROM lineitem")
def s23(spark, sf_dir):
    """A tracking table that must have its columns."""
    rows = table(spark, sf_dir, "lineitem")
    need = {"l_orderkey": "game", "l_linenumber": "play", "l_quantity": "speed"}
    if missing := [c for c in need if c not in rows.columns]:
        raise ValueError(f"the tracking table lacks {missing}")
    return rows.select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play"), F.col("l_quantity").alias("speed"))


@query("S24", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16'")
def s24(spark, sf_dir):
    return T.keep_recent(table(spark, sf_dir, "events"), "ts", F.expr("TIMESTAMP '2024-02-15'"), 30).select("event_id")


