"""Sorts, limits and top-k (T), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import ordinals
from ..operators.rank import best_lineup, global_ordinal, hit_rate, ordinal, points_lost, replacement_levels, value_over_replacement
from .facts import FACT, facts, table
from .registry import query

BOARD = f"""{FACT}, board AS (SELECT entity, any_value(grp) AS position, sum(qty) FILTER (WHERE season = 1999) AS projection, sum(qty) FILTER (WHERE season = 2000) AS realized,
 sum(lines) FILTER (WHERE season = 1999)::DOUBLE AS adp FROM fact GROUP BY entity HAVING sum(qty) FILTER (WHERE season = 1999) IS NOT NULL)"""


def board(spark, sf_dir):
    """Entities with a projection (one season), what came of it (the next), and a market column."""
    part = lambda c, s: F.sum(F.when(F.col("season") == s, F.col(c)))
    rows = facts(spark, sf_dir).groupBy("entity").agg(
        F.any_value("grp").alias("position"), part("qty", 1999).alias("projection"), part("qty", 2000).alias("realized"), part("lines", 1999).cast("double").alias("adp")
    )
    return rows.where("projection is not null")


SLOTS = {"BUILDING": 20, "AUTOMOBILE": 40, "MACHINERY": 40, "HOUSEHOLD": 20, "FURNITURE": 20}
FLEX = ("AUTOMOBILE", "MACHINERY", "HOUSEHOLD")
SLOT_SQL = "CASE position " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SLOTS.items()) + " ELSE 0 END"
VOR = f"""{BOARD}, r AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY projection DESC, entity) AS rk FROM board), rest AS (SELECT * FROM r WHERE rk > {SLOT_SQL}),
pool AS (SELECT entity FROM rest WHERE position IN {FLEX} ORDER BY projection DESC, entity LIMIT 30), lv AS (SELECT position, max(projection) AS replacement FROM rest WHERE entity NOT IN (SELECT entity FROM pool) GROUP BY 1),
vor AS (SELECT board.*, projection - coalesce(replacement, 0) AS vor FROM board LEFT JOIN lv USING (position))"""


def vor_board(spark, sf_dir):
    rows = board(spark, sf_dir)
    return value_over_replacement(rows, replacement_levels(rows, "position", "projection", "entity", SLOTS, FLEX, 30), "position", "projection")


@query("T01", f"WITH {BOARD} SELECT entity, realized FROM board WHERE position <> 'BUILDING' ORDER BY realized DESC NULLS LAST, entity")
def t01(spark, sf_dir):
    return board(spark, sf_dir).where("position <> 'BUILDING'").select("entity", "realized").orderBy(F.desc_nulls_last("realized"), "entity")


@query("T02", f"WITH {BOARD} SELECT entity, position, row_number() OVER (PARTITION BY position ORDER BY projection DESC, entity) AS place FROM board")
def t02(spark, sf_dir):
    rows = board(spark, sf_dir).select("entity", "position", "projection")
    return ordinals(rows, ("position",), [F.desc("projection"), F.col("entity")], "place").select("entity", "position", "place")


@query("T03", f"""WITH {BOARD}, a AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY projection DESC, entity) AS first_place FROM board), b AS (SELECT *, first_place <= 24 AND realized IS NULL AS cold FROM a)
SELECT entity, position, cold, row_number() OVER (PARTITION BY position ORDER BY CASE WHEN cold THEN 0 ELSE projection END DESC, entity) AS place FROM b""")
def t03(spark, sf_dir):
    """Rows without a history that rank high are set to zero and flagged, and all are ranked again."""
    rows = board(spark, sf_dir).select("entity", "position", "projection", "realized")
    rows = ordinals(rows, ("position",), [F.desc("projection"), F.col("entity")], "first_place")
    rows = rows.withColumn("cold", (F.col("first_place") <= 24) & F.col("realized").isNull())
    rows = rows.select("entity", "position", "cold", F.when(F.col("cold"), 0.0).otherwise(F.col("projection")).alias("value"))
    return ordinals(rows, ("position",), [F.desc("value"), F.col("entity")], "place").drop("value")


@query("T04", f"WITH {VOR} SELECT entity, position, vor FROM vor")
def t04(spark, sf_dir):
    return vor_board(spark, sf_dir).select("entity", "position", "vor")


@query("T05", f"WITH {BOARD}, l AS (SELECT position, list(projection ORDER BY projection DESC) AS xs FROM board GROUP BY 1) SELECT position, coalesce(xs[12], xs[-1], 0) AS nth FROM l")
def t05(spark, sf_dir):
    """The twelfth best, else the last, else zero: from ranks, so no group becomes an array."""
    rows = board(spark, sf_dir).withColumn("rk", ordinal(("position",), F.desc("projection"), "entity")).where("rk <= 12")
    return rows.groupBy("position").agg(F.max_by("projection", "rk").alias("nth"))


@query("T06", f"WITH {VOR} SELECT entity, row_number() OVER (ORDER BY vor DESC, entity) AS model_rank FROM vor WHERE adp IS NOT NULL AND realized IS NOT NULL")
def t06(spark, sf_dir):
    rows = vor_board(spark, sf_dir).where("adp is not null and realized is not null")
    return global_ordinal(rows.select("entity", "vor"), "model_rank", F.desc("vor"), F.col("entity")).select("entity", "model_rank")


@query("T07", f"""WITH {VOR}, a AS (SELECT entity, row_number() OVER (ORDER BY vor DESC, entity) AS m, row_number() OVER (ORDER BY adp DESC, entity) AS k FROM vor WHERE adp IS NOT NULL)
SELECT entity, (m + k) / 2 AS blend, row_number() OVER (ORDER BY (m + k) / 2, entity) AS place FROM a""")
def t07(spark, sf_dir):
    rows = vor_board(spark, sf_dir).where("adp is not null").select("entity", "vor", "adp")
    rows = global_ordinal(global_ordinal(rows, "m", F.desc("vor"), F.col("entity")), "k", F.desc("adp"), F.col("entity"))
    rows = rows.select("entity", ((F.col("m") + F.col("k")) / 2).alias("blend"))
    return global_ordinal(rows, "place", F.col("blend"), F.col("entity"))


@query("T08", f"""WITH {VOR}, m AS (SELECT entity, row_number() OVER (ORDER BY adp DESC, entity) AS place FROM vor WHERE adp >= 10), t AS (SELECT entity, (SELECT count(*) FROM m) + row_number() OVER (ORDER BY vor DESC, entity) AS place FROM vor WHERE entity NOT IN (SELECT entity FROM m))
SELECT entity, place, 'market' AS kind FROM m UNION ALL SELECT entity, place, 'tail' FROM t""")
def t08(spark, sf_dir):
    """Market rows first, then the rest by value; one order over a flag, so nothing is counted on the driver."""
    rows = vor_board(spark, sf_dir).withColumn("kind", F.when(F.col("adp") >= 10, "market").otherwise("tail"))
    value = F.when(F.col("kind") == "market", F.col("adp")).otherwise(F.col("vor"))
    rows = rows.select("entity", "kind", value.alias("value"))
    return global_ordinal(rows, "place", F.col("kind"), F.desc("value"), F.col("entity")).select("entity", "place", "kind")


@query("T09", f"""WITH {BOARD}, b AS (SELECT * FROM board WHERE realized IS NOT NULL), r AS (SELECT position, row_number() OVER (PARTITION BY position ORDER BY projection DESC, entity) <= 20 AS a, row_number() OVER (PARTITION BY position ORDER BY realized DESC, entity) <= 20 AS b FROM b)
SELECT position, count(*) FILTER (WHERE a AND b) / 20 AS hit_rate FROM r GROUP BY 1""")
def t09(spark, sf_dir):
    return hit_rate(board(spark, sf_dir).where("realized is not null"), ("position",), F.desc("projection"), F.desc("realized"), 20)


@query("T10", f"""WITH {BOARD}, r AS (SELECT position, realized, row_number() OVER (PARTITION BY position ORDER BY projection DESC NULLS LAST, entity) <= 15 AS a, row_number() OVER (PARTITION BY position ORDER BY realized DESC NULLS LAST, entity) <= 15 AS b FROM board)
SELECT position, coalesce(sum(realized) FILTER (WHERE b), 0) - coalesce(sum(realized) FILTER (WHERE a), 0) AS points_lost FROM r GROUP BY 1""")
def t10(spark, sf_dir):
    return points_lost(board(spark, sf_dir), ("position",), "projection", "realized", 15)


@query("T11", f"""WITH {BOARD}, x AS (SELECT *, entity % 12 AS roster FROM board), r AS (SELECT *, row_number() OVER (PARTITION BY roster, position ORDER BY realized DESC NULLS LAST, entity) <= CASE position WHEN 'BUILDING' THEN 1 ELSE 2 END AS starts FROM x),
f AS (SELECT *, NOT starts AND position IN {FLEX} AS open FROM r), g AS (SELECT *, open AND row_number() OVER (PARTITION BY roster, open ORDER BY realized DESC NULLS LAST, entity) <= 2 AS flex FROM f)
SELECT roster, coalesce(sum(realized) FILTER (WHERE starts OR flex), 0) AS points FROM g GROUP BY 1""")
def t11(spark, sf_dir):
    slots = {k: 1 if k == "BUILDING" else 2 for k in SLOTS}
    return best_lineup(board(spark, sf_dir).withColumn("roster", F.col("entity") % 12), ("roster",), "position", "realized", "entity", slots, FLEX, 2)


@query("T12", f"""WITH {FACT}, u AS (UNPIVOT (SELECT game, qty - 90 AS qty, lines::DOUBLE AS lines, returned * -3.0::DOUBLE AS returned FROM fact WHERE qty IS NOT NULL) ON qty, lines, returned INTO NAME part VALUE v)
SELECT game, string_agg(part, ',' ORDER BY abs(v) DESC, part) AS factors FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY game ORDER BY abs(v) DESC, part) <= 2) GROUP BY game""")
def t12(spark, sf_dir):
    """The two strongest factors per row, from an array of the row's own factors."""
    parts = {"qty": F.col("qty") - 90, "lines": F.col("lines").cast("double"), "returned": F.col("returned") * -3.0}
    listed = F.array(*(F.struct((-F.abs(v)).alias("size"), F.lit(n).alias("part")) for n, v in parts.items()))
    top = F.slice(F.array_sort(listed), 1, 2)
    return facts(spark, sf_dir).where("qty is not null").select("game", F.array_join(F.transform(top, lambda p: p["part"]), ",").alias("factors"))


@query("T13", "SELECT user_id, min_by(event_id, (ts, event_id)) FILTER (WHERE ts > TIMESTAMP '2024-01-15') AS next_event, coalesce(max(date_part('day', ts)) FILTER (WHERE ts <= TIMESTAMP '2024-01-15'), 0)::BIGINT + 1 AS next_day FROM events GROUP BY user_id")
def t13(spark, sf_dir):
    """The next event after a moment, and the period after the last completed one."""
    after = F.col("ts") > F.expr("TIMESTAMP '2024-01-15'")
    nxt = F.min_by("event_id", F.when(after, F.struct("ts", "event_id")))
    day = F.coalesce(F.max(F.when(~after, F.dayofmonth("ts"))), F.lit(0)) + 1
    return table(spark, sf_dir, "events").groupBy("user_id").agg(nxt.alias("next_event"), day.cast("long").alias("next_day"))


__all__ = ["BOARD", "VOR", "board", "vor_board"]
