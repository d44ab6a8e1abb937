"""Projections (P), joins (J) and reshaping (U), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.resolve import align_inputs, co_movement, fuzzy_match, merge_one_to_one, resolve_ids
from ..operators.temporal import asof_join, lag_join, latest_per_key, period_spine, prior_values
from ..sources.tables import Workspace
from .facts import FACT, MONTHS, PLAYS, facts, months, plays, table
from .registry import query

EV = "ev AS (SELECT event_id, user_id, ts, event_type, round(value * 100)::BIGINT AS cents FROM events)"


def _events(spark, sf_dir, *kinds):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rows.where(F.col("event_type").isin(*kinds)) if kinds else rows


# --- projections ---------------------------------------------------------------------------------------------------
@query("P01", """SELECT event_id::VARCHAR AS event_key, user_id, (json_extract(props, '$.k'))::BIGINT AS k, event_type = 'purchase' AS bought
FROM events WHERE user_id IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL""")
def p01(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    rows = rows.where("user_id is not null and p.k is not null")
    return rows.select(F.col("event_id").cast("string").alias("event_key"), "user_id", F.col("p.k").alias("k"), (F.col("event_type") == "purchase").alias("bought"))


@query("P02", f"WITH {PLAYS} SELECT game, play, receiver FROM plays WHERE location IN ('A', 'R') AND receiver IS NOT NULL")
def p02(spark, sf_dir):
    return plays(spark, sf_dir).where(F.col("location").isin("A", "R") & F.col("receiver").isNotNull()).select("game", "play", "receiver")


@query("P03", f"WITH {FACT} SELECT entity, count(*) FILTER (WHERE lines IS NULL OR lines / 7.0 >= 0.34) AS form_games FROM fact GROUP BY entity")
def p03(spark, sf_dir):
    share = F.col("lines") / 7
    return facts(spark, sf_dir).groupBy("entity").agg(F.count_if(F.col("lines").isNull() | (share >= 0.34)).alias("form_games"))


@query("P04", f"WITH {FACT} SELECT game, entity FROM fact QUALIFY row_number() OVER (PARTITION BY entity, season ORDER BY period, game) > 2")
def p04(spark, sf_dir):
    before = F.row_number().over(Window.partitionBy("entity", "season").orderBy("period", "game")) - 1
    return facts(spark, sf_dir).withColumn("before", before).where("before >= 2").select("game", "entity")


@query("P05", "SELECT o_orderkey AS game FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderstatus, 'P') NOT IN ('F')")
def p05(spark, sf_dir):
    """Unknown states are served; those on the list are not."""
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").where(status.isNull() | ~status.isin("F")).select(F.col("o_orderkey").alias("game"))


CUT = "TIMESTAMP '2024-01-15 00:00:00'"


@query("P06", f"SELECT event_id, user_id FROM events WHERE ts < {CUT}")
def p06(spark, sf_dir):
    """Rows before a cut; an undated row refuses the whole table at run time."""
    dated = F.when(F.col("ts").isNull(), F.raise_error(F.lit("a row has no date"))).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").where(dated < F.expr(CUT)).select("event_id", "user_id")


@query("P07", f"""WITH {PLAYS} SELECT defender, season, count(*) AS n, count(*) FILTER (WHERE location = 'R') AS r FROM plays
WHERE abs(coalesce(CASE WHEN zone = 'F' THEN disc ELSE -disc END, 0)) <= 8 AND yards >= 5 GROUP BY ALL""")
def p07(spark, sf_dir):
    side = F.when(F.col("zone") == "F", F.col("disc")).otherwise(-F.col("disc"))
    neutral = (F.abs(F.coalesce(side, F.lit(0))) <= 8) & (F.col("yards") >= 5)
    return plays(spark, sf_dir).where(neutral).groupBy("defender", "season").agg(F.count("*").alias("n"), F.count_if(F.col("location") == "R").alias("r"))


@query("P08", f"WITH {FACT} SELECT entity, season, period, game FROM fact WHERE (season, period) < (1998, 6)")
def p08(spark, sf_dir):
    rows = facts(spark, sf_dir)
    cut = F.struct(F.lit(1998).cast("long").alias("season"), F.lit(6).cast("long").alias("period"))
    return rows.where(F.struct("season", "period") < cut).select("entity", "season", "period", "game")


@query("P09", "SELECT DISTINCT l_orderkey AS game, l_linenumber::BIGINT AS play, first_value(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS part FROM lineitem WHERE l_orderkey IS NOT NULL")
def p09(spark, sf_dir):
    """Only columns that exist, renamed, without null keys, one row for each key."""
    rows = table(spark, sf_dir, "lineitem")
    names = {"l_orderkey": "game", "l_linenumber": "play", "l_partkey": "part", "l_absent": "absent"}
    rows = rows.select(*(F.col(c).cast("long").alias(n) for c, n in names.items() if c in rows.columns)).dropna(subset=["game"])
    return latest_per_key(rows, ["game", "play"], [F.col("part")])


#: Slices of time of one frequent entity in as-of joins.
SLICES = 32


# --- joins -----------------------------------------------------------------------------------------------------------
@query("J01", f"WITH {MONTHS} SELECT a.entity, a.season, a.period, a.grp, a.qty, p.qty AS projected FROM months a JOIN months p ON p.entity = a.entity AND p.season + 1 = a.season AND p.period = a.period AND p.grp = a.grp")
def j01(spark, sf_dir):
    """Actuals met with projections (the same period a season before) on four keys, unique on both sides."""
    actual = months(facts(spark, sf_dir)).select("entity", "season", "period", "grp", "qty")
    projected = actual.select("entity", (F.col("season") + 1).alias("season"), "period", "grp", F.col("qty").alias("projected"))
    return actual.join(projected, ["entity", "season", "period", "grp"])


@query("J02", """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def j02(spark, sf_dir):
    get = lambda n: table(spark, sf_dir, n)
    rows = get("orders").join(get("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(get("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(get("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("J03", f"""WITH {PLAYS}, a AS (SELECT receiver, game, sum(yards) AS ret FROM plays WHERE location = 'R' GROUP BY ALL),
b AS (SELECT receiver, game, sum(yards) AS acc FROM plays WHERE location = 'A' GROUP BY ALL), c AS (SELECT receiver, game, count(*) AS n FROM plays WHERE location = 'N' GROUP BY ALL)
SELECT receiver, game, ret, acc, n FROM a FULL JOIN b USING (receiver, game) FULL JOIN c USING (receiver, game)""")
def j03(spark, sf_dir):
    """Three aggregates of one scan on one key: conditional sums, null where the kind does not occur."""
    at = lambda k: F.col("location") == k
    yards = lambda k: F.sum(F.when(at(k), F.col("yards")))
    rows = plays(spark, sf_dir).where(F.col("location").isin("R", "A", "N")).groupBy("receiver", "game")
    return rows.agg(yards("R").alias("ret"), yards("A").alias("acc"), F.nullif(F.count_if(at("N")), F.lit(0)).alias("n"))


ROUND = """team_rev AS (SELECT season, period, team, sum(cents)::BIGINT AS cents, count(*) AS games FROM fact GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY season, period ORDER BY cents DESC NULLS LAST, team) AS place FROM team_rev)"""


def team_rounds(spark, sf_dir, fact=None):
    """Teams of a period by revenue; places 2k-1 and 2k meet."""
    fact = facts(spark, sf_dir) if fact is None else fact
    rows = fact.groupBy("season", "period", "team").agg(F.sum("cents").alias("cents"), F.count("*").alias("games"))
    place = F.row_number().over(Window.partitionBy("season", "period").orderBy(F.desc_nulls_last("cents"), "team")).cast("long")
    return rows.withColumn("place", place)


@query("J04", f"""WITH {FACT}, {ROUND} SELECT x.season, x.period, x.team, y.team AS opponent, y.cents AS opponent_cents
FROM placed x JOIN placed y ON x.season = y.season AND x.period = y.period AND (x.place + 1) // 2 = (y.place + 1) // 2 AND x.team <> y.team""")
def j04(spark, sf_dir, fact=None):
    rows = team_rounds(spark, sf_dir, fact).withColumn("meeting", F.floor((F.col("place") + 1) / 2))
    other = rows.select("season", "period", "meeting", F.col("team").alias("opponent"), F.col("cents").alias("opponent_cents"))
    return rows.join(other, ["season", "period", "meeting"]).where("team <> opponent").select("season", "period", "team", "opponent", "opponent_cents")


@query("J05", f"""WITH {EV}, b AS (SELECT *, least(ts, {CUT}) AS until FROM ev WHERE event_type = 'purchase'), v AS (SELECT user_id, ts AS seen_at, cents AS seen FROM ev WHERE event_type = 'view')
SELECT event_id, b.user_id, v.seen_at AS view_at, v.seen AS view_cents FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.until > v.seen_at""")
def j05(spark, sf_dir):
    """The last view strictly before both the purchase and a cut."""
    left = _events(spark, sf_dir, "purchase").withColumn("until", F.least("ts", F.expr(CUT)))
    right = _events(spark, sf_dir, "view").select("user_id", F.col("ts").alias("at"), "cents")
    rows = asof_join(left, right, ["user_id"], "until", "at", ["cents"], strict=True, prefix="view_", slices=SLICES)
    return rows.select("event_id", "user_id", "view_at", "view_cents")


@query("J06", f"""WITH {EV} SELECT b.event_id, b.user_id, v.ts AS view_at, v.cents AS view_cents FROM (SELECT * FROM ev WHERE event_type = 'click') b
ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.ts""")
def j06(spark, sf_dir):
    right = _events(spark, sf_dir, "view").select("user_id", F.col("ts").alias("at"), "cents")
    rows = asof_join(_events(spark, sf_dir, "click"), right, ["user_id"], "ts", "at", ["cents"], prefix="view_", slices=SLICES)
    return rows.select("event_id", "user_id", "view_at", "view_cents")


@query("J07", f"""WITH {EV}, s AS (SELECT user_id, ts, event_id FROM ev WHERE event_type = 'signup'), g AS (SELECT user_id, ts, event_id AS game FROM ev WHERE event_type = 'purchase')
SELECT s.event_id, s.user_id, coalesce(g.game, l.game) AS game FROM s ASOF LEFT JOIN g ON s.user_id = g.user_id AND s.ts <= g.ts
LEFT JOIN (SELECT user_id, max_by(game, ts) AS game FROM g GROUP BY 1) l ON l.user_id = s.user_id""")
def j07(spark, sf_dir):
    """The first event at or after a stamp, else the last one."""
    games = _events(spark, sf_dir, "purchase").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("game"))
    rows = asof_join(_events(spark, sf_dir, "signup"), games, ["user_id"], "ts", "at", ["game"], forward=True, prefix="next_", slices=SLICES)
    last = games.groupBy("user_id").agg(F.max_by("game", "at").alias("last_game"))
    return rows.join(last, "user_id", "left").select("event_id", "user_id", F.coalesce("next_game", "last_game").alias("game"))


@query("J08", f"""WITH {MONTHS} SELECT m.entity, m.season, m.period, coalesce(
 (SELECT max_by(qty, period) FROM months x WHERE x.entity = m.entity AND x.season = m.season AND x.period < m.period),
 CASE WHEN m.period = 1 THEN (SELECT max_by(qty, period) FROM months x WHERE x.entity = m.entity AND x.season = m.season - 1) END) AS lagged FROM months m""")
def j08(spark, sf_dir):
    """The latest non-null value of earlier periods; period 1 falls back to the season before."""
    rows = months(facts(spark, sf_dir))
    inside = F.max_by("qty", F.when(F.col("qty").isNotNull(), F.col("period"))).over(prior_values(("entity", "season"), "period"))
    final = rows.where("qty is not null").groupBy("entity", "season").agg(F.max_by("qty", "period").alias("final"))
    joined = lag_join(rows.withColumn("inside", inside), final, ["entity"], "season", 1, {"final": "before"})
    return joined.select("entity", "season", "period", F.coalesce("inside", F.when(F.col("period") == 1, F.col("before"))).alias("lagged"))


@query("J09", f"WITH {EV} SELECT user_id, event_type AS last_type, cents FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def j09(spark, sf_dir):
    rows = latest_per_key(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.col("event_id")])
    return rows.select("user_id", F.col("event_type").alias("last_type"), "cents")


@query("J10", f"WITH {MONTHS} SELECT entity, max_by(team * 1000 + lines, season * 100 + period) AS profile FROM months WHERE season <= 1999 AND lines IS NOT NULL GROUP BY entity")
def j10(spark, sf_dir):
    """The latest effective row of a dimension up to a season."""
    rows = months(facts(spark, sf_dir)).where("season <= 1999 and lines is not null")
    best = rows.groupBy("entity").agg(F.max_by(F.struct("team", "lines"), F.struct("season", "period")).alias("p"))
    return best.select("entity", (F.col("p.team") * 1000 + F.col("p.lines")).alias("profile"))


@query("J11", f"""WITH {FACT}, s AS (SELECT entity, season, avg(qty) AS mean_qty, count(*) AS n FROM fact GROUP BY ALL)
SELECT s.entity, s.season, a.mean_qty AS mean_1, b.mean_qty AS mean_2, a.n AS n_1 FROM s LEFT JOIN s a ON a.entity = s.entity AND a.season = s.season - 1 LEFT JOIN s b ON b.entity = s.entity AND b.season = s.season - 2""")
def j11(spark, sf_dir):
    season = facts(spark, sf_dir).groupBy("entity", "season").agg(F.avg("qty").alias("mean_qty"), F.count("*").alias("n"))
    rows = lag_join(season.select("entity", "season"), season, ["entity"], "season", 1, {"mean_qty": "mean_1", "n": "n_1"})
    return lag_join(rows, season, ["entity"], "season", 2, {"mean_qty": "mean_2"})


@query("J12", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j12(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("J13", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j13(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("J14", f"WITH {MONTHS} SELECT entity, season, period, EXISTS (SELECT 1 FROM months x WHERE x.entity = m.entity AND x.season = m.season AND x.period > m.period AND x.qty > 0) AS returns FROM months m")
def j14(spark, sf_dir):
    """Existence of a later period, from the last one instead of an inequality join."""
    last = F.max(F.when(F.col("qty") > 0, F.col("period"))).over(Window.partitionBy("entity", "season"))
    rows = months(facts(spark, sf_dir))
    return rows.select("entity", "season", "period", F.coalesce(last > F.col("period"), F.lit(False)).alias("returns"))


@query("J15", f"WITH {FACT} SELECT game, (SELECT avg(x.qty) FROM fact x WHERE x.entity = f.entity AND x.season * 100 + x.period < f.season * 100 + f.period) AS mean_before FROM fact f")
def j15(spark, sf_dir):
    """A correlated average over strictly earlier periods as one window."""
    rows = facts(spark, sf_dir).withColumn("at", F.col("season") * 100 + F.col("period"))
    return rows.select("game", F.avg("qty").over(prior_values(("entity",), "at")).alias("mean_before"))


@query("J16", f"""WITH {FACT}, c AS (SELECT entity, season, count(*) FILTER (WHERE lines >= 3) AS n FROM fact GROUP BY ALL), k AS (SELECT DISTINCT entity, unnest([1999, 2000, 2001]) AS season FROM fact)
SELECT k.entity, k.season::BIGINT AS season, coalesce(nullif(a.n, 0), b.n) AS n_games FROM k LEFT JOIN c a ON a.entity = k.entity AND a.season = k.season LEFT JOIN c b ON b.entity = k.entity AND b.season = k.season - 1""")
def j16(spark, sf_dir):
    rows = facts(spark, sf_dir)
    counts = rows.groupBy("entity", "season").agg(F.count_if(F.col("lines") >= 3).alias("n"))
    keys = rows.select("entity").distinct().withColumn("season", F.explode(F.array(*(F.lit(x).cast("long") for x in (1999, 2000, 2001)))))
    both = lag_join(lag_join(keys, counts, ["entity"], "season", 0, {"n": "now"}), counts, ["entity"], "season", 1, {"n": "before"})
    return both.select("entity", "season", F.coalesce(F.nullif("now", F.lit(0)), "before").alias("n_games"))


@query("J17", f"""WITH {PLAYS}, g AS (SELECT DISTINCT game, unnest([team, opponent]) AS side FROM plays)
SELECT game, side, n_name FROM g JOIN nation ON n_nationkey = side""")
def j17(spark, sf_dir):
    """Two keys per row: one row per side, then an equality join."""
    sides = plays(spark, sf_dir).select("game", F.explode(F.array("team", "opponent")).alias("side")).distinct()
    nation = table(spark, sf_dir, "nation")
    return sides.join(F.broadcast(nation), F.col("side") == F.col("n_nationkey")).select("game", "side", "n_name")


@query("J18", """WITH n AS (SELECT DISTINCT lower(p_name) AS l FROM part UNION SELECT DISTINCT lower(p_name) || 's' FROM part),
k AS (SELECT lower(p_name) AS r, min(p_partkey) AS id FROM part GROUP BY 1),
e AS (SELECT l, id, 100.0::DOUBLE AS score FROM n JOIN k ON l = r),
s AS (SELECT l, id, 100.0 * (1 - levenshtein(l, r) / greatest(length(l), length(r))) AS score FROM n JOIN k ON abs(length(l) - length(r)) <= 0.1 * greatest(length(l), length(r)) WHERE l NOT IN (SELECT l FROM e)),
b AS (SELECT * FROM s WHERE score >= 90 QUALIFY row_number() OVER (PARTITION BY l ORDER BY score DESC, id) = 1)
SELECT n.l AS name, m.id AS matched_id, m.score AS match_score FROM n LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM b) m USING (l)""")
def j18(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    asked = part.select(F.lower("p_name").alias("name")).union(part.select(F.concat(F.lower("p_name"), F.lit("s")))).distinct()
    return fuzzy_match(asked, part, "name", "p_name", "p_partkey").select("name", "matched_id", "match_score")


@query("J19", """WITH known AS (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS n, regexp_replace(upper(p_type), '[^A-Z]', '', 'g') AS k FROM part),
asked AS (SELECT l_orderkey AS game, l_linenumber::BIGINT AS play, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey END AS direct, p_name, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT n, k, count(DISTINCT id) AS c2, min(id) AS i2 FROM known GROUP BY ALL), a AS (SELECT n, count(DISTINCT id) AS c1, min(id) AS i1, list_sort(list(DISTINCT id)) AS everyone FROM known GROUP BY ALL),
j AS (SELECT asked.*, b.*, a.* EXCLUDE (n), d.id AS found FROM asked LEFT JOIN b ON b.n = trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AND b.k = regexp_replace(upper(p_type), '[^A-Z]', '', 'g')
 LEFT JOIN a ON a.n = b.n LEFT JOIN known d ON d.id = direct)
SELECT game, play, coalesce(found, CASE WHEN c2 = 1 THEN i2 END, CASE WHEN c1 = 1 THEN i1 END) AS resolved,
 CASE WHEN found IS NOT NULL THEN 'direct' WHEN c2 = 1 THEN 'name_kind' WHEN c1 = 1 THEN 'name' WHEN c1 > 1 THEN 'ambiguous' ELSE 'unmatched' END AS method,
 (CASE WHEN found IS NULL AND c2 > 1 AND c1 > 1 THEN len(everyone) ELSE 0 END)::BIGINT AS n_candidates FROM j""")
def j19(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    direct = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey")).alias("direct")
    asked = line.join(part, line.l_partkey == part.p_partkey)
    asked = asked.select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play"), direct, "p_name", "p_type")
    known = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"))
    found = resolve_ids(asked, known, "game", "direct", "p_name", "p_type")
    return found.select("game", "play", "resolved", "method", F.size("candidates").cast("long").alias("n_candidates"))


@query("J20", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey")
def j20(spark, sf_dir):
    """A many-to-one merge that refuses repeated or missing keys on its right side."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "entity")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    return merge_one_to_one(orders, customer, ["entity"], many_to_one=True).select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("J21", f"WITH {MONTHS} SELECT a.entity, a.season, a.period FROM months a JOIN months b USING (entity, season, period) WHERE b.lines IS NOT NULL")
def j21(spark, sf_dir):
    """Inputs joined one by one; the third would lose over half of the rows and is left out."""
    keys = ["entity", "season", "period"]
    month = Workspace(spark, "align").save(months(facts(spark, sf_dir)).select(*keys, "lines"), "months")
    inputs = {"a": month.select(*keys), "b": month.where("lines is not null").select(*keys), "c": month.where("lines > 14").select(*keys)}
    return align_inputs(inputs, keys)[0].select(*keys)


@query("J22", f"""WITH {MONTHS}, t AS (SELECT team, season * 100 + period AS at, avg(qty) AS x FROM months WHERE qty IS NOT NULL GROUP BY ALL)
SELECT a.team AS a, b.team AS b, count(*) AS n, round(corr(a.x, b.x), 6) AS rho FROM t a JOIN t b ON a.at = b.at AND a.team < b.team GROUP BY ALL HAVING count(*) >= 20""")
def j22(spark, sf_dir):
    rows = months(facts(spark, sf_dir)).where("qty is not null").groupBy("team", (F.col("season") * 100 + F.col("period")).alias("at")).agg(F.avg("qty").alias("x"))
    return co_movement(rows, ["at"], "team", "x", 20).withColumn("rho", F.round("rho", 6))


# --- reshaping -------------------------------------------------------------------------------------------------------
@query("U01", "SELECT l_orderkey AS game, l_linenumber::BIGINT AS play, unnest([{'side': 'home', 'key': l_suppkey}, {'side': 'away', 'key': l_partkey}], recursive := true) FROM lineitem")
def u01(spark, sf_dir):
    sides = F.array(
        F.struct(F.lit("home").alias("side"), F.col("l_suppkey").alias("key")), F.struct(F.lit("away").alias("side"), F.col("l_partkey").alias("key"))
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play"), F.explode(sides).alias("s"))
    return rows.select("game", "play", "s.*")


@query("U02", "SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def u02(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return a.unionByName(b)


@query("U03", """SELECT 'both' AS kind, k FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events)
UNION ALL SELECT 'orders only', k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT user_id FROM events)""")
def u03(spark, sf_dir):
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").unionByName(a.subtract(b).select(F.lit("orders only").alias("kind"), "k"))


@query("U04", f"""WITH {EV}, f AS (SELECT user_id, event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1),
l AS (SELECT user_id, event_type, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT f.user_id, f.event_type, f.event_id AS first_id, l.event_id AS last_id FROM f JOIN l USING (user_id, event_type)""")
def u04(spark, sf_dir):
    order = F.struct("ts", "event_id")
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"))


@query("U05", f"""WITH {EV} SELECT user_id, sum(cents) FILTER (WHERE event_type = 'view')::BIGINT AS "view", sum(cents) FILTER (WHERE event_type = 'click')::BIGINT AS click,
 sum(cents) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchase FROM ev WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id""")
def u05(spark, sf_dir):
    kinds = ["view", "click", "purchase"]
    return _events(spark, sf_dir, *kinds).groupBy("user_id").pivot("event_type", kinds).agg(F.sum("cents"))


@query("U06", f"""WITH {EV}, s AS (SELECT user_id, event_type, sum(cents)::BIGINT AS cents FROM ev GROUP BY ALL)
SELECT user_id, count(*) AS n_stats, max(cents) FILTER (WHERE event_type = 'click') AS click_cents FROM s GROUP BY user_id""")
def u06(spark, sf_dir):
    """Long statistics as one map per entity."""
    long = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.sum("cents").alias("cents"))
    nested = long.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "cents"))).alias("stats"))
    return nested.select("user_id", F.size("stats").cast("long").alias("n_stats"), F.try_element_at("stats", F.lit("click")).alias("click_cents"))


@query("U07", f"WITH {MONTHS}, s AS (SELECT entity, season, period, lines, games, returned FROM months) UNPIVOT s ON lines, games, returned INTO NAME stat VALUE value")
def u07(spark, sf_dir):
    rows = months(facts(spark, sf_dir)).select("entity", "season", "period", "lines", "games", "returned")
    return rows.unpivot(["entity", "season", "period"], ["lines", "games", "returned"], "stat", "value").where("value is not null")


@query("U08", f"WITH {EV} SELECT user_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN ts END DESC NULLS LAST, cents, event_id) = 1")
def u08(spark, sf_dir):
    stamp = F.when(F.col("event_type") != "error", F.col("ts"))
    return latest_per_key(_events(spark, sf_dir), ["user_id"], [F.desc_nulls_last(stamp), F.col("cents"), F.col("event_id")]).select("user_id", "event_id")


SEVERITY = ("error", "signup", "view", "click", "purchase")


@query("U09", f"WITH {EV} SELECT user_id, date_part('day', ts)::BIGINT AS day, min_by(event_type, list_position(['error', 'signup', 'view', 'click', 'purchase'], event_type)) AS status FROM ev GROUP BY ALL")
def u09(spark, sf_dir):
    """The most restrictive of several states."""
    place = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("event_type"))
    return _events(spark, sf_dir).groupBy("user_id", F.dayofmonth("ts").cast("long").alias("day")).agg(F.min_by("event_type", place).alias("status"))


@query("U10", f"""WITH {EV}, s AS (SELECT user_id, date_trunc('day', ts) AS snap, count(*) FILTER (WHERE event_type = 'purchase') AS informative FROM ev WHERE ts <= {CUT} GROUP BY ALL),
p AS (SELECT user_id, max(snap) AS snap FROM s WHERE informative > 0 GROUP BY 1)
SELECT e.event_id, e.user_id FROM ev e JOIN p ON p.user_id = e.user_id AND date_trunc('day', ts) = snap WHERE ts <= {CUT}""")
def u10(spark, sf_dir):
    """Rows of the newest accepted snapshot per user: one that says something."""
    rows = _events(spark, sf_dir).where(F.col("ts") <= F.expr(CUT)).withColumn("snap", F.date_trunc("day", "ts"))
    snaps = rows.groupBy("user_id", "snap").agg(F.count_if(F.col("event_type") == "purchase").alias("n")).where("n > 0")
    newest = snaps.groupBy("user_id").agg(F.max("snap").alias("snap"))
    return rows.join(newest, ["user_id", "snap"]).select("event_id", "user_id")


@query("U11", f"WITH {FACT}, l AS (SELECT team, season, max(period) AS top FROM fact GROUP BY ALL) SELECT team, season, unnest(range(1, top + 2)) AS period FROM l")
def u11(spark, sf_dir):
    return period_spine(facts(spark, sf_dir), ["team", "season"], "period")


@query("U12", """WITH o AS (SELECT o_orderkey AS game, l_linenumber::BIGINT AS market, CASE WHEN l_returnflag = 'R' THEN 'Over' ELSE 'Under' END AS outcome, round(l_extendedprice * 100)::BIGINT AS price, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT game, market, max(price) FILTER (WHERE outcome = 'Over') AS over_price, max(price) FILTER (WHERE outcome = 'Under') AS under_price FROM o GROUP BY ALL""")
def u12(spark, sf_dir):
    """Nested event, market and outcome arrays as JSON, flattened, outcomes side by side."""
    line = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", "Over").otherwise("Under").alias("name")
    outcome = F.struct(side, F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"))
    market = line.groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("market")).agg(F.collect_list(outcome).alias("outcomes"))
    event = market.groupBy(F.col("l_orderkey").alias("game")).agg(F.to_json(F.collect_list(F.struct("market", "outcomes"))).alias("payload"))
    shape = "array<struct<market: bigint, outcomes: array<struct<name: string, price: bigint>>>>"
    flat = event.select("game", F.explode(F.from_json("payload", shape)).alias("m")).select("game", "m.market", F.explode("m.outcomes").alias("o"))
    price = lambda n: F.max(F.when(F.col("o.name") == n, F.col("o.price")))
    return flat.groupBy("game", "market").agg(price("Over").alias("over_price"), price("Under").alias("under_price"))


@query("U13", "SELECT max(season)::BIGINT AS season FROM (SELECT year(o_orderdate) AS season FROM orders UNION ALL SELECT year(l_shipdate) FROM lineitem)")
def u13(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"))
    b = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("season"))
    return a.unionByName(b).agg(F.max("season").cast("long").alias("season"))


