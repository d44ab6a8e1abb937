"""Validation, quarantine and contracts (V), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators.ordered import exact_quantiles, null_safe_join
from ..sources.tables import Workspace
from .aggregate_queries import CELLS, cells, edges
from .facts import FACT, MONTHS, facts, months, table
from .registry import query



def _split(spark, sf_dir):
    rules = {"quantity": F.col("l_quantity") > 2, "discount": F.col("l_discount") <= 0.09, "date": F.col("l_shipdate").isNotNull()}
    return Q.quarantine(table(spark, sf_dir, "lineitem"), rules, "lineitem")


@query("V01", """WITH c AS (SELECT concat_ws(',', CASE WHEN NOT l_quantity > 2 THEN 'quantity' END, CASE WHEN NOT l_discount <= 0.09 THEN 'discount' END, CASE WHEN l_shipdate IS NULL THEN 'date' END) AS errors FROM lineitem)
SELECT CASE WHEN errors = '' THEN 'valid' ELSE 'rejected' END AS kind, errors, count(*) AS n FROM c GROUP BY ALL""")
def v01(spark, sf_dir):
    valid, rejected = _split(spark, sf_dir)
    good = valid.agg(F.lit("valid").alias("kind"), F.lit("").alias("errors"), F.count("*").alias("n"))
    return good.unionByName(rejected.groupBy(F.lit("rejected").alias("kind"), "errors").agg(F.count("*").alias("n")))


@query("V02", "SELECT o_orderkey, o_orderdate AS published_at, o_custkey AS player_id FROM orders")
def v02(spark, sf_dir):
    rows = Q.coalesce_aliases(table(spark, sf_dir, "orders"), {"published_at": ("dt", "o_orderdate"), "player_id": ("gsis_id", "o_custkey")})
    return rows.select("o_orderkey", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "player_id")


@query("V03", "SELECT l_returnflag AS source, count(*) AS loaded, count(*) FILTER (WHERE l_quantity > 2) AS valid FROM lineitem GROUP BY 1")
def v03(spark, sf_dir):
    """A source that loaded rows of which none is valid fails the query."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("loaded"), F.count_if(F.col("l_quantity") > 2).alias("valid"))
    return rows.withColumn("valid", Q.require(F.col("valid") > 0, "a source has no valid row", F.col("valid")))


@query("V04", "SELECT event_type AS label, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'view', 'click') GROUP BY 1")
def v04(spark, sf_dir):
    return Q.unknown_labels(table(spark, sf_dir, "events"), "event_type", ("signup", "view", "click"))


@query("V05", "SELECT event_id, NOT regexp_matches(user_id::VARCHAR, '^[1-9][0-9]{0,2}$') AS bad_id, ts > TIMESTAMP '2024-01-25' AS late FROM events WHERE NOT regexp_matches(user_id::VARCHAR, '^[1-9][0-9]{0,2}$') OR ts > TIMESTAMP '2024-01-25'")
def v05(spark, sf_dir):
    stamp = F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    bad, late = ~F.col("user_id").cast("string").rlike("^[1-9][0-9]{0,2}$"), F.coalesce(stamp > F.expr("TIMESTAMP '2024-01-25'"), F.lit(True))
    return table(spark, sf_dir, "events").where(bad | late).select("event_id", bad.alias("bad_id"), late.alias("late"))


@query("V06", """SELECT 'duplicate' AS problem, p_name AS item, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'two keys', p_brand, count(DISTINCT p_type) FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1
UNION ALL SELECT 'out of range', p_name, count(*) FROM part WHERE p_size > 45 GROUP BY p_name
UNION ALL SELECT 'missing', n_name, 1 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def v06(spark, sf_dir):
    """Problems across rows as one table: duplicates, double holders, ranges, gaps in the domain."""
    part = table(spark, sf_dir, "part")
    say = lambda df, what, item: df.select(F.lit(what).alias("problem"), F.col(item).alias("item"), F.col("n"))
    twice = part.groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")
    double = part.groupBy("p_brand").agg(F.count_distinct("p_type").alias("n")).where("n > 1")
    wide = part.where("p_size > 45").groupBy("p_name").agg(F.count("*").alias("n"))
    gone = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti")
    gone = gone.withColumn("n", F.lit(1).cast("long"))
    parts = say(twice, "duplicate", "p_name"), say(double, "two keys", "p_brand"), say(wide, "out of range", "p_name"), say(gone, "missing", "n_name")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("V08", f"WITH {MONTHS} , f AS (SELECT entity, season, period, lines AS f_lines, cents - 1 AS f_cents FROM months), b AS (SELECT * FROM months JOIN f USING (entity, season, period)) SELECT 'lines' AS \"column\", count(*) FILTER (WHERE lines IS NOT NULL AND f_lines IS NOT NULL) AS comparable, coalesce(bool_and(lines = f_lines), false) AS leaks FROM b UNION ALL SELECT 'cents', count(*) FILTER (WHERE cents IS NOT NULL AND f_cents IS NOT NULL), coalesce(bool_and(cents = f_cents), false) FROM b")
def v08(spark, sf_dir):
    """A feature equal to its outcome wherever both are known is a leak."""
    rows = months(facts(spark, sf_dir))
    keys = ["entity", "season", "period"]
    features = rows.select(*keys, "lines", (F.col("cents") - 1).alias("cents"))
    return Q.equal_on_common_rows(features, rows, keys, ["lines", "cents"])


@query("V09", f"WITH {FACT} SELECT season, count(*) AS uncovered FROM fact f WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = entity AND 1994 + user_id % 8 <= season) GROUP BY season")
def v09(spark, sf_dir):
    """Rows without a dimension row effective by their season; the earliest effective season decides."""
    profiles = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity")).agg(F.min(1994 + F.col("user_id") % 8).alias("effective"))
    joined = facts(spark, sf_dir).join(profiles, "entity", "left")
    return joined.where(F.col("effective").isNull() | (F.col("effective") > F.col("season"))).groupBy("season").agg(F.count("*").alias("uncovered"))


@query("V10", "SELECT c_custkey AS entity, NULL::VARCHAR AS profile FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'known' FROM events")
def v10(spark, sf_dir):
    """Missing dimension rows recorded as explicit nulls."""
    known = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity")).distinct().withColumn("profile", F.lit("known"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))
    return keys.join(known, "entity", "left_anti").withColumn("profile", F.lit(None).cast("string")).unionByName(known)


@query("V11", "SELECT l_returnflag AS source, count(*) AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate + INTERVAL 60 DAY GROUP BY 1")
def v11(spark, sf_dir):
    """Rows published after their event, per source."""
    late = F.col("l_shipdate") >= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where(late)
    return rows.groupBy(F.col("l_returnflag").alias("source")).agg(F.count("*").alias("late"))


@query("V12", f"WITH {FACT} SELECT a.season, count(*) AS n, (SELECT max(b.season) FROM fact b WHERE b.season < a.season) AS max_train_season FROM fact a WHERE a.season > (SELECT min(season) FROM fact) GROUP BY a.season")
def v12(spark, sf_dir):
    """Predictions must come from models of earlier seasons; a missing stamp is refused."""
    fact = facts(spark, sf_dir)
    seasons = fact.select("season").distinct()
    # seasons are few; each with the latest one before it, the first with none and without predictions
    stamps = seasons.join(seasons.withColumnRenamed("season", "seen"), F.col("seen") < F.col("season")).groupBy("season").agg(F.max("seen").alias("max_train_season"))
    rows = fact.join(F.broadcast(stamps), "season")
    cells_ = rows.groupBy("season").agg(
        F.count("*").alias("n"), F.max("max_train_season").alias("max_train_season"), F.count_if(F.col("max_train_season").isNull() | (F.col("max_train_season") >= F.col("season"))).alias("bad")
    )
    return cells_.select("season", Q.require(F.col("bad") == 0, "a model has seen the season it predicts", F.col("n")).alias("n"), "max_train_season")


@query("V13", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'invalidated cell' WHEN o_orderkey % 11 = 0 THEN 'missing run' WHEN o_totalprice < 5000 THEN 'missing quartiles' ELSE 'trusted' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def v13(spark, sf_dir):
    """The first reason of an ordered policy for which a projection is not trusted."""
    reason = F.when(F.col("o_orderstatus") == "P", "invalidated cell").when(F.col("o_orderkey") % 11 == 0, "missing run")
    reason = reason.when(F.col("o_totalprice") < 5000, "missing quartiles").otherwise("trusted")
    return table(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("V14", f"WITH {FACT} SELECT grp, count(*) AS n, avg((coalesce(returned, 0) <= 0)::INTEGER) AS zero_rate, count(DISTINCT grp) = 1 AS pure FROM fact GROUP BY grp")
def v14(spark, sf_dir):
    rows = facts(spark, sf_dir).groupBy("grp").agg(
        F.count("*").alias("n"), F.avg((F.coalesce("returned", F.lit(0)) <= 0).cast("int")).alias("zero_rate"), (F.size(F.collect_set("grp")) == 1).alias("pure")
    )
    return rows.withColumn("n", Q.require((F.col("n") > 0) & F.col("pure") & (F.col("zero_rate") < 0.99), "the cohort cannot be trained on", F.col("n")))


@query("V15", f"""WITH {FACT}, r AS (SELECT avg((qty IS NULL)::INTEGER) FILTER (WHERE season < 2000) AS tq, avg((qty IS NULL)::INTEGER) FILTER (WHERE season >= 2000) AS sq, avg((lines IS NULL)::INTEGER) FILTER (WHERE season < 2000) AS tl, avg((lines IS NULL)::INTEGER) FILTER (WHERE season >= 2000) AS sl FROM fact)
SELECT 'qty' AS "column", tq AS trained, sq AS served, sq > tq + 0.05 AS drifted FROM r UNION ALL SELECT 'lines', tl, sl, sl > tl + 0.05 FROM r""")
def v15(spark, sf_dir):
    rows = facts(spark, sf_dir)
    rates = lambda df, n: Q.null_rates(df, ["qty", "lines"]).withColumnRenamed("null_rate", n)
    both = rates(rows.where("season < 2000"), "trained").join(rates(rows.where("season >= 2000"), "served"), "column")
    return both.select("column", "trained", "served", (F.col("served") > F.col("trained") + 0.05).alias("drifted"))


@query("V16", f"WITH {FACT} SELECT grp, count(*) AS n, count(*) FILTER (WHERE qty IS NULL OR isnan(qty)) AS not_finite, count(*) - count(DISTINCT game) AS repeated, count(*) BETWEEN 100 AND 1000000 AS in_bounds FROM fact GROUP BY grp")
def v16(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("grp").agg(
        F.count("*").alias("n"), F.count_if(F.col("qty").isNull() | F.isnan("qty")).alias("not_finite"), (F.count("*") - F.count_distinct("game")).alias("repeated"),
        F.count("*").between(100, 1_000_000).alias("in_bounds"),
    )


@query("V17", f"WITH {FACT}, need AS (SELECT grp, season FROM (SELECT DISTINCT grp FROM fact), (SELECT unnest(range(1994, 2003)) AS season)) SELECT grp, season FROM need ANTI JOIN (SELECT DISTINCT grp, season FROM fact) USING (grp, season)")
def v17(spark, sf_dir):
    """Required cells that have no row."""
    seen = facts(spark, sf_dir).select("grp", "season").distinct()
    need = seen.select("grp").distinct().withColumn("season", F.explode(F.sequence(F.lit(1994).cast("long"), F.lit(2002).cast("long"))))
    return need.join(seen, ["grp", "season"], "left_anti")


@query("V18", "SELECT 'orders' AS tbl, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS wanted FROM orders UNION ALL SELECT 'events', count(*), count(*) FILTER (WHERE event_type = 'purchase') FROM events")
def v18(spark, sf_dir):
    a = table(spark, sf_dir, "orders").agg(F.lit("orders").alias("tbl"), F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("wanted"))
    b = table(spark, sf_dir, "events").agg(F.lit("events").alias("tbl"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("wanted"))
    return a.unionByName(b)


def hash_sql(columns: dict[str, str]) -> str:
    """SQL of :func:`row_hash` for columns (expressions by name), doubles already as whole numbers."""
    texts = ", ".join(f"coalesce(({e})::VARCHAR, '\\N')" for _, e in sorted(columns.items()))
    return f"('0x' || substr(md5(concat_ws('|', {texts})), 1, 15))::BIGINT"


def mark_sql(name: str, source: str, columns: dict[str, str]) -> str:
    """SQL of :func:`fingerprint`."""
    return f"""SELECT '{name}' AS "table", count(*) AS n, coalesce(bit_xor(h), 0) AS "xor", coalesce(sum(h % 2147483648), 0)::BIGINT AS checksum FROM (SELECT {hash_sql(columns)} AS h FROM {source})"""


ORDER_COLUMNS = {c: c for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")} | {"o_totalprice": "round(o_totalprice * 1000000)::BIGINT"}
CHANGED = {**ORDER_COLUMNS, "o_custkey": "CASE WHEN o_orderkey = 1 THEN -1 ELSE o_custkey END"}
FACT_COLUMNS = {c: c for c in ("entity", "season", "period", "game", "grp", "team", "cents", "returned", "lines")} | {"qty": "round(qty * 1000000)::BIGINT"}
FACT_TYPES = "entity:bigint,season:bigint,period:bigint,game:bigint,grp:string,team:bigint,qty:double,cents:bigint,returned:bigint,lines:bigint"


@query("V19", " UNION ALL ".join([mark_sql("orders", "orders", ORDER_COLUMNS), mark_sql("dealt", "orders", ORDER_COLUMNS), mark_sql("changed", "orders", CHANGED)]))
def v19(spark, sf_dir):
    """Fingerprints of a table and of the same rows in another order agree; a changed table's does not."""
    rows = table(spark, sf_dir, "orders")
    changed = rows.withColumn("o_custkey", F.when(F.col("o_orderkey") == 1, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")))
    a, b, c = Q.fingerprint(rows, "orders"), Q.fingerprint(rows.repartition(7, "o_custkey"), "dealt"), Q.fingerprint(changed, "changed")
    return a.unionByName(b).unionByName(c)


@query("V20", f"WITH {FACT}, a AS (SELECT season, avg(qty) AS l, avg(CASE WHEN season = 1999 THEN qty * 1.5 ELSE qty END) AS r FROM fact GROUP BY season) SELECT season, 'qty' AS \"column\", round(l, 6) AS left_mean, round(r, 6) AS right_mean FROM a WHERE abs(l - r) > greatest(0.001, 0.01 * greatest(abs(l), abs(r)))")
def v20(spark, sf_dir):
    rows = facts(spark, sf_dir)
    other = rows.withColumn("qty", F.when(F.col("season") == 1999, F.col("qty") * 1.5).otherwise(F.col("qty")))
    found = Q.compare_means(rows, other, "season", ["qty"], 0.01, 0.001)
    return found.select("season", "column", F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"))


@query("V21", f"""WITH {FACT}, m AS ({mark_sql("fact", "fact", FACT_COLUMNS)}) SELECT count(*) AS n, avg((qty IS NULL)::INTEGER) AS null_qty, avg(qty) AS mean_qty, round(stddev_samp(qty), 6) AS std_qty,
 any_value(sha256(concat_ws('|', m.n, m."xor", m.checksum))) AS data_hash, sha256('{FACT_TYPES}') AS schema_hash FROM fact, m""")
def v21(spark, sf_dir):
    """A training table's profile: schema and data hashes that do not depend on order, null rates, target summary."""
    rows = facts(spark, sf_dir)
    schema = F.sha2(F.lit(",".join(f"{c}:{t}" for c, t in rows.dtypes)), 256)
    mark = Q.fingerprint(rows, "fact").select(F.sha2(F.concat_ws("|", "n", "xor", "checksum"), 256).alias("data_hash"))
    stats = rows.agg(F.count("*").alias("n"), F.avg(F.col("qty").isNull().cast("int")).alias("null_qty"), F.avg("qty").alias("mean_qty"), F.round(F.stddev_samp("qty"), 6).alias("std_qty"))
    return stats.crossJoin(mark).withColumn("schema_hash", schema)


@query("V22", f"WITH {FACT} SELECT grp, count(*) - count(DISTINCT game) AS repeated, quantile_cont(qty, 0.01) AS p01, quantile_cont(qty, 0.5) AS p50, quantile_cont(qty, 0.99) AS p99, count(*) FILTER (WHERE qty IS NULL) / count(*) AS missing FROM fact GROUP BY grp")
def v22(spark, sf_dir):
    rows = Workspace(spark, "profile").save(facts(spark, sf_dir).select("grp", "game", "qty"), "rows")
    counts = rows.groupBy("grp").agg((F.count("*") - F.count_distinct("game")).alias("repeated"), (F.count_if(F.col("qty").isNull()) / F.count("*")).alias("missing"))
    q = exact_quantiles(rows.select("grp", "qty"), ["grp"], "qty", (0.01, 0.5, 0.99)).drop("n")
    joined = null_safe_join(counts, q, ["grp"], "left")
    return joined.select("grp", "repeated", F.col("q")[0].alias("p01"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p99"), "missing")


@query("V23", f"WITH {FACT} SELECT season, period, bool_or(lines IS NOT NULL) AS played FROM fact GROUP BY ALL")
def v23(spark, sf_dir):
    """Whether a period has been played in any of its surfaces."""
    return facts(spark, sf_dir).groupBy("season", "period").agg(F.bool_or(F.col("lines").isNotNull()).alias("played"))


@query("V24", f"WITH {FACT}, t AS (SELECT team, count(DISTINCT entity) AS active FROM fact WHERE season = 2000 GROUP BY 1) SELECT team, active, active BETWEEN 20 AND 200 AS fresh FROM t")
def v24(spark, sf_dir):
    rows = facts(spark, sf_dir).where("season = 2000").groupBy("team").agg(F.count_distinct("entity").alias("active"))
    return rows.withColumn("fresh", F.col("active").between(20, 200))


@query("V25", "SELECT event_type, date_diff('day', max(ts), TIMESTAMP '2024-02-01')::BIGINT AS age_days, date_diff('day', max(ts), TIMESTAMP '2024-02-01') <= 7 AS fresh FROM events GROUP BY 1")
def v25(spark, sf_dir):
    age = F.date_diff(F.expr("DATE '2024-02-01'"), F.to_date(F.max("ts"))).cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(age.alias("age_days")).withColumn("fresh", F.col("age_days") <= 7)


@query("V27", CELLS + ", s AS (SELECT grp, count(*) FILTER (WHERE model < base) AS stored FROM c GROUP BY grp), w AS (SELECT grp, season, sum(abs(qty - pred)) < sum(abs(qty - naive)) AS won FROM edge WHERE qty IS NOT NULL AND pred IS NOT NULL AND naive IS NOT NULL GROUP BY ALL), a AS (SELECT grp, count(*) FILTER (WHERE won) AS recomputed FROM w GROUP BY grp) SELECT grp, recomputed, stored IS NOT DISTINCT FROM recomputed AS agrees FROM s FULL JOIN a USING (grp)")
def v27(spark, sf_dir):
    """A stored summary against the same summary recomputed from the rows it came from."""
    stored = cells(spark, sf_dir).groupBy("grp").agg(F.count_if(F.col("model") < F.col("base")).alias("stored"))
    good = edges(spark, sf_dir).where("qty is not null and pred is not null and naive is not null")
    per = good.groupBy("grp", "season").agg((F.sum(F.abs(F.col("qty") - F.col("pred"))) < F.sum(F.abs(F.col("qty") - F.col("naive")))).alias("won"))
    again = per.groupBy("grp").agg(F.count_if(F.col("won")).alias("recomputed"))
    both = stored.join(again, "grp", "full")
    return both.select("grp", "recomputed", F.col("stored").eqNullSafe(F.col("recomputed")).alias("agrees"))


