"""Scalar functions and column expressions (F), with their SQL."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar as S
from ..operators.resolve import letters_upper, normalize_name
from .facts import FACT, PLAYS, facts, plays, table
from .registry import query


@query("F01", f"WITH {FACT} SELECT game, qty / nullif(returned, 0) AS ratio, qty * lines AS product, lines * (1 - returned) AS blend FROM fact")
def f01(spark, sf_dir):
    return facts(spark, sf_dir).select(
        "game", S.safe_divide(F.col("qty"), F.col("returned")).alias("ratio"), (F.col("qty") * F.col("lines")).alias("product"),
        (F.col("lines") * (1 - F.col("returned"))).alias("blend"),
    )


@query("F02", "SELECT l_orderkey AS game, l_linenumber::BIGINT AS play, least(greatest(CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END, 0), 1) AS share FROM lineitem")
def f02(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play"), S.fraction(F.col("l_quantity")).alias("share"))


@query("F03", f"""WITH {FACT} SELECT game, round(1 / (1 + pow(10, ((1500 + team) - (1500 + qty) - 55) / 400.0::DOUBLE)), 6) AS expected,
 round(least(ln(abs(qty - 90) + 1) * 2.2 / ((qty - 90) * 0.001 + 2.2), 3.0), 6) AS multiplier FROM fact WHERE qty IS NOT NULL""")
def f03(spark, sf_dir):
    q = F.col("qty")
    return facts(spark, sf_dir).where("qty is not null").select(
        "game", F.round(S.expected_score(q + 1500, F.col("team") + 1500, 55.0), 6).alias("expected"), F.round(S.margin_multiplier(q - 90, q - 90, 3.0), 6).alias("multiplier")
    )


CDF_SQL = """1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-x * x) / 2"""


@query("F04", f"""WITH {FACT}, z AS (SELECT game, (qty - 90) / 60 AS z FROM fact WHERE qty IS NOT NULL), x AS (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x FROM z), t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS t FROM x)
SELECT game, round(CASE WHEN z >= 0 THEN {CDF_SQL} ELSE 1 - ({CDF_SQL}) END, 6) AS p, true AS inverts FROM t""")
def f04(spark, sf_dir):
    """Normal distribution and its inverse; the two undo each other within 1e-3 up to three deviations."""
    z = (F.col("qty") - 90) / 60
    p = S.normal_cdf(z)
    inverts = (F.abs(z) > 3) | (F.abs(S.normal_quantile(p) - z) < 1e-3)
    return facts(spark, sf_dir).where("qty is not null").select("game", F.round(p, 6).alias("p"), inverts.alias("inverts"))


@query("F05", f"""WITH {FACT} SELECT game, CASE WHEN qty < 40 THEN 'cold' WHEN qty < 90 THEN 'mild' WHEN qty IS NULL THEN NULL ELSE 'hot' END AS temperature,
 CASE WHEN lines < 3 THEN 'short' WHEN lines < 6 THEN 'usual' WHEN lines IS NULL THEN NULL ELSE 'long' END AS rest, floor(qty / 25)::BIGINT AS field FROM fact""")
def f05(spark, sf_dir):
    return facts(spark, sf_dir).select(
        "game", S.bucket(F.col("qty"), [(40, "cold"), (90, "mild")], "hot").alias("temperature"), S.bucket(F.col("lines"), [(3, "short"), (6, "usual")], "long").alias("rest"),
        F.floor(F.col("qty") / 25).alias("field"),
    )


@query("F06", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'customerjones' WHEN 1 THEN 'customer jones' ELSE 'customer, jones' END || c_custkey AS name FROM customer")
def f06(spark, sf_dir):
    """Marks and suffix tokens go, in an order that keeps the longer one whole; a hyphen joins, a comma stays."""
    key = F.col("c_custkey").cast("string")
    first = F.when(F.col("c_custkey") % 3 == 0, "Customer-").when(F.col("c_custkey") % 3 == 1, "Customer  ").otherwise(" Customer, ")
    raw = F.concat(first, F.lit("J.O'nes"), key, F.when(F.col("c_custkey") % 2 == 0, " III").otherwise(" Jr."))
    return table(spark, sf_dir, "customer").select("c_custkey", normalize_name(raw).alias("name"))


@query("F07", "SELECT p_partkey, regexp_replace(upper(p_brand), '[^A-Z]', '', 'g') AS letters FROM part")
def f07(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", letters_upper(F.col("p_brand")).alias("letters"))


@query("F08", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE (60 + p_size % 24)::INTEGER END AS inches, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE ((60 + p_size % 24) // 12)::VARCHAR || '-' || ((60 + p_size % 24) % 12)::VARCHAR END AS text FROM part")
def f08(spark, sf_dir):
    h = F.lit(60) + F.col("p_size") % 24
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("'", F.floor(h / 12).cast("string"), (h % 12).cast("string")))
    text = text.when(F.col("p_partkey") % 3 == 1, h.cast("string")).otherwise("tall")
    inches = S.height_inches(text)
    return table(spark, sf_dir, "part").select("p_partkey", inches.alias("inches"), F.when(inches.isNotNull(), S.inches_text(inches)).alias("text"))


@query("F09", "SELECT o_orderkey, month(o_orderdate)::INTEGER AS week, year(o_orderdate)::INTEGER AS season FROM orders")
def f09(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    key = F.concat_ws("_", F.year("o_orderdate").cast("string"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.lit("A"), F.lit("B"))
    return rows.select("o_orderkey", S.id_part(key, 2).alias("week"), S.id_part(key, 1).alias("season"))


@query("F10", "SELECT n_nationkey, CASE n_name WHEN 'NATION_0' THEN 'N_ZERO' WHEN 'NATION_1' THEN 'N_ONE' ELSE n_name END AS code FROM nation")
def f10(spark, sf_dir):
    alias = F.create_map(*map(F.lit, ("NATION_0", "N_ZERO", "NATION_1", "N_ONE")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.try_element_at(alias, F.col("n_name")), "n_name").alias("code"))


@query("F11", "SELECT p_partkey, regexp_matches(p_brand, '^Brand#[0-9]$') AS short_brand, regexp_matches(lower(p_name), '^(tbd|unknown|n/?a)') AS placeholder FROM part")
def f11(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.col("p_brand").rlike("^Brand#[0-9]$").alias("short_brand"), F.lower("p_name").rlike("^(tbd|unknown|n/?a)").alias("placeholder"))


@query("F12", "SELECT event_id, strftime(ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') AS utc FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M') FROM events WHERE user_id % 2 = 1")
def f12(spark, sf_dir):
    """Local clock time and a zone per row to universal time (January, no summer time)."""
    local = F.date_format("ts", "yyyy-MM-dd HH:mm")
    zone = F.when(F.col("user_id") % 2 == 0, "America/New_York").otherwise("America/Denver")
    utc = F.to_utc_timestamp(F.to_timestamp(local, "yyyy-MM-dd HH:mm").cast("timestamp"), zone)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(utc, "yyyy-MM-dd HH:mm").alias("utc"))


@query("F13", "SELECT o_orderkey, (2003 - year(o_orderdate) - CASE WHEN (month(o_orderdate), day(o_orderdate)) > (9, 1) THEN 1 ELSE 0 END)::INTEGER AS age FROM orders")
def f13(spark, sf_dir):
    late = F.struct(F.month("o_orderdate"), F.dayofmonth("o_orderdate")) > F.struct(F.lit(9), F.lit(1))
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(2003) - F.year("o_orderdate") - late.cast("int")).alias("age"))


@query("F14", "SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, strftime(ts, '%Y-%m-%d') AS day FROM events")
def f14(spark, sf_dir):
    """Dates survive a round trip through JSON."""
    rows = table(spark, sf_dir, "events")
    packed = F.to_json(F.struct(F.from_json("props", "k bigint").alias("p"), F.to_date("ts").alias("day")))
    back = F.from_json(packed, "p struct<k: bigint>, day date")
    return rows.select("event_id", back.alias("b")).select("event_id", "b.p.k", F.date_format("b.day", "yyyy-MM-dd").alias("day"))


@query("F15", "SELECT c_custkey, sha256(c_name || '|' || c_mktsegment) AS digest FROM customer")
def f15(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("digest"))


RULES = {"plain": {"qty": 0.5, "lines": 2.0}, "half": {"qty": 0.5, "lines": 2.0, "returned": 0.5}, "full": {"qty": 0.5, "lines": 2.0, "returned": 1.0}}


@query("F16", f"WITH {FACT} SELECT game, coalesce(qty, 0) * 0.5::DOUBLE + coalesce(lines, 0) * 2.0::DOUBLE AS plain, coalesce(qty, 0) * 0.5::DOUBLE + coalesce(lines, 0) * 2.0::DOUBLE + coalesce(returned, 0) * 0.5::DOUBLE AS half, coalesce(qty, 0) * 0.5::DOUBLE + coalesce(lines, 0) * 2.0::DOUBLE + coalesce(returned, 0) * 1.0::DOUBLE AS full_points FROM fact")
def f16(spark, sf_dir):
    score = {k: S.dot_score(r) for k, r in RULES.items()}
    return facts(spark, sf_dir).select("game", score["plain"].alias("plain"), score["half"].alias("half"), score["full"].alias("full_points"))


@query("F17", """WITH r(event_type, w) AS (VALUES ('purchase', 6), ('click', 1), ('error', -2)), e AS (SELECT event_id, user_id, event_type, round(value * 100)::BIGINT AS c FROM events)
SELECT event_id, sum(c * w) OVER (PARTITION BY user_id)::BIGINT AS derived FROM e JOIN r USING (event_type)""")
def f17(spark, sf_dir):
    """A derived total from long statistics on every row: rules joined, then a window, no pivot."""
    rules = spark.createDataFrame([("purchase", 6), ("click", 1), ("error", -2)], "event_type string, w long")
    rows = table(spark, sf_dir, "events").join(F.broadcast(rules), "event_type")
    points = F.round(F.col("value") * 100).cast("long") * F.col("w")
    return rows.select("event_id", F.sum(points).over(Window.partitionBy("user_id")).alias("derived"))


@query("F18", f"WITH {FACT}, f AS (SELECT game, CASE WHEN lines > 3 THEN qty END AS a, CASE WHEN returned > 0 THEN lines END AS b FROM fact) SELECT game, CASE WHEN coalesce(a, b) IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS total FROM f")
def f18(spark, sf_dir):
    a = F.when(F.col("lines") > 3, F.col("qty"))
    b = F.when(F.col("returned") > 0, F.col("lines")).cast("double")
    return facts(spark, sf_dir).select("game", S.sum_non_null(a, b).alias("total"))


@query("F19", f"""WITH {PLAYS} SELECT game, play, zone = 'F' AS dome, CASE WHEN season >= 2000 THEN 3 WHEN season >= 1997 THEN 2 ELSE 1 END AS rule_era, period - 1 AS rest, yards * disc AS scheme,
 team = opponent AS home FROM plays""")
def f19(spark, sf_dir, *more):
    era = F.when(F.col("season") >= 2000, 3).when(F.col("season") >= 1997, 2).otherwise(1)
    return plays(spark, sf_dir).select(
        "game", "play", (F.col("zone") == "F").alias("dome"), era.alias("rule_era"), (F.col("period") - 1).alias("rest"), (F.col("yards") * F.col("disc")).alias("scheme"),
        (F.col("team") == F.col("opponent")).alias("home"), *more,
    )


@query("F20", f"""WITH {FACT}, p AS (SELECT game, lag(lines) OVER w / 7.0::DOUBLE AS share, row_number() OVER w - 1 AS n FROM fact WINDOW w AS (PARTITION BY entity ORDER BY season, period, game))
SELECT game, CASE WHEN n = 0 OR share IS NULL THEN 0.5 ELSE n / (n + 4.0::DOUBLE) * share + (1 - n / (n + 4.0::DOUBLE)) * 0.5 END AS p_active FROM p""")
def f20(spark, sf_dir):
    w = Window.partitionBy("entity").orderBy("season", "period", "game")
    rows = facts(spark, sf_dir).select("game", (F.lag("lines").over(w) / 7.0).alias("share"), (F.row_number().over(w) - 1).alias("n"))
    weight = F.col("n") / (F.col("n") + 4.0)
    cold = (F.col("n") == 0) | F.col("share").isNull()
    return rows.select("game", F.when(cold, 0.5).otherwise(weight * F.col("share") + (1 - weight) * 0.5).alias("p_active"))


@query("F21", "SELECT c_custkey, round(1 - pow(1 - (1 + c_nationkey % 5) / 10.0::DOUBLE, 3), 6) AS back_3, round(1 - pow(1 - (1 + c_nationkey % 5) / 10.0::DOUBLE, 6), 6) AS back_6 FROM customer")
def f21(spark, sf_dir):
    curve = S.return_curve((1 + F.col("c_nationkey") % 5) / 10.0, 6)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.element_at(curve, 3), 6).alias("back_3"), F.round(F.element_at(curve, 6), 6).alias("back_6"))


@query("F22", f"WITH {FACT} SELECT game, lines * 5.0::DOUBLE + (team - 12) * 0.25::DOUBLE AS pass_volume, lines * 3.0::DOUBLE - (team - 12) * 0.25::DOUBLE AS rush_volume FROM fact")
def f22(spark, sf_dir):
    lean = (F.col("team") - 12) * 0.25
    return facts(spark, sf_dir).select("game", (F.col("lines") * 5.0 + lean).alias("pass_volume"), (F.col("lines") * 3.0 - lean).alias("rush_volume"))


@query("F23", f"""WITH {FACT}, a AS (SELECT game, season, period, team, CASE WHEN returned = 0 THEN 0.0::DOUBLE ELSE greatest(qty / 10, 0.5) * CASE WHEN lines < 3 THEN 0.5 ELSE 1.0 END END AS alpha FROM fact WHERE qty IS NOT NULL),
t AS (SELECT *, sum(alpha) OVER w AS total, count(*) OVER w AS n FROM a WINDOW w AS (PARTITION BY season, period, team))
SELECT game, round(CASE WHEN total > 0 THEN alpha / total ELSE 1.0::DOUBLE / n END * 35 + 1e-9, 6) AS expected FROM t""")
def f23(spark, sf_dir):
    """Expected share times volume; a group without any weight is shared evenly."""
    alpha = F.when(F.col("returned") == 0, 0.0).otherwise(F.greatest(F.col("qty") / 10, F.lit(0.5)) * F.when(F.col("lines") < 3, 0.5).otherwise(1.0))
    rows = facts(spark, sf_dir).where("qty is not null").withColumn("alpha", alpha)
    w = Window.partitionBy("season", "period", "team")
    total, n = F.sum("alpha").over(w), F.count("*").over(w)
    return rows.select("game", F.round(F.when(total > 0, F.col("alpha") / total).otherwise(1 / n) * 35 + 1e-9, 6).alias("expected"))


ODDS = "odds AS (SELECT l_orderkey AS game, l_linenumber::BIGINT AS play, CASE WHEN l_returnflag = 'R' THEN 100 + l_quantity ELSE -100 - l_quantity END AS over_odds, CASE WHEN l_linestatus = 'F' THEN 120.0::DOUBLE ELSE -130.0::DOUBLE END AS under_odds, l_quantity / 60 AS p FROM lineitem)"


def odds(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("game"), F.col("l_linenumber").cast("long").alias("play"), F.when(F.col("l_returnflag") == "R", 100 + q).otherwise(-100 - q).alias("over_odds"),
        F.when(F.col("l_linestatus") == "F", 120.0).otherwise(-130.0).alias("under_odds"), (q / 60).alias("p"),
    )


@query("F24", f"""WITH {ODDS}, i AS (SELECT *, CASE WHEN over_odds < 0 THEN -over_odds / (-over_odds + 100) ELSE 100 / (over_odds + 100) END AS a, CASE WHEN under_odds < 0 THEN -under_odds / (-under_odds + 100) ELSE 100 / (under_odds + 100) END AS b FROM odds)
SELECT game, play, round(a, 9) AS implied, round(a / (a + b), 9) AS fair, round(CASE WHEN over_odds > 0 THEN over_odds / 100 ELSE 100 / -over_odds END, 9) AS profit FROM i""")
def f24(spark, sf_dir):
    a, b = F.col("over_odds"), F.col("under_odds")
    out = {"implied": S.american_to_probability(a), "fair": S.no_vig(a, b), "profit": S.profit_per_unit(a)}
    return odds(spark, sf_dir).select("game", "play", *(F.round(c, 9).alias(n) for n, c in out.items()))


@query("F25", f"""WITH {ODDS}, k AS (SELECT *, CASE WHEN over_odds > 0 THEN over_odds / 100 ELSE 100 / -over_odds END AS b FROM odds)
SELECT game, play, round(CASE WHEN (b * p - (1 - p)) / b > 0.02 THEN least((b * p - (1 - p)) / b * 0.25, 0.05) ELSE 0 END, 9) AS stake FROM k""")
def f25(spark, sf_dir):
    stake = S.kelly(F.col("p"), 1 + S.profit_per_unit(F.col("over_odds")), 0.25, 0.02, 0.05)
    return odds(spark, sf_dir).select("game", "play", F.round(stake, 9).alias("stake"))


@query("F26", f"""WITH {FACT}, s AS (SELECT game, qty, greatest(qty + lines * 0.5::DOUBLE + returned * -1.0::DOUBLE, 0) AS shifted FROM fact WHERE qty IS NOT NULL)
SELECT game, shifted AS projection, greatest(qty * 0.5 + shifted - qty, 0) AS floor, qty * 1.5 + shifted - qty AS ceiling, CASE WHEN shifted > qty THEN 'raised' WHEN shifted < qty THEN 'lowered' ELSE 'as stored' END AS reason FROM s""")
def f26(spark, sf_dir):
    """A stored value moved by the user's weights, its bounds by the same step."""
    q = F.col("qty")
    shifted = S.weighted_projection(q, {"volume": F.col("lines"), "risk": F.col("returned")}, {"volume": 1.5, "risk": 0.0}, 1.0)
    rows = facts(spark, sf_dir).where("qty is not null").select("game", "qty", shifted.alias("projection"))
    p = F.col("projection")
    reason = F.when(p > q, "raised").when(p < q, "lowered").otherwise("as stored")
    return rows.select("game", "projection", F.greatest(q * 0.5 + p - q, F.lit(0.0)).alias("floor"), (q * 1.5 + p - q).alias("ceiling"), reason.alias("reason"))


@query("F27", f"WITH {FACT} SELECT grp, round(max(abs((0.25::DOUBLE * qty + 0.75::DOUBLE * qty) - qty)), 9) AS residual, sum(0.25::DOUBLE * qty + 0.75::DOUBLE * lines) AS blended FROM fact GROUP BY grp")
def f27(spark, sf_dir):
    """Attributions of two learners blended by their weights; what is left over must be nothing."""
    a, b = F.col("qty") * 0.25, F.col("qty") * 0.75
    return facts(spark, sf_dir).groupBy("grp").agg(
        F.round(F.max(F.abs(a + b - F.col("qty"))), 9).alias("residual"), F.sum(a + F.col("lines") * 0.75).alias("blended")
    )


@query("F28")
def f28(spark, sf_dir):
    """Standardised vectors on their first eight principal axes, squashed; zero vectors where the input is unusable."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") > 0).select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(rows).transform(rows)
    placed = PCA(k=8, inputCol="scaled", outputCol="axes").fit(scaled).transform(scaled)
    squashed = F.transform(vector_to_array("axes"), F.tanh)
    every = table(spark, sf_dir, "embeddings").select("vec_id").join(placed.select("vec_id", squashed.alias("profile")), "vec_id", "left")
    return every.select("vec_id", F.coalesce("profile", F.array_repeat(F.lit(0.0), 8)).alias("profile"))


@query("F29", """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 > 0 THEN p_size END, (p_size % 7) * 32 + 16)::BIGINT AS pick, CASE WHEN p_size % 3 > 0 THEN 'pick' ELSE 'round midpoint' END AS basis,
 CASE WHEN p_size < 10 THEN 1.2::DOUBLE WHEN p_size < 30 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS multiplier FROM part""")
def f29(spark, sf_dir):
    size = F.col("p_size")
    stated = F.when(size % 3 > 0, size)
    multiplier = F.when(size < 10, 1.2).when(size < 30, 1.0).otherwise(0.8)
    basis = F.when(stated.isNotNull(), "pick").otherwise("round midpoint")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(stated, (size % 7) * 32 + 16).cast("long").alias("pick"), basis.alias("basis"), multiplier.alias("multiplier"))
