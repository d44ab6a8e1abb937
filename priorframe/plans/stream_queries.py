"""Streaming and stateful queries (X): the events table dealt into files, streamed, and what the sink holds."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..operators.quality import quarantine
from ..operators.rating import RatingRules, fresh_state, play_round, rounds_of, sides
from ..sources.tables import Workspace
from ..streaming import stateful as X
from .aggregate_queries import games
from .facts import table
from .rating_queries import RATINGS
from .registry import query


SLICE_ROWS = 1_000_000


def queue_slices(workspace, rows, order, least=4, slice_rows=SLICE_ROWS):
    """Append rows as files of about ``slice_rows``, in order of time and one after the other.

    The file source takes files by their time of writing, so files that tasks write side by side come in any order. All
    slices are written by one job, a file each, and moved into the queue one after the other with rising names and times of
    writing. Rows of one time are in one slice; the number of slices grows with the table.
    """
    at = F.unix_micros(F.col(order))
    n = rows.count()
    slices = max(least, -(-n // slice_rows))
    shares = [k / slices for k in range(1, slices)]
    cuts = sorted(set(rows.agg(F.percentile_approx(at, shares, 10 * slices).alias("cuts")).first().cuts or []))
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < at)) if cuts else F.lit(0)
    dealt = rows.withColumn("__slice", number)
    staged = dealt.repartition(slices, "__slice").sortWithinPartitions("__slice", order)
    staged.write.partitionBy("__slice").parquet(f"{workspace.path}/staged")
    if not n:  # an empty file, so that the stream has a batch
        dealt.drop("__slice").coalesce(1).write.parquet(f"{workspace.path}/events")
        return rows.schema
    spark = workspace.spark
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(workspace.path).getFileSystem(spark._jsc.hadoopConfiguration())
    folder = lambda k: of(f"{workspace.path}/staged/__slice={k}")
    files = [sorted((f.getPath() for f in fs.listStatus(folder(k))), key=lambda f: f.getName()) for k in range(len(cuts) + 1) if fs.exists(folder(k))]
    files = [f for part in files for f in part if f.getName().endswith(".parquet")]
    fs.mkdirs(of(f"{workspace.path}/events"))
    now = int(time.time())
    for k, f in enumerate(files):
        to = of(f"{workspace.path}/events/slice-{k:09d}.parquet")
        if not fs.rename(f, to):
            raise OSError(f"{f} was not moved to {to}")
        fs.setTimes(to, (now - len(files) + k) * 1000, -1)
    return rows.schema


def _stream(spark, sf_dir, name, shape=lambda df: df, order="ts"):
    """The events (shaped) as a stream of slices in order of time, one slice a batch."""
    workspace = Workspace(spark, name)
    rows = shape(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    schema = queue_slices(workspace, rows, order)
    return workspace, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{workspace.path}/events")


@query("X01", """SELECT event_id, round(least(((1 + value / 100) * 0.5::DOUBLE - 0.5::DOUBLE) / (1 + value / 100) * 0.25::DOUBLE, 0.05), 9) AS stake FROM events WHERE value > 0 AND ((1 + value / 100) * 0.5::DOUBLE - 0.5::DOUBLE) / (1 + value / 100) > 0.02""")
def x01(spark, sf_dir):
    w, rows = _stream(spark, sf_dir, "sized")
    out = X.sized(rows.select("event_id", "value"), F.lit(0.5), 2 + F.col("value") / 100)
    return X.run_to_end(out.select("event_id", F.round("stake", 9).alias("stake")), w, "out")


def _bets(rows):
    kind = F.when(F.col("event_type") == "error", "release").when(F.col("event_type") == "signup", "release_game").otherwise("place")
    return rows.select(
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("portfolio_id"), "event_id", "ts", kind.alias("kind"),
        F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("player_id"), F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("game_id"),
        F.lit(0.03).alias("amount"),
    )


#: Each portfolio's decisions in order: exposure of seven players and three games as lists, and their total.
ADMISSION = """WITH RECURSIVE o AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'release' WHEN 'signup' THEN 'release_game' ELSE 'place' END AS kind, event_id % 7 + 1 AS p, event_id % 3 + 1 AS g,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
d(user_id, event_id, kind, k, amount, reason, ps, gs, total) AS (
 SELECT user_id, NULL::BIGINT, '', 0::BIGINT, 0::DOUBLE, '', [0, 0, 0, 0, 0, 0, 0]::DOUBLE[], [0, 0, 0]::DOUBLE[], 0::DOUBLE FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL
 SELECT user_id, event_id, kind, k, CASE kind WHEN 'release_game' THEN gs[g] ELSE 0.03 END, reason,
  CASE WHEN kind = 'release' THEN list_transform(ps, lambda x, i: CASE WHEN i = p THEN greatest(0, x - 0.03::DOUBLE) ELSE x END) WHEN reason = 'approved' THEN list_transform(ps, lambda x, i: CASE WHEN i = p THEN x + 0.03::DOUBLE ELSE x END) ELSE ps END,
  CASE WHEN kind = 'release' THEN list_transform(gs, lambda x, i: CASE WHEN i = g THEN greatest(0, x - 0.03::DOUBLE) ELSE x END) WHEN kind = 'release_game' THEN list_transform(gs, lambda x, i: CASE WHEN i = g THEN 0 ELSE x END)
   WHEN reason = 'approved' THEN list_transform(gs, lambda x, i: CASE WHEN i = g THEN x + 0.03::DOUBLE ELSE x END) ELSE gs END,
  CASE WHEN kind = 'release' THEN greatest(0, total - 0.03::DOUBLE) WHEN kind = 'release_game' THEN greatest(0, total - gs[g]) WHEN reason = 'approved' THEN total + 0.03::DOUBLE ELSE total END
 FROM (SELECT d.user_id, o.event_id, o.kind, o.k, o.p, o.g, d.ps, d.gs, d.total, CASE WHEN o.kind <> 'place' THEN 'released' WHEN d.ps[o.p] + 0.03::DOUBLE > 0.05::DOUBLE + 1e-9 THEN 'player'
   WHEN d.gs[o.g] + 0.03::DOUBLE > 0.2::DOUBLE + 1e-9 THEN 'game' WHEN d.total + 0.03::DOUBLE > 0.2::DOUBLE + 1e-9 THEN 'total' ELSE 'approved' END AS reason FROM d JOIN o ON o.user_id = d.user_id AND o.k = d.k + 1)),
a AS (SELECT 'p' || user_id AS portfolio_id, event_id, kind, 'a' || event_id % 7 AS player_id, 'g' || event_id % 3 AS game_id, round(amount, 9) AS amount, reason IN ('approved', 'released') AS approved, reason FROM d WHERE k > 0)
"""


def _decided(spark, sf_dir, name):
    w, rows = _stream(spark, sf_dir, name, _bets)
    return X.run_to_end(X.admission(rows), w, "out").withColumn("amount", F.round("amount", 9))


@query("X02", ADMISSION + "SELECT * FROM a WHERE kind = 'place'")
def x02(spark, sf_dir):
    """Admission under player, game and total limits; a rejected bet changes nothing."""
    return _decided(spark, sf_dir, "admission").where("kind = 'place'")


@query("X03", ADMISSION + "SELECT * FROM a WHERE kind <> 'place'")
def x03(spark, sf_dir):
    """Releases of a bet or of a game, in the same stream and state."""
    return _decided(spark, sf_dir, "releases").where("kind <> 'place'")


@query("X04", ADMISSION + "SELECT portfolio_id, event_id, player_id, game_id, amount FROM a WHERE approved AND kind = 'place'")
def x04(spark, sf_dir):
    """Alerts: approved decisions only, one for each."""
    decided = _decided(spark, sf_dir, "alerts")
    return decided.where("approved and kind = 'place'").select("portfolio_id", "event_id", "player_id", "game_id", "amount")


@query("X05", "SELECT user_id, count(*) AS captures FROM (SELECT DISTINCT user_id, date_trunc('hour', ts) AS captured_at FROM events) GROUP BY 1")
def x05(spark, sf_dir):
    shape = lambda df: df.select("user_id", F.date_trunc("hour", "ts").alias("captured_at"))
    w, rows = _stream(spark, sf_dir, "capture", shape, "captured_at")
    return X.run_to_end(X.capture(rows, ["user_id"], "captured_at", "2 hours"), w, "out").groupBy("user_id").agg(F.count("*").alias("captures"))


@query("X06", "SELECT CASE WHEN event_type <> 'error' AND value > 1 THEN 'valid' ELSE 'rejected' END AS kind, count(*) AS n FROM events GROUP BY 1")
def x06(spark, sf_dir):
    """Each batch validated and split into two sinks."""
    w, rows = _stream(spark, sf_dir, "ingest")

    def split(batch, _):
        valid, rejected = quarantine(batch.persist(), {"type": F.col("event_type") != "error", "value": F.col("value") > 1}, "events")
        valid.write.mode("append").parquet(f"{w.path}/valid")
        rejected.write.mode("append").parquet(f"{w.path}/rejected")
        batch.unpersist()

    X.run_batches(rows, w, "split", split)
    count = lambda kind: spark.read.parquet(f"{w.path}/{kind}").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count("valid").unionByName(count("rejected"))


@query("X07", RATINGS + " SELECT team, round(o, 6) AS off, round(d, 6) AS def, last_season FROM st WHERE no = (SELECT max(no) FROM rounds)")
def x07(spark, sf_dir):
    """Ratings brought up to date by a stream of finished rounds, one file a round."""
    w = Workspace(spark, "rounds")
    rows = w.save(games(spark, sf_dir), "games")
    rounds = rounds_of(rows)
    seasons = sorted({s for s, _ in rounds})
    state = w.save(fresh_state(rows, RatingRules()), "state--1")
    if not rounds:
        return state
    at = lambda season, period: (F.col("season") == season) & (F.col("period") == period)
    for season, period in rounds:
        rows.where(at(season, period)).coalesce(1).write.mode("append").parquet(f"{w.path}/queue")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{w.path}/queue")

    def step(batch, number):
        if not batch.where(~at(*rounds[number])).isEmpty():
            raise ValueError(f"batch {number} is not round {rounds[number]}")
        state = spark.read.parquet(f"{w.path}/state-{number - 1}")
        w.save(play_round(state, sides(batch), RatingRules(), seasons), f"state-{number}")

    X.run_batches(stream, w, "ratings", step)
    last = spark.read.parquet(f"{w.path}/state-{len(rounds) - 1}")
    return last.withColumns({c: F.round(c, 6) for c in ("off", "def")})


@query("X08", """WITH RECURSIVE o AS (SELECT user_id AS entity, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f(entity, event_id, k, m, v) AS (SELECT DISTINCT entity, NULL::BIGINT, 0::BIGINT, 50.0::DOUBLE, 1000.0::DOUBLE FROM o UNION ALL
 SELECT o.entity, o.event_id, o.k, m + (v + 1) / (v + 1 + 100) * (o.value - m), (1 - (v + 1) / (v + 1 + 100)) * (v + 1) FROM f JOIN o ON o.entity = f.entity AND o.k = f.k + 1)
SELECT entity, event_id, round(m, 6) AS mean, round(v, 6) AS variance FROM f WHERE k > 0""")
def x08(spark, sf_dir):
    """The filtered level after each event, its state kept from batch to batch."""
    w, rows = _stream(spark, sf_dir, "filter", lambda df: df.select(F.col("user_id").alias("entity"), "event_id", "ts", "value"))
    out = X.run_to_end(X.filter_levels(rows, 50.0, 1.0, 100.0, 1000.0), w, "out")
    return out.select("entity", "event_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("X09", "SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, min(ts) AS kick FROM events WHERE event_type = 'purchase' GROUP BY 1) k ON k.user_id = e.user_id WHERE e.ts < kick")
def x09(spark, sf_dir):
    """Captures before the first kick-off only: a stream joined with a static table."""
    w, rows = _stream(spark, sf_dir, "pregame")
    kick = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("kick"))
    return X.run_to_end(rows.join(kick, "user_id").where("ts < kick").select("event_id", "user_id"), w, "out")
