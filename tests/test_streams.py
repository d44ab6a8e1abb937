"""Streams: files come in order of time, late rows are none, and state goes from batch to batch."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from priorframe.plans import stream_queries as S
from priorframe.sources.tables import Workspace
from priorframe.streaming.stateful import PROVIDER, Exposure, keyed_state


def test_slices_are_written_in_order_of_time(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(50)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, second long").select("id", F.timestamp_seconds("second").alias("ts")).repartition(4)
    w = Workspace(spark, "slices")
    S.queue_slices(w, df, "ts", slice_rows=60)
    files = spark.read.parquet(f"{w.path}/events").select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("m"))
    spans = files.groupBy("f", "m").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n")).orderBy("m").collect()
    assert sum(r.n for r in spans) == 500 and len(spans) >= 8
    assert all(a.high < b.low for a, b in zip(spans, spans[1:]))


class Plain(dict):
    def put(self, name, value):
        if value is None:
            self.pop(name, None)
        else:
            self[name] = value


def test_admission_equals_a_plain_loop_and_is_stable(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = {}
    by = defaultdict(list)
    for r in S._bets(events).orderBy("ts", "event_id").collect():
        by[r.portfolio_id].append((r.event_id, r.kind, r.player_id, r.game_id, r.amount))
    for rows in by.values():
        exposure = Exposure(Plain(), Plain(), 0.0)
        for event_id, *event in rows:
            amount, approved, reason = exposure.decide(*event)
            want[event_id] = (event[0], round(amount, 9), approved, reason)
    plain = lambda df: {r.event_id: (r.kind, round(r.amount, 9), r.approved, r.reason) for r in df.collect()}
    for _ in range(2):
        assert plain(S.x02(spark, sf)) == {k: v for k, v in want.items() if v[0] == "place"}
    assert plain(S.x03(spark, sf)) == {k: v for k, v in want.items() if v[0] != "place"}
    alerts = {r.event_id for r in S.x04(spark, sf).collect()}
    assert alerts == {k for k, v in want.items() if v[0] == "place" and v[2]}
    assert {v[3] for v in want.values()} >= {"approved", "player", "released"}


def test_state_setting_is_put_back(spark):
    before = spark.conf.get(PROVIDER)
    with keyed_state(spark):
        assert spark.conf.get(PROVIDER) != before
    assert spark.conf.get(PROVIDER) == before


def test_keys_share_calls_and_state_requests(spark):
    """A batch asks once for each bucket's state, however many keys it has, and gives the plain results across batches."""
    from priorframe.streaming import stateful as X

    rows = [(k % 400 if k % 401 else None, k, 1_700_000_000 + k // 3, float(k % 17)) for k in range(2000)]
    df = spark.createDataFrame(rows, "entity long, event_id long, second long, value double")
    df = df.select("entity", "event_id", F.timestamp_seconds("second").alias("ts"), "value")
    w = Workspace(spark, "levels")
    schema = S.queue_slices(w, df, "ts")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{w.path}/events")
    leveled = X.filter_levels(stream, 50.0, 1.0, 100.0, 1000.0, buckets=3)
    assert "bucket" in leveled._jdf.queryExecution().analyzed().toString()
    got = {r.event_id: (r.entity, r.mean, r.variance) for r in X.run_to_end(leveled, w, "out").collect()}
    levels, want = {}, {}
    for entity, event_id, _, value in rows:
        mean, var = levels.get(entity, (50.0, 1000.0))
        gain = (var + 1.0) / (var + 1.0 + 100.0)
        levels[entity] = mean + gain * (value - mean), (1 - gain) * (var + 1.0)
        want[event_id] = (entity, *levels[entity])
    assert got == want
    assert len(spark.read.parquet(f"{w.path}/events").select(F.input_file_name()).distinct().collect()) == 4


def test_an_empty_table_streams(spark):
    w = Workspace(spark, "none")
    df = spark.createDataFrame([], "id long, ts timestamp")
    S.queue_slices(w, df, "ts")
    assert spark.read.schema(df.schema).parquet(f"{w.path}/events").count() == 0
