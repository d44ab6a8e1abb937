"""Streams: sizing, admission control with releases, captures, ingest, rounds and filters as Structured Streaming jobs.

Every job can also be run to the end of what is there (``availableNow``), with a checkpoint in the shared workspace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import kelly
from ..sources.tables import Workspace

LIMITS = {"player": 0.05, "game": 0.20, "total": 0.20}
#: Sums of doubles drift; a bet that meets a limit exactly is within it.
EPSILON = 1e-9
CHUNK_ROWS = 50_000
#: Keys are dealt to this many groups, which share their calls and state requests: one of each for a group and batch.
BUCKETS = 1024
DECISION = "portfolio_id string, event_id long, kind string, player_id string, game_id string, amount double, approved boolean, reason string"
NO_ENTITY = -1
LEVELS = "entity long, event_id long, mean double, variance double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state by entries (maps and values) in RocksDB, as transformWithState asks for."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_to_end(rows: DataFrame, workspace: Workspace, name: str, mode: str = "append") -> DataFrame:
    """Start a stream, wait until what is there is processed, and read what it wrote."""
    out = f"{workspace.path}/{name}"
    with keyed_state(workspace.spark):
        query = rows.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return workspace.spark.read.schema(rows.schema).parquet(out)


def run_batches(rows: DataFrame, workspace: Workspace, name: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream to its end with a function for every batch."""
    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{workspace.path}/{name}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def sized(events: DataFrame, probability: Column, decimal_odds: Column, threshold: float = 0.02) -> DataFrame:
    """Events with a stake, those without one left out; no state."""
    rows = events.withColumn("stake", kelly(probability, decimal_odds, 0.25, threshold, 0.05))
    return rows.where(F.col("stake") > 0)


class Exposure:
    """What is in play of one portfolio: by player, by game, in total. Entries are fetched once and written if touched."""

    def __init__(self, players, games, total: float):
        self.stores, self.held, self.touched = {"player": players, "game": games}, {"player": {}, "game": {}}, set()
        self.total = total

    def get(self, kind: str, name: str) -> float | None:
        held = self.held[kind]
        if name not in held:
            held[name] = self.stores[kind].get(name)
        return held[name]

    def put(self, kind: str, name: str, value: float | None) -> None:
        self.held[kind][name] = value
        self.touched.add((kind, name))

    def entries(self, kind: str) -> dict[str, float]:
        """What is known of a kind, with the changes, where the store is a dictionary."""
        return {name: value for name, value in (self.stores[kind] | self.held[kind]).items() if value is not None}

    def decide(self, kind: str, player: str, game: str, amount: float, limits: dict = LIMITS) -> tuple[float, bool, str]:
        """``(amount, approved, reason)`` of one event; a rejected bet changes nothing.

        A bet is checked against its player's, its game's and the total limit, in this order. A release takes the bet's amount
        from its player, its game (where they are known) and the total, none below zero. A released game takes its
        exposure from the total and is forgotten; its players keep theirs.
        """
        if kind == "release":
            for key, name in (("player", player), ("game", game)):
                if (held := self.get(key, name)) is not None:
                    self.put(key, name, max(0.0, held - amount))
            self.total = max(0.0, self.total - amount)
            return amount, True, "released"
        if kind == "release_game":
            if (held := self.get("game", game)) is not None:
                self.total = max(0.0, self.total - held)
                self.put("game", game, None)
            return held or 0.0, True, "released"
        now = {"player": self.get("player", player) or 0.0, "game": self.get("game", game) or 0.0, "total": self.total}
        over = next((k for k, v in now.items() if v + amount > limits[k] + EPSILON), None)
        if over:
            return amount, False, over
        self.put("player", player, now["player"] + amount)
        self.put("game", game, now["game"] + amount)
        self.total += amount
        return amount, True, "approved"


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A bucket's rows of a batch in event order, in bounded chunks; a batch is bounded by its files."""
    frame = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
    for at in range(0, len(frame), CHUNK_ROWS):
        yield frame.iloc[at : at + CHUNK_ROWS]


class Admission(StatefulProcessor):
    """Bets and releases of a bucket's portfolios, in event order. The state is an entry for each portfolio."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("exposures", "portfolio_id string, players map<string,double>, games map<string,double>, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: dict[str, Exposure] = {}
        for portfolio, players, games, total in self.state.get():
            held[portfolio] = Exposure(players, games, total)
        names = ["portfolio_id", "event_id", "kind", "player_id", "game_id", "amount"]
        for frame in _in_order(rows):
            out = []
            for e in zip(*(frame[c].tolist() for c in names)):
                if e[0] not in held:
                    held[e[0]] = Exposure({}, {}, 0.0)
                out.append((*e[:5], *held[e[0]].decide(*e[2:])))
            yield pd.DataFrame(out, columns=[*names, "approved", "reason"])
        entries = [(portfolio, x.entries("player"), x.entries("game"), x.total) for portfolio, x in held.items()]
        self.state.put(entries)

    def close(self) -> None:
        pass


def admission(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(portfolio_id, event_id, ts, kind, player_id, game_id, amount)`` to decisions, in event order per portfolio.

    Portfolios are independent; inside one the order is total. Buckets of portfolios share a call; a stream's number of
    buckets stays as it began.
    """
    columns = ["portfolio_id", "event_id", "ts", "kind", "player_id", "game_id", "amount"]
    bucket = F.pmod(F.xxhash64("portfolio_id"), F.lit(buckets)).alias("bucket")
    return events.select(*columns, bucket).groupBy("bucket").transformWithStateInPandas(Admission(), DECISION, "Append", "None")


def capture(snapshots: DataFrame, keys: list[str], stamp: str, lateness: str) -> DataFrame:
    """Each (key, stamp) once, as long as repetitions come within the lateness."""
    return snapshots.withWatermark(stamp, lateness).dropDuplicatesWithinWatermark([*keys, stamp])


class Levels(StatefulProcessor):
    """A scalar filter's posterior of each entity of a bucket; rows without an entity are a bucket of their own."""

    def __init__(self, start: float, q: float, r: float, p0: float):
        self.start, self.q, self.r, self.p0 = start, q, r, p0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("levels", "entity long, mean double, variance double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        levels = {entity: (mean, var) for entity, mean, var in self.state.get()}
        for frame in _in_order(rows):
            out = []
            for entity, event_id, value in zip(*(frame[c].tolist() for c in ("entity", "event_id", "value"))):
                entity = None if key[0] == NO_ENTITY else entity
                mean, var = levels.get(entity, (self.start, self.p0))
                var += self.q
                gain = var / (var + self.r)
                mean, var = levels[entity] = mean + gain * (float(value) - mean), (1 - gain) * var
                out.append((entity, event_id, mean, var))
            yield pd.DataFrame(out, columns=["entity", "event_id", "mean", "variance"])
        self.state.put([(entity, *level) for entity, level in levels.items()])

    def close(self) -> None:
        pass


def filter_levels(events: DataFrame, start: float, q: float, r: float, p0: float, buckets: int = BUCKETS) -> DataFrame:
    """``(entity, event_id, ts, value)`` to the filtered level after each event, from a prior, with a fixed observation variance."""
    # a null among them would make doubles of a batch's entities
    bucket = F.when(F.col("entity").isNull(), NO_ENTITY).otherwise(F.pmod(F.xxhash64("entity"), F.lit(buckets))).alias("bucket")
    rows = events.select(F.coalesce("entity", F.lit(0)).alias("entity"), "event_id", "ts", "value", bucket)
    return rows.groupBy("bucket").transformWithStateInPandas(Levels(start, q, r, p0), LEVELS, "Append", "None")
