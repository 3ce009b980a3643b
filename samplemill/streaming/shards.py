"""Samplers and batches over an unbounded stream, with typed state and timers.

State is small for each key: a count, and the rows that wait for others. It lives in the checkpoint of the
query, so a query that is started again goes on where the last finished batch of the stream ended, and with
a sink that writes once each row comes out once. The session's state store must be the RocksDB one
(`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keys that the rows of a sampler are dealt to, each with a count of its own.
LANES = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Groups(StatefulProcessor):
    """Rows of a key in groups of `size`, in the order of their arrival; what is over waits.

    Within a batch of the stream rows are put in order by the first of the columns. hold_ms: rows that have
    waited so long for others come out as a short group (whole false).
    """

    def __init__(self, key: str, columns: list[str], kinds: list[str], size: int, hold_ms: int | None):
        self.key, self.columns, self.kinds, self.size, self.hold_ms = key, columns, kinds, size, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getValueState("given", "groups long")
        self.waiting = handle.getListState("waiting", ", ".join(f"`{c}` {k}" for c, k in zip(self.columns, self.kinds, strict=True)))

    def _groups(self) -> int:
        return self.given.get()[0] if self.given.exists() else 0

    def _rows(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def _frame(self, key: tuple, rows: list[tuple], first: int, whole: bool) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.columns)
        place = pd.Series(range(len(rows)), dtype="int64")
        out.insert(0, "whole", whole)
        out.insert(0, "pos", place % self.size)
        out.insert(0, "group", first + place // self.size)
        out.insert(0, self.key, [key[0]] * len(rows))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([f[self.columns] for f in rows]).sort_values(self.columns[0], kind="stable")
        held = self._rows() + [tuple(r) for r in arrived.astype(object).itertuples(index=False, name=None)]
        ready, groups = len(held) // self.size * self.size, self._groups()
        self.given.update((groups + ready // self.size,))
        if held[ready:]:
            self.waiting.put(held[ready:])
        else:
            self.waiting.clear()
        if self.hold_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
            if held[ready:]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hold_ms)
        if ready:
            yield self._frame(key, held[:ready], groups, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, groups = self._rows(), self._groups()
        self.waiting.clear()
        if held:
            self.given.update((groups + 1,))
            yield self._frame(key, held, groups, False)

    def close(self) -> None:
        pass


def _grouped(stream: DataFrame, key: str, columns: list[str], size: int, hold_ms: int | None) -> DataFrame:
    kinds = dict(stream.dtypes)
    out = f"`{key}` {kinds[key]}, group long, pos long, whole boolean, " + ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    work = Groups(key, columns, [kinds[c] for c in columns], size, hold_ms)
    return stream.select(key, *columns).groupBy(key).transformWithStateInPandas(work, out, "Append", "None" if hold_ms is None else "ProcessingTime")


def stream_groups(stream: DataFrame, bucket: str, order: str, names: list[str], batch_size: int, hold_ms: int | None = None) -> DataFrame:
    """Batches of one bucket: bucket, group (its number in the bucket), pos, whole, order and names.

    Whole batches come out when their last row arrives. With hold_ms a bucket that nothing came to for so long
    gives what it has as a short batch; without, that waits.
    """
    return _grouped(stream, bucket, [order, *names], batch_size, hold_ms)


def stream_shards(stream: DataFrame, order: str, names: list[str], world_size: int, lanes: int = LANES) -> DataFrame:
    """Rows dealt to consumers: lane, round, rank (0 to world_size - 1), order and names.

    A row's lane follows from a hash of order, so that lanes are counted side by side; in its lane each round
    of world_size rows gives one to each rank. Rounds come out whole: ranks have equal numbers of rows at any
    time, and a last round that isn't whole waits. A consumer takes the rows of its rank.
    """
    dealt = stream.withColumn("lane", F.pmod(F.xxhash64(F.col(order)), F.lit(lanes)).cast("int"))
    out = _grouped(dealt, "lane", [order, *names], world_size, None)
    return out.select("lane", F.col("group").alias("round"), F.col("pos").cast("int").alias("rank"), order, *names)
