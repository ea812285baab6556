"""Batches of an exact size from a stream of seeds, with what is left over kept as state between micro-batches.

Seeds are dealt over lanes, each a key of its own with its own batches, so lanes are cut in parallel. Within a lane seeds are taken
in the order of `seq`; a batch goes out as soon as its last seed is in, and what is left waits in the state store. So batches depend
on the order of the seeds and not on how files or micro-batches cut it, as long as files come in that order. When the event-time
watermark passes a lane's last seed by `idle`, a timer sends what is left as the lane's last, smaller batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "lane int, batch long, rank int, node long, last boolean"


class SeedBatcher(StatefulProcessor):
    def __init__(self, size: int, idle_ms: int):
        self.size, self.idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getListState("left", "node long")
        self.sent = handle.getValueState("sent", "batches long")

    def _held(self) -> list[int]:
        return [r[0] for r in self.left.get()] if self.left.exists() else []

    def _frame(self, lane: int, first: int, nodes: list[int], last: bool) -> pd.DataFrame:
        at = range(len(nodes))
        return pd.DataFrame({"lane": pd.Series([lane] * len(nodes), dtype="int32"), "batch": [first + i // self.size for i in at], "rank": pd.Series([i % self.size for i in at], dtype="int32"), "node": nodes, "last": [last] * len(nodes)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows)
        new = new[new["node"].notna()].sort_values("seq", kind="stable")
        if not len(new):  # marks alone
            return
        latest = int(new["ts"].max().timestamp() * 1000)
        nodes = self._held() + new["node"].astype("int64").tolist()
        first = self.sent.get()[0] if self.sent.exists() else 0
        whole = len(nodes) // self.size * self.size
        self.left.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(nodes) > whole:
            self.left.put([(n,) for n in nodes[whole:]])
            self.handle.registerTimer(latest + self.idle_ms)
        self.sent.update((first + whole // self.size,))
        if whole:
            yield self._frame(key[0], first, nodes[:whole], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        nodes = self._held()
        if nodes:
            first = self.sent.get()[0] if self.sent.exists() else 0
            self.left.clear()
            self.sent.update((first + 1,))
            yield self._frame(key[0], first, nodes, True)

    def close(self) -> None:
        pass


def exact_batches(seeds: DataFrame, size: int, lanes: int = 8, late: str = "0 seconds", idle_ms: int = 60_000) -> DataFrame:
    """lane, batch, rank, node, last of a stream of seeds (seq, node, ts). A row without a node is a mark: it carries time on, so
    that lanes that have gone quiet send what they hold. State is in the RocksDB store (see with_state_store)."""
    lane = F.pmod(F.xxhash64(F.coalesce("node", "seq")), F.lit(lanes)).cast("int")
    rows = seeds.withWatermark("ts", late).select("seq", "node", "ts", lane.alias("lane"))
    return rows.groupBy("lane").transformWithStateInPandas(SeedBatcher(size, idle_ms), OUT, "Append", "EventTime")


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(out: DataFrame, path: str, checkpoint: str):
    """Starts writing a stateful stream as Parquet, with the state store that such streams need; the session's own is put back, as a
    query keeps the settings that it began with."""
    conf, key = out.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, PROVIDER)
    try:
        return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(path)
    finally:
        conf.set(key, before)
