"""Structured Streaming jobs: candles from trades, threshold alerts, signal dedupe."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALERT_SCHEMA = "symbol string, ts timestamp, distance double, threshold double"
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def candle_stream(ticks: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Daily candles of a tick stream (symbol, ts, price, size, seq).

    Partial aggregates per (symbol, day) live in the state store until the watermark passes the
    day, so state is bounded by symbols times open days.
    """
    order = F.struct("ts", "seq")
    day = F.window("ts", "1 day")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("symbol", day)
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("symbol", F.col("window.start").cast("date").alias("ts"), "open", "high", "low", "close", "volume")
    )


class CrossingProcessor(StatefulProcessor):
    """Fires a row when a symbol's distance crosses its threshold, in the order of event time.

    Rows wait in a list until the watermark has passed them, so that batches may bring them in any order; a timer at the
    earliest waiting row wakes the symbol. What is kept is the rows of the watermark's delay and the last distance.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "distance double")
        self.waiting = handle.getListState("waiting", "ts timestamp, distance double, threshold double")

    def _wake(self, first: pd.Timestamp) -> None:
        """One timer a symbol, at the earliest waiting row."""
        due = int(first.timestamp() * 1000)
        set_ = list(self.handle.listTimers())
        if set_ and min(set_) <= due:
            return
        for timer in set_:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues):
        frames = [f for f in rows if len(f)]
        if frames:
            new = pd.concat(frames)
            self.waiting.appendList(list(new[["ts", "distance", "threshold"]].itertuples(index=False, name=None)))
            self._wake(new["ts"].min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        waiting = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=["ts", "distance", "threshold"])
        waiting = waiting.sort_values(["ts", "distance"], kind="stable")
        seen, later = waiting[waiting["ts"] <= mark], waiting[waiting["ts"] > mark]
        self.waiting.put(list(later.itertuples(index=False, name=None))) if len(later) else self.waiting.clear()
        if len(later):
            self.handle.registerTimer(int(later["ts"].iloc[0].timestamp() * 1000))
        if len(seen):
            previous = self.last.get()[0] if self.last.exists() else float("inf")
            before = seen["distance"].shift(1, fill_value=previous)
            hit = (before > seen["threshold"]) & (seen["distance"] <= seen["threshold"])
            self.last.update((float(seen["distance"].iloc[-1]),))
            out = seen[hit]
            if len(out):
                yield out.assign(symbol=key[0])[["symbol", "ts", "distance", "threshold"]].reset_index(drop=True)

    def close(self) -> None:
        pass


def alert_stream(distances: DataFrame, watchlist: DataFrame, default: float, lateness: str = "2 days") -> DataFrame:
    """Threshold crossings of a (symbol, ts, distance) stream against a static watchlist.

    Rows up to `lateness` behind the newest may come in any order. An alert is written once the watermark passes it; rows
    of symbols nobody watches, a heartbeat for example, move the watermark and nothing else. The session needs the
    RocksDB state store (`STATE_STORE`).
    """
    known = watchlist.select("symbol", F.coalesce("threshold_pct", F.lit(default)).alias("threshold"))
    return (
        distances.withWatermark("ts", lateness)
        .join(known, "symbol")
        .groupBy("symbol")
        .transformWithStateInPandas(CrossingProcessor(), ALERT_SCHEMA, "Append", "EventTime")
    )


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that custom state needs; `spark` keeps its settings."""
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        if (value := spark.conf.get(key, None)) is not None and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set(*STATE_STORE)
    return session


def signal_stream(signals: DataFrame, lateness: str = "400 days") -> DataFrame:
    """Each (watch, date, action, symbol) once, however often it is sent while the watermark allows."""
    return signals.withWatermark("date", lateness).dropDuplicatesWithinWatermark(["watch_id", "date", "action", "symbol"])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", sink=None) -> None:
    """Process everything available and stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink is not None else writer.format("parquet").option("path", path).start()
    query.awaitTermination()
