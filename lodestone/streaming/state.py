"""Quotes with state in the stream: changed prices and messages, by symbol, with timers that let silent symbols go."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.sources.shared import folder

#: Files that one part of an arrival has, and a batch reads.
FILES = 2
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Sessions of a symbol whose closes are kept, so that a late or corrected tick counts for the change from the one before.
KEPT = 5
#: A symbol without a tick for so long is forgotten.
SILENT_MS = 7 * 86_400_000


def arriving(spark: SparkSession, parts: list[DataFrame], files: int = FILES) -> DataFrame:
    """The rows of ``parts`` as a stream of one batch each, in order: each part is so many ``files``, and so is a batch. Parts
    of a few rows, which don't fill several, take one."""
    path = f"{folder(spark)}/arrivals-{uuid.uuid4().hex}"
    for part in parts:
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which value states and timers need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Forgetting(StatefulProcessor):
    """A symbol's state, and a timer that clears it SILENT_MS of event time after its last tick."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "told string, until long")

    def known(self) -> dict | None:
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def keep(self, told: dict, last: pd.Timestamp) -> None:
        until = last.value // 1_000_000 + SILENT_MS
        if self.state.exists():
            before = int(self.state.get()[1])
            until = max(until, before)
            self.handle.deleteTimer(before)
        self.handle.registerTimer(until)
        self.state.update((json.dumps(told), until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Changes(Forgetting):
    """Ticks whose price is not that of their symbol's one before, as they arrive; ticks of one batch by time and id."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        ticks = pd.concat(rows).sort_values(["ts", "event_id"])
        known = self.known()
        last = known["price"] if known else None
        before = ticks["price"].shift(1)
        if last is not None:
            before.iloc[0] = last
        self.keep({"price": float(ticks["price"].iloc[-1])}, ticks["ts"].max())
        yield ticks.loc[ticks["price"] != before, ["symbol", "event_id", "price"]]


class Messages(Forgetting):
    """A message when a symbol's newest session or its close is not what was sent last.

    A session's close is that of its last tick by time, or by version where a tick was corrected; the change is from the
    close of the session before, as far as it is known now.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N803
        ticks = pd.concat(rows)
        told = self.known() or {"sent": None, "closes": {}}
        closes = {k: tuple(v) for k, v in told["closes"].items()}  # session: (time, event, version, price)
        for ts, event, version, price in zip(ticks["ts"], ticks["event_id"], ticks["version"], ticks["price"], strict=True):
            day = str(ts.date())
            own = (ts.value, int(event), int(version), float(price))
            closes[day] = max(own, closes.get(day, own))
        days = sorted(closes)[-KEPT:]
        close = closes[days[-1]][3]
        before = closes[days[-2]][3] if len(days) > 1 else None
        now = [days[-1], close]
        self.keep({"sent": now, "closes": {d: closes[d] for d in days}}, ticks["ts"].max())
        if now != told["sent"]:
            change = None if not before else (close - before) / before * 100
            yield pd.DataFrame({"symbol": [key[0]], "session": [days[-1]], "close": [close], "change": [change]})


def changes(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """(symbol, event_id, price): ticks whose price is new, of a stream (symbol, ts, event_id, version, price); replayed ticks are dropped
    within the watermark, and ticks behind it."""
    fresh = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id", "version"])
    return fresh.groupBy("symbol").transformWithStateInPandas(Changes(), "symbol string, event_id long, price double", "Append", "EventTime")


def closes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each symbol and day the tick that counts (the last by time, event and version), in a task's share of a batch."""
    best = None
    for batch in batches:
        if len(batch):
            own = batch.to_pandas()
            own = own if best is None else pd.concat([best, own])
            own = own.sort_values(["ts", "event_id", "version", "price"], kind="stable")
            best = own.groupby(["symbol", own["ts"].dt.date], sort=False, dropna=False).tail(1)
            schema = batch.schema
    if best is not None:
        yield pa.RecordBatch.from_pandas(best, schema=schema, preserve_index=False)


def messages(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """(symbol, session, close, change_percent): texts for the wire, of a stream as for ``changes``."""
    fresh = ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id", "version"])
    few = fresh.select("symbol", "ts", "event_id", "version", "price").mapInArrow(closes, "symbol string, ts timestamp, event_id long, version int, price double")
    out = few.groupBy("symbol").transformWithStateInPandas(Messages(), "symbol string, session string, close double, change double", "Append", "EventTime")
    return out.select("symbol", "session", F.format_string("%.2f", "close").alias("close"), F.when(F.col("change").isNotNull() & ~F.isnan("change"), F.format_string("%.4f", F.round("change", 4))).alias("change_percent"))
