"""Request logs (event_id, ts, item, state, value, generation): stream jobs and their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelens.operators.skew import numbered, position_block, running

ORDER = ["ts", "event_id"]
STALL_SECONDS = 4


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def progress(log: DataFrame) -> DataFrame:
    """Latest current and total per item; determinate only if both are set and the total is positive.

    Works on a table and, in update mode, on a stream.
    """
    latest = log.groupBy("item").agg(F.max_by(F.struct("current", "total"), F.struct(*ORDER)).alias("_l"))
    both = F.col("_l.current").isNotNull() & (F.coalesce("_l.total", F.lit(0)) > 0)
    return latest.select("item", F.col("_l.current").alias("current"), F.col("_l.total").alias("total"), both.alias("determinate"))


def drop_superseded(log: DataFrame) -> DataFrame:
    """Rows whose generation is not older than the newest seen before for their item."""
    rows = numbered(_stamped(log), ["item"], ORDER)
    seen = running(rows, ["item"], ["_pos"], position_block("_pos"), {"_newest": ("max", F.col("generation"))}, inclusive=False)
    return seen.filter(F.col("_newest").isNull() | (F.col("generation") >= F.col("_newest"))).select(*log.columns)


def change_feed(log: DataFrame, value: str) -> DataFrame:
    """Rows whose value differs from the row before for their item; nulls compare as values."""
    rows = numbered(_stamped(log), ["item"], ORDER)
    before = F.struct(F.col(value).alias("v"))
    seen = running(rows, ["item"], ["_pos"], position_block("_pos"), {"_prev": ("last", before)}, inclusive=False)
    return seen.filter(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(value))).select(*log.columns)


def stalled(log: DataFrame, starts: Column, ends: Column, seconds: int = STALL_SECONDS) -> DataFrame:
    """Starts without an end of the same item within ``seconds``. Rows that are neither never stall.

    A later start of the item replaces the running one. The last start stalls if the log goes on (by any
    item) past its time limit.
    """
    rows = _stamped(log).select("event_id", "ts", "item", starts.alias("_start"), ends.alias("_end")).filter("_start OR _end")
    following = running(
        numbered(rows, ["item"], ORDER), ["item"], ["_pos"], position_block("_pos"),
        {"_next": ("last", F.struct("ts", "_start"))}, inclusive=False, reverse=True,
    ).filter("_start")
    limit = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))
    now = _stamped(log).agg(F.max("ts").alias("now"))
    late = F.coalesce(F.col("_next.ts"), now.scalar()) > limit
    return following.filter(late).select("item", "event_id", "ts")


# --- stream forms ------------------------------------------------------------------------------

class _NewestGeneration(StatefulProcessor):
    """Keeps the newest generation per item; passes rows that are not older."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("generation", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        for batch in _in_order(rows):
            # nulls raise nothing and, as in the batch form, pass only while no generation is known
            before = batch["generation"].cummax().ffill().shift(1)
            if newest is not None:
                before = before.fillna(newest).clip(lower=newest)
            yield batch[before.isna() | (batch["generation"] >= before)]
            known = batch["generation"].dropna()
            if len(known):
                top = int(known.max())
                newest = top if newest is None else max(newest, top)
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


class _LastValue(StatefulProcessor):
    """Keeps the last value per item; passes rows that change it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("state", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        last = self.last.get()[0] if known else None
        for batch in _in_order(rows):
            before = batch["state"].shift(1)
            changed = (batch["state"] != before) & ~(batch["state"].isna() & before.isna())
            first = batch["state"].iloc[0]
            same = (pd.isna(first) and pd.isna(last)) or first == last
            changed.iloc[0] = not (known and same)
            yield batch[changed]
            last = batch["state"].iloc[-1]
            known, last = True, None if pd.isna(last) else last
        if known:
            self.last.update((last,))

    def close(self) -> None:
        pass


class _StallTimer(StatefulProcessor):
    """Holds the running start of an item and an event-time timer at its limit."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType())]
        self.running = handle.getValueState("running", T.StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.running.get()) if self.running.exists() else None
        out = []
        limit = pd.Timedelta(seconds=self.seconds)
        for batch in _in_order(part[part["starts"] | part["ends"]] for part in rows):
            for event_id, ts, starts in zip(batch["event_id"], batch["ts"], batch["starts"]):
                if held is not None and pd.Timestamp(ts) > pd.Timestamp(held[1]) + limit:
                    out.append((key[0], held[0], held[1]))
                held = (event_id, pd.Timestamp(ts).to_pydatetime()) if starts else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.running.clear()
        else:
            self.running.update(held)
            # The watermark passes a limit only when a later row has; one more millisecond keeps "later" strict.
            self.handle.registerTimer(int((pd.Timestamp(held[1]).tz_localize("UTC") + limit).timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=["item", "event_id", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.running.exists():
            event_id, ts = self.running.get()
            self.running.clear()
            yield pd.DataFrame([(key[0], event_id, ts)], columns=["item", "event_id", "ts"])

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one micro-batch and item in event order."""
    parts = [part for part in rows if len(part)]
    if parts:
        yield pd.concat(parts).sort_values(["ts", "event_id"]).reset_index(drop=True)


def _stateful(stream: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    return stream.groupBy("item").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode)


def _schema(df: DataFrame) -> str:
    return df.schema.simpleString()[len("struct<"):-1]


def drop_superseded_stream(stream: DataFrame) -> DataFrame:
    """Stream form of ``drop_superseded``; needs the RocksDB state store."""
    return _stateful(stream, _NewestGeneration(), _schema(stream))


def change_feed_stream(stream: DataFrame) -> DataFrame:
    """Stream form of ``change_feed`` on the state column."""
    return _stateful(stream, _LastValue(), _schema(stream))


def stalled_stream(stream: DataFrame, starts: Column, ends: Column, lateness: str, seconds: int = STALL_SECONDS) -> DataFrame:
    """Stream form of ``stalled``: an event-time timer fires when the watermark passes a start's limit.

    Spark drops rows more than ``lateness`` behind the newest one and counts them in the query's progress
    (``numRowsDroppedByWatermark``); choose it as long as the source can be late.
    Rows that neither start nor end stay in the stream, because they too move the watermark.
    """
    marked = stream.select("event_id", "ts", "item", starts.alias("starts"), ends.alias("ends"))
    return _stateful(
        marked.withWatermark("ts", lateness), _StallTimer(seconds), "item long, event_id long, ts timestamp", "EventTime")
