"""Queries for request logs (R), as batch twins and as stream runs over the same table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.plans.fixtures import with_views
from pagelens.plans.registry import case
from pagelens.session import ensure_checkpoint_dir
from pagelens.streaming import requests as rq

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _log(t):
    return t.req().withColumns({"current": F.when(F.col("state") != "error", F.col("generation")), "total": F.when(F.col("state") != "view", F.col("generation") - 5)})


@case("R1_progress", with_views("req", """
  SELECT item, current, total, current IS NOT NULL AND coalesce(total, 0) > 0 AS determinate FROM (
    SELECT item, CASE WHEN state <> 'error' THEN generation END AS current, CASE WHEN state <> 'view' THEN generation - 5 END AS total,
      row_number() OVER (PARTITION BY item ORDER BY ts DESC, event_id DESC) AS rn FROM req) WHERE rn = 1"""))
def r1(t):
    return rq.progress(_log(t))


SUPERSEDED = """SELECT event_id, item, generation FROM (
    SELECT *, max(generation) OVER (PARTITION BY item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM req)
  WHERE newest IS NULL OR generation >= newest"""
STALLED = """SELECT event_id, item FROM (SELECT *, lead(ts) OVER (PARTITION BY item ORDER BY ts, event_id) AS nxt FROM req WHERE state IN ('view', 'click', 'purchase'))
  WHERE state IN ('view', 'click') AND coalesce(nxt, (SELECT max(ts) FROM req)) > ts + INTERVAL 4 SECOND"""
CHANGES = """SELECT event_id, item, state FROM (SELECT *, lag(state) OVER w AS before, row_number() OVER w AS rn FROM req WINDOW w AS (PARTITION BY item ORDER BY ts, event_id))
  WHERE rn = 1 OR state IS DISTINCT FROM before"""


def _starts_ends():
    return F.col("state").isin("view", "click"), F.col("state") == "purchase"


@case("R2_drop_superseded", with_views("req", SUPERSEDED))
def r2(t):
    return rq.drop_superseded(t.req()).select("event_id", "item", "generation")


@case("R3_stalled", with_views("req", STALLED))
def r3(t):
    return rq.stalled(t.req(), *_starts_ends()).select("event_id", "item")


@case("R4_change_feed", with_views("req", CHANGES))
def r4(t):
    return rq.change_feed(t.req(), "state").select("event_id", "item", "state")


def _stream(t) -> DataFrame:
    """The log as a file stream over the driver's table."""
    source = t.table("events")
    events = t.spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").option(
        "maxFilesPerTrigger", 64).parquet(t.folder)
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("item"), F.col("event_type").alias("state"),
        F.get_json_object("props", "$.k").cast("int").alias("generation"))


def _run(t, stream: DataFrame) -> DataFrame:
    """Run the stream over all available input into a folder of the shared checkpoint directory."""
    ensure_checkpoint_dir(t.spark)
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = f"{t.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/out")


@case("R2_drop_superseded_stream", with_views("req", SUPERSEDED))
def r2_stream(t):
    return _run(t, rq.drop_superseded_stream(_stream(t))).select("event_id", "item", "generation")


@case("R3_stalled_stream", with_views("req", STALLED))
def r3_stream(t):
    return _run(t, rq.stalled_stream(_stream(t), *_starts_ends(), lateness="0 seconds")).select("event_id", "item")


@case("R4_change_feed_stream", with_views("req", CHANGES))
def r4_stream(t):
    return _run(t, rq.change_feed_stream(_stream(t))).select("event_id", "item", "state")
