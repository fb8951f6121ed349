"""Streaming queries, each run to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timesift.operators.segments import rolling_step
from timesift.plans.catalog import query
from timesift.plans.segment_plans import _CURRENT
from timesift.session import shared_dir
from timesift.streaming import folds, jobs

_DELAY = "10 seconds"


def _events(spark, sf):
    return jobs.read_stream(spark, f"{sf}/events.parquet").withColumn("ts", jobs.event_time("ts"))


def _finished(spark, sf):
    return jobs.with_end(_events(spark, sf), "ts")


@query("stream_once", "SELECT event_id, user_id, event_type FROM events")
def stream_once(spark, sf):
    base = f"{shared_dir(spark)}/timesift/once-{uuid.uuid4().hex}"
    twice = _events(spark, sf).unionByName(_events(spark, sf))
    landed = jobs.ingest_once(twice, "event_id", f"{base}/table", f"{base}/checkpoint")
    return landed.select("event_id", "user_id", "event_type")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 14400000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g),
c AS (SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS items FROM s GROUP BY user_id, no)
SELECT user_id, start_us, items FROM c""")
def stream_sessions(spark, sf):
    found = jobs.pause_sessions(_finished(spark, sf), ["user_id"], "ts", "4 hours", _DELAY)
    return jobs.run_to_end(found, "sessions").select("user_id", F.unix_micros("start").alias("start_us"), "items")


@query("stream_budget", """WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS size, row_number() OVER w AS ord, sum(CAST(floor(value) AS BIGINT)) OVER w AS total
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id)),
b AS (SELECT user_id, min(ord) AS stop FROM e WHERE total > 300 OR (ord > 1 AND total - size >= 300) OR ord > 25 GROUP BY user_id)
SELECT e.user_id, e.event_id, stop IS NULL OR ord < stop AS allowed FROM e LEFT JOIN b USING (user_id)""")
def stream_budget(spark, sf):
    sends = _finished(spark, sf).withColumn("size", F.floor("value")).withWatermark("ts", _DELAY)
    return jobs.run_to_end(folds.stream_fold(
        sends, ["user_id"], "ts", "event_id", ["size"], folds.budget_step(300, 25), "allowed boolean"), "budget")


@query("stream_spacing", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) / 1000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n
  FROM events),
walk AS (SELECT user_id, event_id, n, t AS last, true AS kept FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t - w.last >= 20000 THEN e.t ELSE w.last END, e.t - w.last >= 20000 FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id FROM walk WHERE kept""")
def stream_spacing(spark, sf):
    items = _finished(spark, sf).withColumn("t", F.unix_millis("ts") / 1000.0).withWatermark("ts", _DELAY)
    return jobs.run_to_end(folds.stream_fold(
        items, ["user_id"], "ts", "event_id", ["t"], folds.spacing_step(20000.0), ""), "spacing")


@query("stream_rolling", f"""WITH RECURSIVE r0 AS (SELECT conv_id AS source_id, CAST(turn AS INT) AS seg_idx, text FROM conversations),
walk AS (SELECT source_id, seg_idx, text, seg_idx AS keeper, text AS kept_text FROM r0 WHERE seg_idx = 0
  UNION ALL SELECT source_id, seg_idx, CASE WHEN cur = '' THEN was ELSE cur END, CASE WHEN cur = '' THEN keeper ELSE seg_idx END, nullif(cur, '')
  FROM (SELECT r.source_id, r.seg_idx, w.text AS was, w.keeper, {_CURRENT} AS cur FROM walk w
    JOIN r0 r ON r.source_id = w.source_id AND r.seg_idx = w.seg_idx + 1))
SELECT source_id, seg_idx, keeper, kept_text FROM walk""")
def stream_rolling(spark, sf):
    """Turns of a conversation as captions, in turn order; a conversation starts at the hour of its number, with a turn a second."""
    turns = jobs.read_stream(spark, f"{sf}/conversations.parquet").select(
        F.col("conv_id").alias("source_id"), F.col("turn").cast("int").alias("seg_idx"), F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") + 1).alias("ts"), "text")
    return jobs.run_to_end(folds.stream_fold(
        jobs.with_end(turns, "ts").withWatermark("ts", _DELAY), ["source_id"], "ts", "seg_idx", ["seg_idx", "text"], rolling_step,
        "keeper int, kept_text string"), "rolling")
