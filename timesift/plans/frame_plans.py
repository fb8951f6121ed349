"""Queries over frames and timed points."""

from __future__ import annotations

from pyspark.sql import functions as F

from timesift.operators import evidence, frames, segments
from timesift.plans import views
from timesift.plans.catalog import query
from timesift.plans.text_plans import indexed_points
from timesift.plans.views import sql

# Random signatures differ a lot, so these queries use wide thresholds.
_DELTA = 20.0
_WIDE = {"tolerance": 60, "allowed_pct": 30.0}


@query("frame_dedupe_last", sql(f"""walk AS (SELECT source_id, idx, thumb AS last, idx AS keeper FROM v_frames WHERE idx = 0
  UNION ALL SELECT f.source_id, f.idx, CASE WHEN d <= {_DELTA} THEN last ELSE thumb END, CASE WHEN d <= {_DELTA} THEN keeper ELSE f.idx END
  FROM (SELECT f.source_id, f.idx, f.thumb, w.last, w.keeper, list_sum(list_transform(f.thumb, lambda x, i: abs(x - w.last[i]))) / CAST(len(f.thumb) AS DOUBLE) AS d
    FROM walk w JOIN v_frames f ON f.source_id = w.source_id AND f.idx = w.idx + 1) f)
SELECT source_id, idx, keeper FROM walk""", "v_frames"))
def frame_dedupe_last(spark, sf):
    return frames.mark_near_duplicates(views.frames(spark, sf), _DELTA).select("source_id", "idx", "keeper")


def _rgb(spark, sf):
    """The 64 values of a signature as 22 colour cells, the last one filled up with zeros."""
    return views.frames(spark, sf).withColumn("thumb", F.concat("thumb", F.array(F.lit(0), F.lit(0))))


_REPEATS = f"""len(list_filter(w.recent, lambda s: f.ts - s.at <= 90 AND len(list_filter(range(0, 22), lambda i:
    greatest(abs(f.a[i * 3 + 1] - s.sig[i * 3 + 1]), abs(f.a[i * 3 + 2] - s.sig[i * 3 + 2]), abs(f.a[i * 3 + 3] - s.sig[i * 3 + 3])) > {_WIDE['tolerance']}))
    <= {_WIDE['allowed_pct']} * 22 / 100.0)) > 0"""


_WINDOWED = f"""sigs AS (SELECT source_id, idx, ts, list_concat(thumb, [0, 0]) AS a FROM v_frames),
walk AS (SELECT source_id, idx, [{{'sig': a, 'at': ts}}] AS recent, idx AS keeper FROM sigs WHERE idx = 0
  UNION ALL SELECT source_id, idx, CASE WHEN dup THEN recent ELSE list_append(recent, {{'sig': a, 'at': ts}})[-4:] END, CASE WHEN dup THEN keeper ELSE idx END
  FROM (SELECT f.source_id, f.idx, f.ts, f.a, w.recent, w.keeper, {_REPEATS} AS dup FROM walk w JOIN sigs f ON f.source_id = w.source_id AND f.idx = w.idx + 1))"""


@query("frame_dedupe_window", sql(_WINDOWED + " SELECT source_id, idx, keeper FROM walk", "v_frames"))
def frame_dedupe_window(spark, sf):
    return frames.mark_windowed(_rgb(spark, sf), **_WIDE).select("source_id", "idx", "keeper")


_MIDDLE = """list_min(list_transform(list_filter(pool, lambda x: x.ts > a AND x.ts < b),
    lambda x: {'far': abs(x.ts - (a + b) / 2), 'ts': x.ts, 'idx': x.idx}))"""


@query("gap_fill", sql(_WINDOWED + f""",
marked AS (SELECT source_id, idx, ts, keeper FROM walk JOIN sigs USING (source_id, idx)),
kept AS (SELECT source_id, idx AS gap, ts AS a, lead(ts) OVER (PARTITION BY source_id ORDER BY idx) AS b FROM marked WHERE keeper = idx),
pools AS (SELECT source_id, keeper AS gap, list({{'idx': idx, 'ts': ts}}) AS pool FROM marked WHERE keeper <> idx GROUP BY ALL),
halves AS (SELECT source_id, gap, '' AS path, a, b, pool, {_MIDDLE} AS p FROM kept JOIN pools USING (source_id, gap) WHERE b - a > 5
  UNION ALL SELECT *, {_MIDDLE} FROM (SELECT source_id, gap, path || side AS path, CASE side WHEN '0' THEN a ELSE p.ts END AS a, CASE side WHEN '0' THEN p.ts ELSE b END AS b, pool
    FROM halves, (VALUES ('0'), ('1')) s(side) WHERE p IS NOT NULL) WHERE b - a > 5)
SELECT source_id, idx, ts FROM (SELECT source_id, p.idx AS idx, p.ts AS ts, row_number() OVER (PARTITION BY source_id ORDER BY gap, path) AS n FROM halves WHERE p IS NOT NULL) WHERE n <= 30""", "v_frames"))
def gap_fill(spark, sf):
    marked = frames.mark_windowed(_rgb(spark, sf), **_WIDE)
    limits = views.frames(spark, sf).select("source_id").distinct().select(
        "source_id", F.lit(5.0).alias("floor_s"), F.lit(30).alias("max_fill"))
    return frames.gap_fill(marked, limits)


@query("frame_selection")
def frame_selection(spark, sf):
    return frames.select_frames(_rgb(spark, sf), budget=20, **_WIDE)


@query("spaced_topk", sql("""r AS (SELECT source_id, item_id, t, score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, t, item_id) AS n FROM v_points),
walk AS (SELECT source_id, item_id, t, n, [t] AS kept, true AS ok FROM r WHERE n = 1
  UNION ALL SELECT source_id, item_id, t, n, CASE WHEN fits THEN list_append(kept, t) ELSE kept END, fits
  FROM (SELECT r.source_id, r.item_id, r.t, r.n, w.kept, len(w.kept) < 12 AND len(list_filter(w.kept, lambda k: abs(k - r.t) < 50000)) = 0 AS fits
    FROM walk w JOIN r ON r.source_id = w.source_id AND r.n = w.n + 1))
SELECT source_id, item_id FROM walk WHERE ok""", "v_points"))
def spaced_topk(spark, sf):
    return frames.spaced_topk(views.points(spark, sf), 12, 50000.0).select("source_id", "item_id")


@query("even_sample", sql("""n AS (SELECT source_id, count(*) AS n FROM v_frames GROUP BY ALL)
SELECT source_id, idx FROM v_frames JOIN n USING (source_id) WHERE n <= 7 OR idx IN (SELECT CAST(round_even(k * (n - 1) / 6.0, 0) AS INT) FROM range(0, 7) r(k))""", "v_frames"))
def even_sample(spark, sf):
    return frames.even_sample(views.frames(spark, sf).select("source_id", "idx"), F.lit(7))


@query("uniform_grid", sql("""d AS (SELECT source_id, arg_max(end_s, seg_idx) AS duration FROM v_segments GROUP BY source_id)
SELECT source_id, CAST(i AS INT) AS i, duration * (i + 0.5) / 32 AS ts FROM d, range(0, 32) r(i)""", "v_segments"))
def uniform_grid(spark, sf):
    return evidence.uniform_grid(segments.durations(views.segments(spark, sf)), 32).select("source_id", "i", "ts")


@query("merge_timeline", sql("""SELECT source_id, item_id, row_number() OVER (PARTITION BY source_id ORDER BY t, kind = 'click', item_id) - 1 AS idx
FROM v_points WHERE kind IN ('click', 'view')""", "v_points"))
def merge_timeline(spark, sf):
    points = views.points(spark, sf).select("source_id", "item_id", "t", "kind")
    return frames.merge_timeline(points.where("kind = 'view'"), points.where("kind = 'click'")).select(
        "source_id", "item_id", "idx")


@query("gap_stats", sql("""g AS (SELECT source_id, lead(t) OVER (PARTITION BY source_id ORDER BY t, item_id) - t AS gap FROM v_points)
SELECT source_id, round(max(gap), 6) AS max_gap, round(avg(gap), 4) AS mean_gap FROM g WHERE gap IS NOT NULL GROUP BY source_id""", "v_points"))
def gap_stats(spark, sf):
    return frames.gap_stats(indexed_points(spark, sf)).select(
        "source_id", F.round("max_gap", 6).alias("max_gap"), F.round("mean_gap", 4).alias("mean_gap"))
