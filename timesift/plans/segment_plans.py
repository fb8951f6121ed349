"""Queries over timed segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from timesift.functions import measures
from timesift.operators import segments as ops
from timesift.operators.keyed import row_index
from timesift.plans import views
from timesift.plans.catalog import query
from timesift.plans.text_plans import indexed_points, sql_stamp
from timesift.plans.views import sql

_SQL_GAPS = """g AS (SELECT *, start_s - lag(end_s) OVER (PARTITION BY source_id ORDER BY seg_idx) > 2.0 AS pause FROM v_segments),
total AS (SELECT source_id, arg_max(end_s, seg_idx) AS duration, bool_or(coalesce(pause, false)) AS has_pause FROM g GROUP BY source_id),
bounds AS (SELECT source_id, start_s FROM g WHERE pause
  UNION ALL SELECT source_id, 0.0 FROM total
  UNION ALL SELECT source_id, CAST(unnest(range(120, greatest(1, CAST(floor(duration) AS BIGINT)), 120)) AS DOUBLE) FROM total WHERE NOT has_pause),"""
SQL_CHAPTERS = _SQL_GAPS + """
numbered AS (SELECT source_id, CAST(row_number() OVER w - 1 AS INT) AS chapter_id, CAST(start_s AS DOUBLE) AS start_s, lead(CAST(start_s AS DOUBLE)) OVER w AS nxt
  FROM bounds WINDOW w AS (PARTITION BY source_id ORDER BY start_s)),
chapters AS (SELECT n.source_id, chapter_id, n.start_s, coalesce(nxt, greatest(duration, n.start_s + 1.0)) AS end_s FROM numbered n JOIN total USING (source_id))"""
SQL_ATTACHED = SQL_CHAPTERS + """,
attached AS (SELECT s.*, c.chapter_id FROM v_segments s ASOF JOIN chapters c ON s.source_id = c.source_id AND s.start_s >= c.start_s)"""
SQL_SPANS = SQL_ATTACHED + """,
walk AS (SELECT source_id, seg_idx, chapter_id, start_s AS span_start, seg_idx AS first_seg FROM attached WHERE seg_idx = 0
  UNION ALL SELECT a.source_id, a.seg_idx, a.chapter_id,
    CASE WHEN a.chapter_id <> w.chapter_id OR a.start_s - w.span_start >= 30 THEN a.start_s ELSE w.span_start END,
    CASE WHEN a.chapter_id <> w.chapter_id OR a.start_s - w.span_start >= 30 THEN a.seg_idx ELSE w.first_seg END
  FROM walk w JOIN attached a ON a.source_id = w.source_id AND a.seg_idx = w.seg_idx + 1),
spans AS (SELECT a.source_id, CAST(row_number() OVER (PARTITION BY a.source_id ORDER BY w.first_seg) - 1 AS INT) AS span_id,
  min(a.chapter_id) AS chapter_id, min(a.start_s) AS start_s, arg_max(a.end_s, a.seg_idx) AS end_s,
  string_agg(a.text, ' ' ORDER BY a.seg_idx) AS text, w.first_seg, max(a.seg_idx) AS last_seg
  FROM walk w JOIN attached a USING (source_id, seg_idx) GROUP BY a.source_id, w.first_seg)"""


def chaptered(spark, sf):
    """(segments with chapter_id, chapters) of the document corpus."""
    base = views.segments(spark, sf)
    chapters = ops.pause_chapters(base)
    return ops.attach_chapters(base, chapters), chapters


def spans(spark, sf):
    return ops.build_spans(ops.pause_marks(views.segments(spark, sf), one_record=True), one_record=True)


@query("range_filter", sql("SELECT source_id, seg_idx, start_s, end_s FROM v_segments WHERE end_s >= 60 AND start_s <= 300", "v_segments"))
def range_filter(spark, sf):
    return ops.filter_range(views.segments(spark, sf), 60, 300).select("source_id", "seg_idx", "start_s", "end_s")


# Confidence is made from the line length so that some rows break each rule.
@query("segment_rules", sql("""c AS (SELECT source_id, seg_idx, CASE WHEN seg_idx % 9 = 0 THEN end_s + 1 ELSE start_s END AS start_s, end_s,
  CASE WHEN seg_idx % 11 = 0 THEN '  ' ELSE text END AS text, length(text) / 500.0::DOUBLE AS confidence FROM v_segments)
SELECT source_id, seg_idx, rule FROM (SELECT source_id, seg_idx, 'timestamps' AS rule FROM c WHERE start_s < 0 OR end_s < start_s
  UNION ALL SELECT source_id, seg_idx, 'empty text' FROM c WHERE trim(text) = ''
  UNION ALL SELECT source_id, seg_idx, 'confidence' FROM c WHERE confidence NOT BETWEEN 0 AND 1)""", "v_segments"))
def segment_rules(spark, sf):
    rows = views.segments(spark, sf).withColumns({
        "start_s": F.when(F.col("seg_idx") % 9 == 0, F.col("end_s") + 1).otherwise(F.col("start_s")),
        "text": F.when(F.col("seg_idx") % 11 == 0, "  ").otherwise(F.col("text")),
        "confidence": F.length("text") / F.lit(500.0)})
    return rows.select("source_id", "seg_idx", F.explode(ops.segment_rules()).alias("rule"))


@query("eligible_sources", sql("""SELECT source_id, arg_max(end_s, seg_idx) AS duration FROM v_segments GROUP BY source_id
HAVING NOT (arg_max(end_s, seg_idx) > 0 AND arg_max(end_s, seg_idx) < 540)""", "v_segments"))
def eligible_sources(spark, sf):
    return ops.durations(views.segments(spark, sf)).where("not (duration > 0 and duration < 540)")


@query("cue_window", sql("""c AS (SELECT DISTINCT source_id, round(t, 2) AS t FROM v_points WHERE kind = 'click')
SELECT source_id, count(*) FILTER (WHERE t BETWEEN 3600 AND 1500000) AS kept, count(*) FILTER (WHERE NOT t BETWEEN 3600 AND 1500000) AS dropped
FROM c GROUP BY source_id""", "v_points"))
def cue_window(spark, sf):
    cues = views.points(spark, sf).where("kind = 'click'").select("source_id", F.round("t", 2).alias("t")).distinct()
    inside = F.col("t").between(3600, 1500000)
    return cues.groupBy("source_id").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


@query("cue_sample", sql("""c AS (SELECT DISTINCT source_id, round(t, 2) AS t FROM v_points WHERE kind = 'click'),
i AS (SELECT source_id, t, row_number() OVER (PARTITION BY source_id ORDER BY t) - 1 AS idx, count(*) OVER (PARTITION BY source_id) AS n FROM c WHERE t BETWEEN 3600 AND 1500000)
SELECT source_id, t FROM i WHERE n <= 5 OR idx IN (SELECT CAST(round_even(k * (n - 1) / 4.0, 0) AS BIGINT) FROM range(0, 5) r(k))""", "v_points"))
def cue_sample(spark, sf):
    cues = views.points(spark, sf).where("kind = 'click'").select("source_id", F.round("t", 2).alias("t")).distinct()
    return ops_even_sample(cues.where(F.col("t").between(3600, 1500000)), 5).select("source_id", "t")


def ops_even_sample(rows, wanted):
    """Evenly spread rows per source by time."""
    placed = row_index(rows, ["source_id"], [F.col("t")], F.floor(F.col("t") / 3600))
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(counts, "source_id").where(measures.even_pick(F.col("idx"), F.col("n"), F.lit(wanted)))


@query("cue_islands", sql("""c AS (SELECT source_id, seg_idx, start_s, end_s, CASE WHEN seg_idx % 4 = 1 THEN lag(text) OVER w
  WHEN seg_idx % 4 = 2 THEN coalesce(lag(text, 2) OVER w, '') || ' ' || text ELSE text END AS text FROM v_segments WINDOW w AS (PARTITION BY source_id ORDER BY seg_idx)),
f AS (SELECT *, CASE WHEN b IS NULL OR (text <> b AND NOT starts_with(text, b || ' ')) THEN 1 ELSE 0 END AS fresh
  FROM (SELECT *, lag(text) OVER (PARTITION BY source_id ORDER BY seg_idx) AS b FROM c)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY source_id ORDER BY seg_idx) AS island FROM f)
SELECT source_id, min(seg_idx) AS seg_idx, arg_min(start_s, seg_idx) AS start_s, arg_max(end_s, seg_idx) AS end_s, arg_max(text, seg_idx) AS text
FROM i GROUP BY source_id, island""", "v_segments"))
def cue_islands(spark, sf):
    from timesift.operators.keyed import with_previous

    back = with_previous(views.segments(spark, sf), ["source_id"], "seg_idx", {"b1": "text"})
    back = with_previous(back, ["source_id"], "seg_idx", {"b2": "b1"})
    repeated = back.withColumn("text", F.when(F.col("seg_idx") % 4 == 1, F.col("b1")).when(
        F.col("seg_idx") % 4 == 2, F.concat(F.coalesce("b2", F.lit("")), F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    return ops.collapse_repeats(repeated.drop("b1", "b2"))


_CUT = """list_max(list_filter(range(8, least(len(w.text), len(r.text)) + 1), lambda k: (k = len(r.text) OR substr(r.text, CAST(k AS INT) + 1, 1) = ' ')
   AND ends_with(w.text, substr(r.text, 1, CAST(k AS INT)))))"""
_CURRENT = f"""CASE WHEN contains(w.text, r.text) OR (len(r.text) >= 2 AND ends_with(w.text, substr(r.text, 1, len(r.text) // 2))) THEN ''
   WHEN {_CUT} IS NULL THEN r.text ELSE ltrim(substr(r.text, CAST({_CUT} AS INT) + 1)) END"""


@query("rolling_dedupe", sql(f"""walk AS (SELECT source_id, seg_idx, text, seg_idx AS keeper FROM v_rolling WHERE seg_idx = 0
  UNION ALL SELECT source_id, seg_idx, CASE WHEN cur = '' THEN was ELSE cur END, CASE WHEN cur = '' THEN keeper ELSE seg_idx END
  FROM (SELECT r.source_id, r.seg_idx, w.text AS was, w.keeper, {_CURRENT} AS cur FROM walk w
    JOIN v_rolling r ON r.source_id = w.source_id AND r.seg_idx = w.seg_idx + 1))
SELECT w.source_id, w.keeper AS seg_idx, arg_min(r.start_s, r.seg_idx) AS start_s, max(r.end_s) AS end_s, arg_min(w.text, w.seg_idx) AS text
FROM walk w JOIN v_rolling r USING (source_id, seg_idx) GROUP BY w.source_id, w.keeper""", "v_rolling"))
def rolling_dedupe(spark, sf):
    return ops.collapse_rolling(views.rolling(spark, sf), one_record=True)


@query("pause_chapters", sql(SQL_CHAPTERS + f""" SELECT source_id, chapter_id, start_s, end_s, 'Segment ' || CAST(chapter_id + 1 AS VARCHAR) || ' (' ||
  {sql_stamp('start_s')} || '-' || {sql_stamp('end_s')} || ')' AS title FROM chapters""", "v_segments"))
def pause_chapters(spark, sf):
    return ops.pause_chapters(views.segments(spark, sf))


@query("asof_chapter", sql(SQL_ATTACHED + " SELECT source_id, seg_idx, chapter_id FROM attached", "v_segments"))
def asof_chapter(spark, sf):
    return chaptered(spark, sf)[0].select("source_id", "seg_idx", "chapter_id")


@query("build_spans", sql(SQL_SPANS + " SELECT source_id, span_id, chapter_id, start_s, end_s, text, first_seg, last_seg FROM spans", "v_segments"))
def build_spans(spark, sf):
    return spans(spark, sf)


# A user's events as one long stretch without chapters, a day in 4.3 s: no key is one record here.
@query("stretch_spans", sql("""p AS (SELECT source_id, t / 20000 AS s, row_number() OVER (PARTITION BY source_id ORDER BY t, item_id) - 1 AS i FROM v_points),
walk AS (SELECT source_id, i, s AS opened, i AS first_seg FROM p WHERE i = 0
  UNION ALL SELECT p.source_id, p.i, CASE WHEN p.s - opened >= 30 THEN p.s ELSE opened END, CASE WHEN p.s - opened >= 30 THEN p.i ELSE first_seg END
  FROM walk w JOIN p ON p.source_id = w.source_id AND p.i = w.i + 1)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY first_seg) - 1 AS INT) AS span_id, CAST(first_seg AS INT) AS first_seg, CAST(max(i) AS INT) AS last_seg
FROM walk GROUP BY source_id, first_seg""", "v_points"))
def stretch_spans(spark, sf):
    start = F.col("t") / 20000
    made = indexed_points(spark, sf).select(
        "source_id", F.col("idx").cast("int").alias("seg_idx"), start.alias("start_s"), start.alias("end_s"),
        F.lit(0).alias("chapter_id"), F.col("kind").alias("text"))
    return ops.build_spans(made).select("source_id", "span_id", "first_seg", "last_seg")


@query("span_context", sql(SQL_SPANS + f""" SELECT p.source_id, p.span_id, min(s.start_s) AS t0, arg_max(s.end_s, s.seg_idx) AS t1,
  string_agg('[' || {sql_stamp('s.start_s')} || '] ' || s.text, chr(10) ORDER BY s.seg_idx) AS block
FROM spans p JOIN v_segments s ON s.source_id = p.source_id AND s.seg_idx BETWEEN p.first_seg - 1 AND p.last_seg + 1 GROUP BY p.source_id, p.span_id""", "v_segments"))
def span_context(spark, sf):
    picked = spans(spark, sf).select("source_id", "span_id", "first_seg", "last_seg")
    return ops.span_context(picked, views.segments(spark, sf), pad=1).select("source_id", "span_id", "t0", "t1", "block")
