"""Queries over chunks, budgets, fallback and repetition."""

from __future__ import annotations

from pyspark.sql import functions as F

from timesift.operators import chunks
from timesift.plans import views
from timesift.plans.catalog import query, table
from timesift.plans.text_plans import _SENTENCE_SQL
from timesift.plans.views import sql


def audio_sources(spark, sf):
    """Users as recordings: length from their events, size in proportion."""
    return views.points(spark, sf).groupBy("source_id").agg(
        F.ceil(F.max("t") / 100).cast("double").alias("duration"), (F.count(F.lit(1)) * 700_000).alias("bytes"))


def silences(spark, sf, kind="view"):
    """Events as silences on the shortened clock; some run to the end."""
    t = F.col("t") / 100
    end = F.when(F.col("item_id") % 50 == 0, float("inf")).otherwise(t + F.col("score") / 4)
    return views.points(spark, sf).where(F.col("kind") == kind).select(
        "source_id", F.round(t, 3).alias("start_s"), F.round(end, 3).alias("end_s"))


_SQL_AUDIO = """audio AS (SELECT source_id, CAST(ceil(max(t) / 100) AS DOUBLE) AS duration, count(*) * 700000 AS bytes FROM v_points GROUP BY source_id),
sil AS (SELECT source_id, kind, round(t / 100, 3) AS start_s, CASE WHEN item_id % 50 = 0 THEN 'Infinity'::DOUBLE ELSE round(t / 100 + score / 4, 3) END AS end_s FROM v_points),"""
_SQL_EVEN = _SQL_AUDIO + """
cnt AS (SELECT *, CASE WHEN bytes <= 5000000 OR duration <= 0 THEN 1 ELSE CAST(ceil(bytes / 5000000.0::DOUBLE) AS INT) END AS n FROM audio),
even AS (SELECT source_id, CAST(i AS INT) AS chunk, round(i * (duration / n), 3) AS offset_s,
  round(CASE WHEN i = n - 1 THEN duration - i * (duration / n) ELSE duration / n END, 3) AS duration_s FROM (SELECT *, unnest(range(0, n)) AS i FROM cnt))"""


@query("even_chunks", sql(_SQL_EVEN + " SELECT * FROM even", "v_points"))
def even_chunks(spark, sf):
    return chunks.even_chunks(audio_sources(spark, sf), 5_000_000)


@query("silence_classify", sql(_SQL_EVEN + """,
l AS (SELECT e.*, least(offset_s + duration_s, a.duration) AS l_end FROM even e JOIN audio a USING (source_id)),
q AS (SELECT l.source_id, l.chunk, sum(greatest(0, least(l.l_end, s.end_s) - greatest(l.offset_s, s.start_s))) AS quiet FROM l JOIN sil s
  ON s.source_id = l.source_id AND s.kind = 'view' AND s.start_s < l.l_end AND s.end_s > l.offset_s GROUP BY ALL)
SELECT l.source_id, l.chunk, round(greatest(0, l.l_end - l.offset_s - coalesce(quiet, 0)), 3) AS speech_s,
  greatest(0, l.l_end - l.offset_s - coalesce(quiet, 0)) < 0.5 AS silent FROM l LEFT JOIN q ON q.source_id = l.source_id AND q.chunk = l.chunk""", "v_points"))
def silence_classify(spark, sf):
    sources = audio_sources(spark, sf)
    totals = sources.select("source_id", F.col("duration").alias("total_s"))
    out = chunks.classify_silence(chunks.even_chunks(sources, 5_000_000), silences(spark, sf), totals)
    return out.select("source_id", "chunk", F.round("speech_s", 3).alias("speech_s"), "silent")


_SQL_NEAR = _SQL_AUDIO + """
tgt AS (SELECT source_id, duration, n, duration / n AS ideal, CAST(i AS INT) AS i, duration / n * i AS target, least(15.0::DOUBLE, greatest(2.0::DOUBLE, duration / n * 0.20::DOUBLE)) AS reach
  FROM (SELECT *, unnest(range(1, n)) AS i FROM (SELECT *, greatest(1, CAST(ceil(bytes / 5000000.0::DOUBLE) AS INT)) AS n FROM audio)) WHERE n > 1),
pts AS (SELECT DISTINCT source_id, round((start_s + end_s) / 2, 3) AS point FROM sil WHERE kind = 'view' AND end_s <> 'Infinity'::DOUBLE),
near AS (SELECT t.source_id, t.i, arg_min(p.point, {'d': abs(p.point - t.target), 'p': p.point}) AS point FROM tgt t JOIN pts p
  ON p.source_id = t.source_id AND abs(p.point - t.target) <= t.reach AND p.point > 0 AND p.point < t.duration GROUP BY ALL)"""


@query("nearest_silence", sql(_SQL_NEAR + " SELECT t.source_id, t.i, round(target, 3) AS target, point FROM tgt t LEFT JOIN near n ON n.source_id = t.source_id AND n.i = t.i", "v_points"))
def nearest_silence(spark, sf):
    found = chunks.nearest_silence(chunks.cut_targets(audio_sources(spark, sf), 5_000_000),
                                   chunks.midpoints(silences(spark, sf)))
    return found.select("source_id", "i", F.round("target", 3).alias("target"), "point")


_SQL_PLAN = _SQL_NEAR + """,
loose AS (SELECT DISTINCT source_id, round((start_s + end_s) / 2, 3) AS point FROM sil WHERE kind = 'click' AND end_s <> 'Infinity'::DOUBLE),
hard AS (SELECT DISTINCT t.source_id FROM tgt t LEFT JOIN near n ON n.source_id = t.source_id AND n.i = t.i WHERE n.point IS NULL AND t.source_id IN (SELECT source_id FROM loose)),
pool AS (SELECT * FROM pts UNION SELECT * FROM loose WHERE source_id IN (SELECT source_id FROM hard)),
near2 AS (SELECT t.source_id, t.i, arg_min(p.point, {'d': abs(p.point - t.target), 'p': p.point}) AS point FROM tgt t JOIN pool p
  ON p.source_id = t.source_id AND abs(p.point - t.target) <= t.reach AND p.point > 0 AND p.point < t.duration GROUP BY ALL),
cuts AS (SELECT t.*, coalesce(n.point, t.target) AS pos, n.point IS NULL AS hard, least(1.0::DOUBLE, ideal * 0.10::DOUBLE) AS slack FROM tgt t LEFT JOIN near2 n ON n.source_id = t.source_id AND n.i = t.i),
walk AS (SELECT source_id, 0 AS i, 0.0::DOUBLE AS edge, false AS hard FROM audio
  UNION ALL SELECT c.source_id, c.i, least(greatest(c.pos, w.edge + c.slack), c.duration - (c.n - c.i) * c.slack), c.hard FROM walk w JOIN cuts c ON c.source_id = w.source_id AND c.i = w.i + 1),
plan AS (SELECT w.source_id, w.i AS chunk, round(edge, 3) AS offset_s, round(coalesce(lead(edge) OVER (PARTITION BY w.source_id ORDER BY i), a.duration) - edge, 3) AS duration_s, hard
  FROM walk w JOIN audio a USING (source_id))"""


@query("chunk_plan", sql(_SQL_PLAN + " SELECT source_id, chunk, offset_s, duration_s, hard FROM plan", "v_points"))
def chunk_plan(spark, sf):
    return chunks.chunk_plan(audio_sources(spark, sf), chunks.midpoints(silences(spark, sf)),
                             chunks.midpoints(silences(spark, sf, "click")), 5_000_000)


@query("budget_prefix", sql("""s AS (SELECT *, sum(bytes) OVER (PARTITION BY source_id ORDER BY ord) AS total FROM v_attempts),
b AS (SELECT source_id, min(ord) AS stop FROM s WHERE total > 100 OR (ord > 1 AND total - bytes >= 100) OR ord > 5 GROUP BY source_id)
SELECT s.source_id, s.ord, s.bytes, stop IS NULL OR ord < stop AS allowed FROM s LEFT JOIN b USING (source_id)""", "v_attempts"))
def budget_prefix(spark, sf):
    return chunks.budget_prefix(views.attempts(spark, sf).select("source_id", "ord", "bytes"), 100, 5)


@query("retention", sql("""r AS (SELECT source_id, item_id, t AS created_at, t + 1500000 AS expires_at, CAST(floor(score * 100) AS BIGINT) AS bytes FROM v_points),
a AS (SELECT *, sum(bytes) OVER w AS total, row_number() OVER w - 1 AS idx FROM r WHERE expires_at > 2000000 WINDOW w AS (PARTITION BY source_id ORDER BY created_at DESC, item_id DESC))
SELECT source_id, item_id, CASE WHEN total + 500 > 60000 THEN 'over bytes' WHEN idx >= 30 THEN 'over count' ELSE 'kept' END AS verdict FROM a
UNION ALL SELECT source_id, item_id, 'expired' FROM r WHERE expires_at <= 2000000""", "v_points"))
def retention(spark, sf):
    rows = views.points(spark, sf).select(
        "source_id", "item_id", F.col("t").alias("created_at"), (F.col("t") + 1500000).alias("expires_at"),
        F.floor(F.col("score") * 100).alias("bytes"))
    return chunks.retention(rows, 2000000, 60000, 500, 30).select("source_id", "item_id", "verdict")


@query("receipt_split", sql("""k AS (SELECT *, sha256(CAST(to_json({adapter: adapter, chunk_sha256: sha256(CAST(bytes AS VARCHAR)), duration: bytes, language: 'auto', model: 'm', policy: 'loop1', schema: 1, source_offset: source_id % 50}) AS VARCHAR)) AS key FROM v_attempts),
good AS (SELECT DISTINCT key FROM k WHERE ord % 2 = 1 AND state = 'success' AND bytes > 5)
SELECT source_id, ord, CASE WHEN key IN (SELECT key FROM good) THEN 'reused' ELSE 'todo' END AS status FROM k WHERE ord % 2 = 0""", "v_attempts"))
def receipt_split(spark, sf):
    key = chunks.receipt_key(F.col("adapter"), F.lit("m"), F.lit("auto"), F.sha2(F.col("bytes").cast("string"), 256),
                             F.col("source_id") % 50, F.col("bytes"))
    rows = views.attempts(spark, sf).withColumn("key", key)
    return chunks.split_by_receipts(rows.where("ord % 2 = 0").select("source_id", "ord", "key"),
                                    rows.where("ord % 2 = 1 and state = 'success'"), F.col("bytes") > 5).select(
        "source_id", "ord", "status")


def _coded(spark, sf):
    return views.attempts(spark, sf).withColumn("failure_code", F.when(
        (F.col("state") == "unavailable") & (F.col("bytes") > 45), "remote_cost_limit_exceeded"))


@query("fallback_choice", sql("""c AS (SELECT *, coalesce(state = 'unavailable' AND bytes > 45, false) AS cost FROM v_attempts),
s AS (SELECT source_id, min(ord) FILTER (WHERE state = 'success') AS stop FROM c GROUP BY source_id),
t AS (SELECT c.*, stop FROM c JOIN s USING (source_id) WHERE stop IS NULL OR ord <= stop),
g AS (SELECT source_id, count(*) AS n_attempts, max(stop) AS stop, arg_max(adapter, ord) FILTER (WHERE ord = stop) AS hit, arg_max(adapter, ord) FILTER (WHERE state = 'partial') AS part,
  bool_or(cost) AS cost, count(*) FILTER (WHERE state <> 'success' AND (stop IS NULL OR ord < stop)) AS degraded_by FROM t GROUP BY source_id),
f AS (SELECT *, CASE WHEN stop IS NOT NULL THEN CASE WHEN degraded_by > 0 THEN 'degraded' ELSE 'success' END WHEN part IS NOT NULL THEN 'partial' ELSE 'unavailable' END AS state FROM g)
SELECT source_id, state, CASE WHEN stop IS NOT NULL THEN hit ELSE part END AS adapter, n_attempts, degraded_by,
  CASE WHEN cost AND state IN ('partial', 'unavailable') THEN 'remote_cost_limit_exceeded' WHEN state = 'unavailable' THEN 'transcript_unavailable' END AS failure_code FROM f""", "v_attempts"))
def fallback_choice(spark, sf):
    return chunks.fallback_choice(_coded(spark, sf))


@query("chunk_outcome", sql("""c AS (SELECT source_id, bytes % 7 = 0 AS silent, bytes % 5 = 0 AS cached, state = 'partial' AS looped, state = 'unavailable' AS failed, bytes > 48 AS cost FROM v_attempts),
m AS (SELECT *, NOT silent AND cached AND NOT looped AS reused FROM c),
n AS (SELECT *, NOT silent AND NOT reused AND (failed OR looped) AS lost FROM m),
g AS (SELECT source_id, count(*) FILTER (WHERE silent) AS silent_chunks, count(*) FILTER (WHERE reused) AS reused_chunks, count(*) FILTER (WHERE NOT silent AND NOT reused AND NOT lost) AS processed_chunks,
  count(*) FILTER (WHERE lost) AS failed_chunks, count(*) FILTER (WHERE NOT silent AND looped) AS looped_chunks, bool_or(cost) AS cost, bool_and(silent) AS hush FROM n GROUP BY source_id),
s AS (SELECT *, CASE WHEN hush THEN 'no_speech' WHEN reused_chunks + processed_chunks = 0 THEN 'unavailable' WHEN failed_chunks > 0 THEN 'partial' ELSE 'success' END AS state FROM g)
SELECT source_id, silent_chunks, reused_chunks, processed_chunks, failed_chunks, looped_chunks, state,
  CASE WHEN state IN ('unavailable', 'partial') THEN CASE WHEN cost THEN 'remote_cost_limit_exceeded' WHEN state = 'partial' THEN 'incomplete_chunks' ELSE 'adapter_exhausted' END END AS failure_code FROM s""", "v_attempts"))
def chunk_outcome(spark, sf):
    b, s = F.col("bytes"), F.col("state")
    return chunks.chunk_outcome(views.attempts(spark, sf).select(
        "source_id", (b % 7 == 0).alias("silent"), (b % 5 == 0).alias("cached"), (s == "partial").alias("looped"),
        (s == "unavailable").alias("failed"), (b > 48).alias("cost_limited")))


@query("run_truth", sql("""SELECT source_id, bool_or(adapter = 'a0') AS remote_transmission, bool_or(state = 'unavailable' AND bytes > 45) AS cost_limited,
  count(DISTINCT CASE WHEN state = 'partial' THEN bytes % 4 END) AS looped_chunks FROM v_attempts GROUP BY source_id""", "v_attempts"))
def run_truth(spark, sf):
    return chunks.run_truth(_coded(spark, sf).select(
        "source_id", "failure_code", (F.col("adapter") == "a0").alias("sent"),
        F.when(F.col("state") == "partial", F.col("bytes") % 4).alias("looped_chunk")))


_SQL_STREAM = rf"""said AS (SELECT source_id, seg_idx, {_SENTENCE_SQL} AS s FROM v_segments WHERE NOT regexp_matches(text, '^\s*(?:[\[\(][^\]\)]*[\]\)]|[♪♫\s])+\s*$')),
stream AS (SELECT source_id, seg_idx, unnest(s) AS sentence, generate_subscripts(s, 1) AS part FROM said)"""


@query("loop_run", sql(_SQL_STREAM + """,
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seg_idx, part) AS a, row_number() OVER (PARTITION BY source_id, sentence ORDER BY seg_idx, part) AS b FROM stream)
SELECT source_id, max(n) AS longest_run FROM (SELECT source_id, sentence, count(*) AS n FROM o GROUP BY source_id, sentence, a - b) GROUP BY source_id""", "v_segments"))
def loop_run(spark, sf):
    return chunks.loop_runs(chunks.sentence_stream(views.segments(spark, sf)), one_record=True)


@query("loop_dominance", sql(_SQL_STREAM + """ SELECT source_id, CAST(sum(n) AS BIGINT) AS n_sentences, max(n) AS top FROM (SELECT source_id, sentence, count(*) AS n FROM stream GROUP BY ALL) GROUP BY source_id""", "v_segments"))
def loop_dominance(spark, sf):
    return chunks.loop_dominance(chunks.sentence_stream(views.segments(spark, sf)))


_PERIODS = _SQL_STREAM.replace("v_segments", "v_looped") + """,
lone AS (SELECT source_id, seg_idx, string_split(s[1], ' ') AS w FROM said WHERE len(s) = 1 AND len(string_split(s[1], ' ')) >= 40),
tried AS (SELECT source_id, seg_idx, w, unnest(range(1, least(30, len(w) // 20) + 1)) AS p FROM lone),
flags AS (SELECT source_id, seg_idx, p, len(w) AS n, array_to_string(list_transform(range(1, len(w) // p), lambda i: CASE WHEN w[i * p + 1 : i * p + p] = w[i * p - p + 1 : i * p] THEN '1' ELSE '0' END), '') AS f FROM tried),
found AS (SELECT source_id, seg_idx, CAST(p AS INT) AS period, CAST(list_max(list_transform(string_split(f, '0'), lambda x: len(x))) + 1 AS INT) AS repeats, n FROM flags),
looped AS (SELECT source_id, seg_idx, period, repeats FROM found WHERE repeats >= 20 AND repeats * period > 0.8 * n)"""


@query("loop_period", sql(_PERIODS + " SELECT source_id, seg_idx, period, repeats FROM looped", "v_looped"))
def loop_period(spark, sf):
    return chunks.loop_periods(chunks.sentence_stream(views.looped(spark, sf)))


@query("loop_verdict", sql(_PERIODS + """,
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seg_idx, part) AS a, row_number() OVER (PARTITION BY source_id, sentence ORDER BY seg_idx, part) AS b FROM stream),
r AS (SELECT source_id, max(n) AS run FROM (SELECT source_id, count(*) AS n FROM o GROUP BY source_id, sentence, a - b) GROUP BY source_id),
d AS (SELECT source_id, CAST(sum(n) AS BIGINT) AS n, max(n) AS top FROM (SELECT source_id, sentence, count(*) AS n FROM stream GROUP BY ALL) GROUP BY source_id),
p AS (SELECT source_id, arg_min(period, seg_idx * 100 + period) AS period, arg_min(repeats, seg_idx * 100 + period) AS repeats FROM looped GROUP BY source_id)
SELECT r.source_id, CASE WHEN run >= 20 THEN 'one sentence repeated ' || run || 'x consecutively' WHEN n >= 40 AND top / n > 0.6 THEN 'one sentence is ' || top || '/' || n
  WHEN period IS NOT NULL THEN 'one ' || period || '-word phrase repeated ' || repeats || 'x' END AS verdict FROM r JOIN d USING (source_id) LEFT JOIN p USING (source_id)""", "v_looped"))
def loop_verdict(spark, sf):
    return chunks.loop_verdict(views.looped(spark, sf), one_record=True)


_TRACK = "CASE doc_id % 4 WHEN 0 THEN lang WHEN 1 THEN concat(lang, '-orig') WHEN 2 THEN concat(lang, '-US') ELSE 'zz' END"


@query("preferred_track", f"""WITH t AS (SELECT doc_id % 50 AS source_id, concat('video', doc_id, '.', {_TRACK}, '.vtt') AS name FROM documents),
p AS (SELECT *, CASE WHEN contains(lower(name), '.fr-ca.') OR contains(lower(name), '.fr.') THEN 0 WHEN contains(lower(name), '.fr-ca-orig.') OR contains(lower(name), '.fr-orig.') THEN 1
  WHEN contains(lower(name), '.en.') THEN 2 WHEN contains(lower(name), '.en-orig.') THEN 3 ELSE 4 END AS place FROM t)
SELECT source_id, name, CAST(row_number() OVER (PARTITION BY source_id ORDER BY place, name) AS INT) AS rank FROM p""")
def preferred_track(spark, sf):
    tracks = table(spark, sf, "documents").select(
        (F.col("doc_id") % 50).alias("source_id"),
        F.concat(F.lit("video"), F.col("doc_id").cast("string"), F.lit("."), F.expr(_TRACK), F.lit(".vtt")).alias("name"))
    return chunks.preferred_tracks(tracks, ["fr-CA", "en"])


@query("track_provenance", f"""WITH t AS (SELECT doc_id, {_TRACK} AS code, CASE WHEN doc_id % 3 = 0 THEN 'fr-FR' ELSE lang END AS video, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS l FROM documents),
k AS (SELECT *, CASE WHEN code IN (l, l || '-US') THEN 'manual' WHEN code IN (l || '-orig') THEN 'automatic' ELSE 'unknown' END AS kind,
  regexp_extract(lower(code), '^([^-]*)', 1) AS base, regexp_extract(lower(video), '^([^-]*)', 1) AS spoken FROM t)
SELECT doc_id, code, kind, kind <> 'unknown' AND (ends_with(code, '-orig') OR base = spoken) AS original,
  kind <> 'unknown' AND base <> spoken AND NOT ends_with(code, '-orig') AS translated FROM k""")
def track_provenance(spark, sf):
    listed = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang"))
    rows = table(spark, sf, "documents").select(
        "doc_id", F.expr(_TRACK).alias("code"), F.when(F.col("doc_id") % 3 == 0, "fr-FR").otherwise(F.col("lang")).alias("video"),
        F.array(listed, F.concat(listed, F.lit("-US"))).alias("manual"), F.array(F.concat(listed, F.lit("-orig"))).alias("automatic"))
    return rows.withColumn("p", chunks.track_provenance(F.col("code"), F.col("manual"), F.col("automatic"), F.col("video"))).select(
        "doc_id", "code", "p.kind", "p.original", "p.translated")


@query("sidecar_match", """WITH f AS (SELECT doc_id, concat('clips/D', doc_id, CASE WHEN doc_id % 2 = 0 THEN '.VTT' ELSE '.srt' END) AS path FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, concat('clips/d', doc_id, '.srt') FROM documents WHERE doc_id % 6 = 0)
SELECT d.doc_id AS media_id, arg_min(f.path, CASE WHEN ends_with(lower(f.path), 'vtt') THEN '0' ELSE '1' END || f.path) AS path FROM documents d JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def sidecar_match(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    name = F.col("doc_id").cast("string")
    media = docs.select(F.col("doc_id").alias("media_id"), F.concat(F.lit("clips/d"), name, F.lit(".mp4")).alias("path"))
    files = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("clips/D"), name, F.when(
        F.col("doc_id") % 2 == 0, ".VTT").otherwise(".srt")).alias("path")).unionByName(
        docs.where("doc_id % 6 = 0").select(F.concat(F.lit("clips/d"), name, F.lit(".srt")).alias("path")))
    return chunks.sidecars(media, files)
