"""Chunks: planning, silence, budgets, receipts, fallback, repetition loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timesift.functions import fixed, identity, text
from timesift.operators.keyed import BLOCK_ROWS, ordered_fold, row_index, running_totals, with_previous

KEY = ["source_id"]


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of ``(l_start, l_end)`` and ``(r_start, r_end)`` that touch, each once.

    Intervals are spread over time buckets, so the join is by key and bucket, and a pair is taken
    in the first bucket both share.
    """
    a = left.withColumn("__b", F.explode(_buckets(F.col("l_start"), F.col("l_end"), width)))
    b = right.withColumn("__b", F.explode(_buckets(F.col("r_start"), F.col("r_end"), width)))
    first = F.greatest(F.floor(F.col("l_start") / width), F.floor(F.col("r_start") / width))
    touch = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    return a.join(b, [*keys, "__b"]).where(touch & (F.col("__b") == first)).drop("__b")


def classify_silence(chunks: DataFrame, silences: DataFrame, totals: DataFrame, width: float = 600.0) -> DataFrame:
    """Adds ``speech_s`` and ``silent`` to ``(source_id, chunk, offset_s, duration_s)``.

    ``totals`` gives ``total_s`` per source; a source without silence rows has no silent chunk
    unless it is shorter than the speech limit itself.
    """
    placed = chunks.join(totals, "source_id").withColumn("l_start", F.col("offset_s")).withColumn(
        "l_end", F.least(F.col("offset_s") + F.col("duration_s"), F.col("total_s")))
    quiet = silences.select("source_id", F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"))
    # An open end reaches as far as the source does.
    quiet = quiet.join(totals, "source_id").withColumn("r_end", F.least("r_end", "total_s")).drop("total_s").where("r_end > r_start")
    cut = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    hushed = overlapping(placed.select("source_id", "chunk", "l_start", "l_end"), quiet, KEY, width).groupBy(
        "source_id", "chunk").agg(F.sum(F.greatest(cut, F.lit(0.0))).alias("quiet_s"))
    speech = F.greatest(F.lit(0.0), F.col("l_end") - F.col("l_start") - F.coalesce("quiet_s", F.lit(0.0)))
    return placed.join(hushed, ["source_id", "chunk"], "left").select(
        "source_id", "chunk", "offset_s", "duration_s", speech.alias("speech_s"),
        (speech < fixed.MIN_SPEECH_SECONDS).alias("silent"))


def midpoints(silences: DataFrame) -> DataFrame:
    """(source_id, point): middles of finite silences, as places to cut."""
    middle = F.round((F.col("start_s") + F.col("end_s")) / 2, 3)
    return silences.where(F.col("end_s") != float("inf")).select("source_id", middle.alias("point")).where("point > 0").distinct()


def even_chunks(sources: DataFrame, max_bytes: int) -> DataFrame:
    """(source_id, chunk, offset_s, duration_s) of equal parts; the last takes the remainder."""
    n = F.when((F.col("bytes") <= max_bytes) | (F.col("duration") <= 0), 1).otherwise(F.ceil(F.col("bytes") / max_bytes))
    parts = sources.withColumn("n", n.cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    part = F.col("duration") / F.col("n")
    offset = F.col("chunk") * part
    return parts.select("source_id", "chunk", F.round(offset, 3).alias("offset_s"), F.round(
        F.when(F.col("chunk") == F.col("n") - 1, F.col("duration") - offset).otherwise(part), 3).alias("duration_s"))


def cut_targets(sources: DataFrame, max_bytes: int) -> DataFrame:
    """(source_id, duration, n, ideal, i, target, reach) for each inner cut."""
    n = F.greatest(F.lit(1), F.ceil(F.col("bytes") / max_bytes)).cast("int")
    ideal = F.col("duration") / F.col("n")
    return sources.withColumn("n", n).where("n > 1").withColumn("ideal", ideal).withColumn(
        "i", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select(
        "source_id", "duration", "n", "ideal", "i", (F.col("ideal") * F.col("i")).alias("target"),
        F.least(F.lit(15.0), F.greatest(F.lit(2.0), F.col("ideal") * 0.20)).alias("reach"))


def nearest_silence(targets: DataFrame, points: DataFrame) -> DataFrame:
    """Adds ``point``: the nearest silence within reach (15 s at most), null where the cut is hard."""
    width = 15.0
    near = points.withColumn("__b", F.explode(F.array(*[F.floor(F.col("point") / width) + d for d in (-1, 0, 1)])))
    gap = F.abs(F.col("point") - F.col("target"))
    found = targets.withColumn("__b", F.floor(F.col("target") / width)).join(near, ["source_id", "__b"]).where(
        (gap <= F.col("reach")) & (F.col("point") > 0) & (F.col("point") < F.col("duration"))).groupBy("source_id", "i").agg(
        F.min_by("point", F.struct(gap, "point")).alias("point"))
    return targets.join(found, ["source_id", "i"], "left")


def chunk_plan(sources: DataFrame, tight: DataFrame, loose: DataFrame | None, max_bytes: int) -> DataFrame:
    """(source_id, chunk, offset_s, duration_s, hard): contiguous chunks cut at silences where one is near.

    Sources with a hard cut are planned again with the loose silences added. Each cut depends on the one
    before, so they pass through an ordered fold.
    """
    targets = cut_targets(sources, max_bytes)
    first = nearest_silence(targets, tight)
    if loose is not None:
        hard = first.where("point is null").select("source_id").distinct().join(
            loose.select("source_id").distinct(), "source_id", "left_semi")
        again = nearest_silence(targets.join(hard, "source_id", "left_semi"), tight.unionByName(loose).distinct())
        first = first.join(hard, "source_id", "left_anti").unionByName(again)
    slack = F.least(F.lit(1.0), F.col("ideal") * 0.10)
    cuts = first.select(
        "source_id", (F.col("i") - 1).alias("at"), F.coalesce("point", "target").alias("wish"), F.col("point").isNull().alias("hard"),
        slack.alias("slack"), (F.col("duration") - (F.col("n") - F.col("i")) * slack).alias("high"), "duration")

    def place(last, wish: float, slack: float, high: float):
        edge = min(max(float(wish), (last or 0.0) + slack), float(high))
        return (edge,), edge

    placed = ordered_fold(cuts, KEY, "at", ["wish", "slack", "high"], place, "edge double").select(
        "source_id", (F.col("at") + 1).alias("chunk"), "edge", "hard", "duration")
    opening = placed.where("chunk = 1").select("source_id", F.lit(0).alias("chunk"), F.lit(0.0).alias("edge"), F.lit(False).alias("hard"), "duration")
    edges = with_previous(opening.unionByName(placed), KEY, "chunk", {"__next": "edge"}, ahead=True)
    many = edges.select("source_id", "chunk", F.round("edge", 3).alias("offset_s"),
                        F.round(F.coalesce("__next", "duration") - F.col("edge"), 3).alias("duration_s"), "hard")
    one = sources.where(F.ceil(F.col("bytes") / max_bytes) <= 1).select(
        "source_id", F.lit(0).alias("chunk"), F.lit(0.0).alias("offset_s"), F.round("duration", 3).alias("duration_s"),
        F.lit(False).alias("hard"))
    return many.unionByName(one)


def budget_prefix(sends: DataFrame, max_bytes: int, max_attempts: int) -> DataFrame:
    """Adds ``allowed``: sends in order until one would pass a bound; landing on a bound is allowed and
    closes the budget. A bound of 0 is off. ``sends`` is ``(source_id, ord from 1, bytes)``."""
    summed = running_totals(sends.withColumn("__i", F.col("ord") - 1), KEY, "__i", {"__sum": F.col("bytes")})
    # Sizes are not negative, so each test stays true once it is.
    bad = F.lit(False)
    if max_bytes:
        bad = bad | (F.col("__sum") > max_bytes) | ((F.col("ord") > 1) & (F.col("__sum") - F.col("bytes") >= max_bytes))
    if max_attempts:
        bad = bad | (F.col("ord") > max_attempts)
    return summed.withColumn("allowed", ~bad).drop("__i", "__sum")


def retention(receipts: DataFrame, now: float, max_bytes: int, reserve: int = 0,
              newest: int = fixed.MAX_RECEIPTS) -> DataFrame:
    """Adds ``verdict``: expired, over the byte bound, beyond the newest ``newest``, or kept.

    ``receipts`` is ``(source_id, item_id, created_at, expires_at, bytes)``; the oldest go first.
    """
    alive = receipts.where(F.col("expires_at") > now)
    placed = row_index(alive, KEY, [F.desc("created_at"), F.desc("item_id")], -F.floor(F.col("created_at") / 3600))
    summed = running_totals(placed, KEY, "idx", {"__sum": F.col("bytes")})
    verdict = F.when(F.col("__sum") + reserve > max_bytes, "over bytes").when(
        F.col("idx") >= newest, "over count").otherwise("kept")
    gone = receipts.where(F.col("expires_at") <= now).withColumn("verdict", F.lit("expired"))
    return summed.withColumn("verdict", verdict).select(*receipts.columns, "verdict").unionByName(gone)


def receipt_key(adapter: Column, model: Column, language: Column, chunk_sha: Column, offset: Column,
                duration: Column, policy: str = "loop1", schema: int = 1) -> Column:
    return identity.canonical_sha(
        schema=F.lit(schema), adapter=adapter, model=model, language=language, policy=F.lit(policy),
        chunk_sha256=chunk_sha, source_offset=offset, duration=duration)


def split_by_receipts(work: DataFrame, receipts: DataFrame, valid: Column) -> DataFrame:
    """Adds ``status``: ``reused`` where a valid receipt with the same ``key`` exists, else ``todo``."""
    good = receipts.where(valid).select("key").distinct().withColumn("__r", F.lit("reused"))
    return work.join(good, "key", "left").withColumn("status", F.coalesce("__r", F.lit("todo"))).drop("__r")


def fallback_choice(attempts: DataFrame, require_complete: bool = True) -> DataFrame:
    """(source_id, state, adapter, n_attempts, degraded_by, failure_code): the outcome of trying in order.

    Success or degraded ends the walk, as do fatal and no_speech; a partial result ends it only when
    completeness is not required, else the latest one is the last resort.
    """
    ends = ["success", "degraded", "fatal", "no_speech"] + ([] if require_complete else ["partial"])
    stop = attempts.where(F.col("state").isin(ends)).groupBy("source_id").agg(F.min("ord").alias("stop"))
    tried = attempts.join(stop, "source_id", "left").where(F.col("stop").isNull() | (F.col("ord") <= F.col("stop")))
    cost = F.coalesce(F.col("failure_code") == "remote_cost_limit_exceeded", F.lit(False))
    out = tried.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.max("stop").alias("stop"),
        F.max_by(F.struct("state", "adapter"), F.when(F.col("ord") == F.col("stop"), F.col("ord"))).alias("hit"),
        F.max_by(F.struct("state", "adapter"), F.when(F.col("state") == "partial", F.col("ord"))).alias("part"),
        F.bool_or(cost).alias("cost"),
        F.count_if((F.col("state") != "success") & ((F.col("ord") < F.col("stop")) | F.col("stop").isNull())).alias("degraded_by"))
    won = F.col("stop").isNotNull()
    state = (F.when(won & F.col("hit.state").isin("success", "degraded"),
                    F.when(F.col("degraded_by") > 0, "degraded").otherwise(F.col("hit.state")))
             .when(won, F.col("hit.state")).when(F.col("part").isNotNull(), "partial").otherwise("unavailable"))
    return out.withColumn("state", state).select(
        "source_id", "state", F.when(won, F.col("hit.adapter")).otherwise(F.col("part.adapter")).alias("adapter"),
        "n_attempts", "degraded_by",
        F.when(F.col("cost") & F.col("state").isin("partial", "unavailable"), "remote_cost_limit_exceeded")
        .when(F.col("state") == "unavailable", "transcript_unavailable").alias("failure_code"))


def chunk_outcome(results: DataFrame) -> DataFrame:
    """Per source, from ``(silent, cached, looped, failed, cost_limited)`` chunk rows: counts, state, code."""
    heard = ~F.col("silent")
    reused = heard & F.col("cached") & ~F.col("looped")
    lost = heard & ~reused & (F.col("failed") | F.col("looped"))
    out = results.groupBy("source_id").agg(
        F.count_if(F.col("silent")).alias("silent_chunks"), F.count_if(reused).alias("reused_chunks"),
        F.count_if(heard & ~reused & ~lost).alias("processed_chunks"), F.count_if(lost).alias("failed_chunks"),
        F.count_if(heard & F.col("looped")).alias("looped_chunks"), F.bool_or(F.col("cost_limited")).alias("cost"),
        (F.bool_and("silent") & (F.count(F.lit(1)) > 0)).alias("all_silent"))
    state = (F.when(F.col("all_silent"), "no_speech").when(F.col("reused_chunks") + F.col("processed_chunks") == 0, "unavailable")
             .when(F.col("failed_chunks") > 0, "partial").otherwise("success"))
    code = F.when(state.isin("unavailable", "partial"), F.when(F.col("cost"), "remote_cost_limit_exceeded").when(
        state == "partial", "incomplete_chunks").otherwise("adapter_exhausted"))
    return out.withColumn("failure_code", code).withColumn("state", state).drop("cost", "all_silent")


def run_truth(attempts: DataFrame) -> DataFrame:
    """Facts of a whole run: distinct looped chunks, whether anything was sent, the cost code."""
    cost = F.coalesce(F.col("failure_code") == "remote_cost_limit_exceeded", F.lit(False))
    looped = attempts.where("looped_chunk is not null").select("source_id", "looped_chunk").distinct().groupBy(
        "source_id").agg(F.count(F.lit(1)).alias("looped_chunks"))
    return attempts.groupBy("source_id").agg(
        F.bool_or("sent").alias("remote_transmission"), F.bool_or(cost).alias("cost_limited")).join(
        looped, "source_id", "left").withColumn("looped_chunks", F.coalesce("looped_chunks", F.lit(0).cast("long")))


def sentence_stream(segments: DataFrame) -> DataFrame:
    """(source_id, seg_idx, part, sentence, parts): the normalized sentences in order."""
    said = segments.select("source_id", "seg_idx", text.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return said.select("source_id", "seg_idx", F.size("s").alias("parts"), F.posexplode("s").alias("part", "sentence"))


def loop_runs(stream: DataFrame, one_record: bool = False) -> DataFrame:
    """(source_id, longest_run) of one sentence in a row."""
    coarse = None if one_record else F.floor(F.col("seg_idx") / 65536)
    block = None if one_record else BLOCK_ROWS
    placed = row_index(stream, KEY, [F.col("seg_idx"), F.col("part")], coarse)
    seen = with_previous(placed, KEY, "idx", {"__before": "sentence"}, block)
    fresh = F.when(F.coalesce(F.col("__before") == F.col("sentence"), F.lit(False)), 0).otherwise(1)
    marked = running_totals(seen, KEY, "idx", {"__run": fresh}, block_rows=block)
    return marked.groupBy("source_id", "__run").agg(F.count(F.lit(1)).alias("n")).groupBy("source_id").agg(
        F.max("n").alias("longest_run"))


def loop_dominance(stream: DataFrame) -> DataFrame:
    """(source_id, n_sentences, top): how often the most frequent sentence occurs."""
    return stream.groupBy("source_id", "sentence").agg(F.count(F.lit(1)).alias("n")).groupBy("source_id").agg(
        F.sum("n").alias("n_sentences"), F.max("n").alias("top"))


def loop_periods(stream: DataFrame) -> DataFrame:
    """(source_id, seg_idx, period, repeats): a phrase repeated back to back through most of a segment."""
    words = F.split("sentence", " ")
    long = stream.where("parts = 1").select("source_id", "seg_idx", words.alias("w")).where(
        F.size("w") >= 2 * fixed.LOOP_INTRA_MIN_REPEATS)
    tried = long.withColumn("period", F.explode(F.sequence(F.lit(1), F.least(
        F.lit(fixed.LOOP_MAX_PERIOD), F.floor(F.size("w") / fixed.LOOP_INTRA_MIN_REPEATS).cast("int")))))
    p = F.col("period")
    same = F.transform(F.sequence(F.lit(1), F.floor(F.size("w") / p).cast("int") - 1), lambda i: F.when(
        F.slice("w", i * p + 1, p) == F.slice("w", (i - 1) * p + 1, p), "1").otherwise("0"))
    runs = F.array_max(F.transform(F.split(F.array_join(same, ""), "0"), F.length))
    return tried.withColumn("repeats", runs + 1).where(
        (F.col("repeats") >= fixed.LOOP_INTRA_MIN_REPEATS) & (F.col("repeats") * p > 0.8 * F.size("w"))).select(
        "source_id", "seg_idx", "period", "repeats")


def loop_verdict(segments: DataFrame, one_record: bool = False) -> DataFrame:
    """(source_id, verdict): the first rule that shows a decoding loop, null for none."""
    stream = sentence_stream(segments)
    if one_record:
        return _record_loops(stream).select("source_id", _loop_rule().alias("verdict"))
    runs, share = loop_runs(stream, one_record), loop_dominance(stream)
    spans = loop_periods(stream).groupBy("source_id").agg(F.min(F.struct("seg_idx", "period", "repeats")).alias("p"))
    return runs.join(share, "source_id").join(spans, "source_id", "left").select("source_id", _loop_rule().alias("verdict"))


def _loop_rule() -> Column:
    ratio = F.col("top") / F.col("n_sentences")
    return F.coalesce(
        F.when(F.col("longest_run") >= fixed.LOOP_MIN_CONSECUTIVE, F.concat(
            F.lit("one sentence repeated "), F.col("longest_run").cast("string"), F.lit("x consecutively"))),
        F.when((F.col("n_sentences") >= fixed.LOOP_DOMINANCE_MIN) & (ratio > fixed.LOOP_DOMINANCE_RATIO), F.concat(
            F.lit("one sentence is "), F.col("top").cast("string"), F.lit("/"), F.col("n_sentences").cast("string"))),
        F.when(F.col("p").isNotNull(), F.concat(
            F.lit("one "), F.col("p.period").cast("string"), F.lit("-word phrase repeated "), F.col("p.repeats").cast("string"), F.lit("x"))))


def _record_loops(stream: DataFrame) -> DataFrame:
    """(source_id, longest_run, n_sentences, top, p) in one reading of the stream: what a source needs is grouped where it lies."""
    order = Window.partitionBy("source_id").orderBy("seg_idx", "part")
    same = F.coalesce(F.lag("sentence").over(order) == F.col("sentence"), F.lit(False))
    lone = F.when((F.col("parts") == 1) & (F.size(F.split("sentence", " ")) >= 2 * fixed.LOOP_INTRA_MIN_REPEATS), F.array_min(_phrases()))
    marked = stream.withColumns({"__fresh": F.when(same, 0).otherwise(1), "__p": lone}).withColumn(
        "__run", F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("source_id", "__run").agg(
        F.first("sentence").alias("sentence"), F.count(F.lit(1)).alias("n"), F.min("__p").alias("p"))
    said = runs.groupBy("source_id", "sentence").agg(F.sum("n").alias("all"), F.max("n").alias("longest"), F.min("p").alias("p"))
    return said.groupBy("source_id").agg(
        F.max("longest").alias("longest_run"), F.sum("all").alias("n_sentences"), F.max("all").alias("top"), F.min("p").alias("p"))


def _phrases() -> Column:
    """(seg_idx, period, repeats) of the phrases that ``loop_periods`` finds in the one sentence of a segment.

    The words are bound to a variable of a lambda, so that they are cut once a sentence and not once a comparison.
    """
    def of(w: Column) -> Column:
        def tried(p: Column) -> Column:
            same = F.transform(F.sequence(F.lit(1), F.floor(F.size(w) / p).cast("int") - 1), lambda i: F.when(
                F.slice(w, i * p + 1, p) == F.slice(w, (i - 1) * p + 1, p), "1").otherwise("0"))
            runs = F.array_max(F.transform(F.split(F.array_join(same, ""), "0"), F.length))
            return F.struct(F.col("seg_idx"), p.alias("period"), (runs + 1).alias("repeats"))

        periods = F.sequence(F.lit(1), F.least(F.lit(fixed.LOOP_MAX_PERIOD), F.floor(F.size(w) / fixed.LOOP_INTRA_MIN_REPEATS).cast("int")))
        return F.filter(F.transform(periods, tried), lambda x: (x["repeats"] >= fixed.LOOP_INTRA_MIN_REPEATS) & (
            x["repeats"] * x["period"] > 0.8 * F.size(w)))

    return F.flatten(F.transform(F.array(F.split("sentence", " ")), of))


def preferred_tracks(tracks: DataFrame, languages: list[str]) -> DataFrame:
    """Adds ``rank``: per language the exact track, then its original; the rest last; ties by name."""
    low, place = F.lower("name"), F.lit(2 * len(languages))
    for i, language in reversed(list(enumerate(languages))):
        tags = {language.lower(), language.split("-", 1)[0].lower()}
        exact = orig = F.lit(False)
        for tag in sorted(tags):
            exact = exact | low.contains(f".{tag}.")
            orig = orig | low.contains(f".{tag}-orig.")
        place = F.when(exact, 2 * i).when(orig, 2 * i + 1).otherwise(place)
    placed = row_index(tracks.withColumn("__p", place), KEY, [F.col("__p"), F.col("name")],
                       F.struct(F.col("__p"), F.substring("name", 1, 7)), "rank")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int")).drop("__p")


def track_provenance(code: Column, manual: Column, automatic: Column, video_language: Column) -> Column:
    """STRUCT<kind, original, translated>, from the metadata lists and never from a file name alone."""
    base = F.lower(F.regexp_extract(code, "^([^-]*)", 1))
    spoken = F.lower(F.regexp_extract(F.coalesce(video_language, F.lit("")), "^([^-]*)", 1))
    kind = F.when(F.array_contains(manual, code), "manual").when(
        F.array_contains(automatic, code), "automatic").otherwise("unknown")
    orig = F.endswith(F.lower(code), F.lit("-orig"))
    known = kind != "unknown"
    return F.struct(kind.alias("kind"), (known & (orig | ((spoken != "") & (base == spoken)))).alias("original"),
                    (known & (spoken != "") & (base != spoken) & ~orig).alias("translated"))


def sidecars(media: DataFrame, files: DataFrame) -> DataFrame:
    """(media_id, path): the subtitle file of the same stem in the same folder, vtt before srt."""
    def stem(c: str) -> Column:
        return F.lower(F.regexp_replace(c, r"\.[^./]*$", ""))
    subs = files.withColumn("__k", stem("path")).withColumn("__x", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))).where(
        F.col("__x").isin("vtt", "srt")).select("__k", "__x", F.col("path").alias("sub_path"))
    return media.withColumn("__k", stem("path")).join(subs, "__k").groupBy("media_id").agg(
        F.min_by("sub_path", F.struct(F.col("__x") != "vtt", "sub_path")).alias("path"))
