"""Timed segments: cleaning, chapters, spans, ranges.

Segments are ``(source_id, seg_idx, start_s, end_s, text)`` with ``seg_idx`` dense from 0.
``one_record`` marks segments cut out of one input record per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timesift.functions import fixed, timecode
from timesift.operators.keyed import (
    BLOCK_ROWS, ordered_fold, row_index, running_totals, with_previous)
from timesift.session import cut_lineage, spread

KEY = ["source_id"]
MIN_OVERLAP = 8
SPAN_BUCKET = fixed.SPAN_SECONDS + 1.0


def filter_range(segments: DataFrame, start: float | None, end: float | None) -> DataFrame:
    """Segments that touch [start, end]; an open bound is not checked."""
    if start is not None:
        segments = segments.where(F.col("end_s") >= start)
    if end is not None:
        segments = segments.where(F.col("start_s") <= end)
    return segments


def segment_rules() -> Column:
    """Names of the rules a segment row breaks."""
    return F.array_compact(F.array(
        F.when((F.col("start_s") < 0) | (F.col("end_s") < F.col("start_s")), "timestamps"),
        F.when(F.trim("text") == "", "empty text"),
        F.when(~F.col("confidence").between(0, 1), "confidence")))


def shift(segments: DataFrame, offset: Column, digits: int = 2) -> DataFrame:
    """Move segments and their words together."""
    words = F.transform("words", lambda w: F.struct(
        w["word"].alias("word"), F.round(w["start"] + offset, digits).alias("start"),
        F.round(w["end"] + offset, digits).alias("end")))
    return segments.withColumns({
        "start_s": F.round(F.col("start_s") + offset, digits),
        "end_s": F.round(F.col("end_s") + offset, digits), "words": words})


def clean_words(raw: Column, offset: Column | None = None) -> Column:
    """Words with text and times that make sense, before and after the shift; others are dropped."""
    offset = F.lit(0.0) if offset is None else offset

    def usable(w: Column) -> Column:
        ok = (w["start"] >= 0) & (w["end"] >= w["start"]) & (F.trim(w["word"]) != "")
        return F.coalesce(ok, F.lit(False))

    def timed(w: Column, by: Column) -> Column:
        return F.struct(w["word"].alias("word"),
                        F.round(w["start"].try_cast("double") + by, 3).alias("start"),
                        F.round(w["end"].try_cast("double") + by, 3).alias("end"))

    first = F.filter(F.transform(raw, lambda w: timed(w, F.lit(0.0))), usable)
    return F.filter(F.transform(first, lambda w: timed(w, offset)), usable)


def collapse_repeats(segments: DataFrame) -> DataFrame:
    """Join a cue to the one before when its text repeats or extends it."""
    seen = with_previous(segments, KEY, "seg_idx", {"__before": "text"})
    fresh = F.when(F.col("__before").isNull()
                   | ((F.col("text") != F.col("__before"))
                      & ~F.startswith(F.col("text"), F.concat("__before", F.lit(" ")))), 1).otherwise(0)
    marked = running_totals(seen, KEY, "seg_idx", {"__island": fresh})
    return marked.groupBy("source_id", "__island").agg(
        F.min("seg_idx").alias("seg_idx"), F.min_by("start_s", "seg_idx").alias("start_s"),
        F.max_by("end_s", "seg_idx").alias("end_s"), F.max_by("text", "seg_idx").alias("text"),
    ).drop("__island")


def _fresh(text: str, kept: str) -> str:
    """What a caption adds to the kept one: nothing when it lies inside it or its first half ends it, else all
    behind its longest word-aligned opening that ends it."""
    half = text[:len(text) // 2]
    if text in kept or half and kept.endswith(half):
        return ""
    bounds = [i for i, c in enumerate(text) if c == " " and i >= MIN_OVERLAP]
    repeated = [i for i in bounds if kept.endswith(text[:i])]
    return text[repeated[-1]:].lstrip() if repeated else text


def rolling_step(state, at: int, text: str):
    """Pass for rolling captions; the state is the last kept text and its position."""
    fresh = text if state is None else _fresh(text, state[0])
    if not fresh and state is not None:
        return (state[1], None), state
    return (int(at), fresh), [fresh, int(at)]


def collapse_rolling(segments: DataFrame, one_record: bool = False) -> DataFrame:
    """Drop cues contained in the last kept one and strip repeated openings."""
    slim = segments.select("source_id", "seg_idx", "start_s", "end_s", "text")
    marked = ordered_fold(slim, KEY, "seg_idx", ["seg_idx", "text"], rolling_step,
                          "keeper int, kept_text string", one_record_per_key=one_record)
    # Dealt by source once, a record is grouped by cue and then as a whole without another shuffle.
    marked = spread(marked) if one_record else marked
    timed = marked.withColumnRenamed("seg_idx", "__at")
    return timed.groupBy("source_id", F.col("keeper").alias("seg_idx")).agg(
        F.min_by("start_s", "__at").alias("start_s"), F.max("end_s").alias("end_s"),
        F.max("kept_text").alias("text"))


def renumber(segments: DataFrame) -> DataFrame:
    """Dense positions again after rows were dropped."""
    placed = row_index(segments.withColumnRenamed("seg_idx", "__old"), KEY, [F.col("__old")],
                       F.floor(F.col("__old") / 65536), "seg_idx")
    return placed.withColumn("seg_idx", F.col("seg_idx").cast("int")).select(
        "source_id", "seg_idx", "start_s", "end_s", "text")


def durations(segments: DataFrame) -> DataFrame:
    return segments.groupBy("source_id").agg(F.max_by("end_s", "seg_idx").alias("duration"))


def pause_chapters(segments: DataFrame, known: DataFrame | None = None,
                   one_record: bool = False) -> DataFrame:
    """Chapters at pauses over two seconds, else blocks of two minutes.

    ``known`` may give ``(source_id, duration)``; the end of the last segment stands in.
    """
    block = None if one_record else BLOCK_ROWS
    seen = with_previous(segments.select("source_id", "seg_idx", "start_s", "end_s"), KEY, "seg_idx",
                         {"__before": "end_s"}, block)
    pause = (F.col("start_s") - F.col("__before")) > fixed.PAUSE_GAP_SECONDS
    total = durations(segments)
    if known is not None:
        total = total.join(known.withColumnRenamed("duration", "__known"), "source_id", "left").select(
            "source_id", F.coalesce("__known", "duration").alias("duration"))
    cuts = running_totals(seen, KEY, "seg_idx", {"chapter_id": F.when(pause, 1).otherwise(0)},
                          block_rows=block).where(pause).select("source_id", F.col("chapter_id").cast("int").alias("chapter_id"), "start_s")
    opening = total.select("source_id", F.lit(0).alias("chapter_id"), F.lit(0.0).alias("start_s"))
    last_second = F.greatest(F.lit(1), F.floor("duration").cast("int")) - 1
    blocks = (
        total.join(cuts.select("source_id").distinct(), "source_id", "left_anti")
        .select("source_id", F.posexplode(F.sequence(F.lit(0), last_second, F.lit(fixed.BLOCK_SECONDS)))
                .alias("chapter_id", "start_s"))
        .where("chapter_id > 0").withColumn("start_s", F.col("start_s").cast("double")))
    bounds = opening.unionByName(cuts).unionByName(blocks)
    ended = with_previous(bounds, KEY, "chapter_id", {"__next": "start_s"}, block, ahead=True)
    end = F.coalesce("__next", F.greatest(F.col("duration"), F.col("start_s") + 1.0))
    return ended.join(total, "source_id").select(
        "source_id", "chapter_id",
        F.concat(F.lit("Segment "), (F.col("chapter_id") + 1).cast("string"), F.lit(" ("),
                 timecode.minutes_stamp(F.col("start_s")), F.lit("-"), timecode.minutes_stamp(end), F.lit(")")).alias("title"),
        "start_s", end.alias("end_s"))


def usable_chapters(listed: str) -> Column:
    """(chapter_id, title, start_s, end_s) of the listed entries that have both times; the position among them is the id."""
    usable = F.filter(listed, lambda c: c["start_time"].try_cast("double").isNotNull() & c["end_time"].try_cast("double").isNotNull())
    return F.transform(usable, lambda c, i: F.struct(
        i.alias("chapter_id"),
        F.when(F.coalesce(c["title"], F.lit("")) != "", c["title"]).otherwise(
            F.concat(F.lit("Chapter "), (i + 1).cast("string"))).alias("title"),
        c["start_time"].try_cast("double").alias("start_s"), c["end_time"].try_cast("double").alias("end_s")))


def chapters_from_metadata(listed: DataFrame, segments: DataFrame) -> DataFrame:
    """Chapters of the metadata where at least one is usable, pause chapters elsewhere.

    ``listed`` is ``(source_id, duration, chapters ARRAY<STRUCT<start_time, end_time, title>>)``;
    the list is one record, unusable entries are skipped, the position is the id.
    """
    given = listed.select("source_id", F.inline(usable_chapters("chapters")))
    rest = segments.join(given.select("source_id").distinct(), "source_id", "left_anti")
    known = listed.where("duration > 0").select("source_id", F.col("duration").cast("double").alias("duration"))
    return given.unionByName(pause_chapters(rest, known))


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                  value: str, width: float = 600.0) -> DataFrame:
    """As-of join: adds to each left row the ``value`` of the last right row at or before it.

    Both sides meet in time buckets; one row per bucket carries the latest value forward.
    """
    mark = F.struct(F.col(right_time).alias("t"), F.col(value).alias("v"))
    payload = F.struct(*[F.col(c) for c in left.columns])
    both = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), payload.alias("__row")).unionByName(
        right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), mark.alias("__mark")),
        allowMissingColumns=True).withColumn("__bucket", F.floor(F.col("__t") / width))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "__bucket").agg(F.max("__mark").alias("__m")).select(
        *keys, "__bucket", F.max("__m").over(earlier).alias("__carry"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__t", "__side").rowsBetween(
        Window.unboundedPreceding, 0)
    found = both.join(carried, [*keys, "__bucket"]).withColumn("__own", F.max("__mark").over(inside))
    return found.where("__side = 1").select(
        "__row.*", F.coalesce(F.col("__own.v"), F.col("__carry.v")).alias(value))


def pause_marks(segments: DataFrame, one_record: bool = False) -> DataFrame:
    """Adds ``chapter_id`` for sources without metadata chapters, with no join to chapters:
    the number of pauses so far, or the two-minute block where a source has no pause."""
    block = None if one_record else BLOCK_ROWS
    seen = with_previous(segments, KEY, "seg_idx", {"__before": "end_s"}, block)
    pause = (F.col("start_s") - F.col("__before")) > fixed.PAUSE_GAP_SECONDS
    counted = running_totals(seen, KEY, "seg_idx", {"__pauses": F.when(pause, 1).otherwise(0)},
                             block_rows=block)
    if one_record:
        whole = Window.partitionBy(*KEY)
        counted = counted.withColumns({"__all": F.max("__pauses").over(whole),
                                       "duration": F.max_by("end_s", "seg_idx").over(whole)})
    else:
        counted = counted.join(counted.groupBy(*KEY).agg(
            F.max("__pauses").alias("__all"), F.max_by("end_s", "seg_idx").alias("duration")), KEY)
    top = F.floor((F.greatest(F.lit(1), F.floor("duration")) - 1) / fixed.BLOCK_SECONDS)
    fixed_block = F.least(F.floor(F.col("start_s") / fixed.BLOCK_SECONDS), top)
    return counted.withColumn("chapter_id", F.when(F.col("__all") > 0, F.col("__pauses")).otherwise(
        fixed_block).cast("int")).drop("__before", "__pauses", "__all")


def attach_chapters(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Adds ``chapter_id``: the last chapter that has started, the first one before any has."""
    placed = latest_before(segments, chapters, KEY, "start_s", "start_s", "chapter_id")
    return placed.withColumn("chapter_id", F.coalesce("chapter_id", F.lit(0)))


def _span_pointers(segments: DataFrame) -> DataFrame:
    """(source_id, seg_idx, reached, to): segments that may open a span, and the one that opens the span behind theirs.

    Only a segment that starts later than all before it in its chapter may open a span by time. ``reached`` marks
    those that open one whatever came before: a new chapter, or a step of a whole span. Between these, steps are
    shorter than a bucket, so the next opening lies in the bucket where a span ends, or in the one behind it.
    """
    changed = with_previous(segments.select("source_id", "seg_idx", "start_s", "chapter_id"), KEY, "seg_idx",
                            {"__before": "chapter_id"}, BLOCK_ROWS)
    fresh = F.when(F.col("__before").isNull() | (F.col("__before") != F.col("chapter_id")), 1).otherwise(0)
    parts = running_totals(changed, KEY, "seg_idx", {"__part": fresh}, block_rows=BLOCK_ROWS)
    latest = running_totals(parts, [*KEY, "__part"], "seg_idx", {"__latest": F.col("start_s")}, F.max, BLOCK_ROWS)
    seen = with_previous(latest, KEY, "seg_idx", {"__was": "__latest", "__of": "__part"}, BLOCK_ROWS)
    first = F.col("__of").isNull() | (F.col("__of") != F.col("__part"))
    reached = first | (F.col("start_s") - F.col("__was") >= fixed.SPAN_SECONDS)
    opening = seen.where(first | (F.col("start_s") > F.col("__was"))).withColumn("__reached", reached)
    ends = F.col("start_s") + F.lit(fixed.SPAN_SECONDS)
    # A sum may be rounded down; a segment that starts there is still too early.
    side = F.when(ends - F.col("start_s") >= fixed.SPAN_SECONDS, 0).otherwise(2)

    def event(t: Column, side: Column, back: int) -> Column:
        return F.struct(t.alias("t"), side.alias("side"), (F.floor(t / SPAN_BUCKET) - back).alias("bucket"))

    start, mark = F.col("start_s"), F.lit(1)
    events = opening.select("source_id", "__part", "seg_idx", "__reached", F.explode(F.array(
        event(start, mark, 0), event(start, mark, 1), event(ends, side, 0))).alias("e"))
    behind = Window.partitionBy("source_id", "__part", "e.bucket").orderBy(F.desc("e.t"), F.desc("e.side")).rowsBetween(
        Window.unboundedPreceding, -1)
    following = F.min(F.when(F.col("e.side") == 1, F.struct("e.t", "seg_idx"))).over(behind)
    return events.withColumn("to", following["seg_idx"]).where("e.side <> 1").select(
        "source_id", "seg_idx", F.col("__reached").alias("reached"), "to")


def span_starts(segments: DataFrame) -> DataFrame:
    """(source_id, seg_idx) of the segments that open a span, for sources of any length.

    Pointers are followed by doubling: after round k all openings up to 2^k behind a certain one are reached, so
    the longest stretch without a certain one takes its logarithm in rounds and written tables.
    """
    nodes = cut_lineage(_span_pointers(segments))
    while not nodes.where("reached AND to IS NOT NULL").isEmpty():
        onward = nodes.select("source_id", F.col("seg_idx").alias("to"), F.col("to").alias("__to"))
        hit = nodes.where("reached AND to IS NOT NULL").select(
            "source_id", F.col("to").alias("seg_idx"), F.lit(True).alias("__hit")).distinct()
        nodes = cut_lineage(nodes.join(onward, ["source_id", "to"], "left").join(hit, ["source_id", "seg_idx"], "left").select(
            "source_id", "seg_idx", (F.col("reached") | F.col("__hit").isNotNull()).alias("reached"), F.col("__to").alias("to")))
    return nodes.where("reached").select("source_id", "seg_idx")


def span_firsts(lines: str) -> Column:
    """The positions of the lines that open a span, in one pass over the lines of a record."""
    none = F.struct(F.lit(None).cast("int").alias("chapter"), F.lit(None).cast("double").alias("start"),
                    F.array().cast("array<int>").alias("firsts"))

    def step(open_: Column, x: Column) -> Column:
        stays = (x["chapter_id"] == open_["chapter"]) & (x["start_s"] - open_["start"] < fixed.SPAN_SECONDS)
        opened = F.struct(x["chapter_id"].cast("int").alias("chapter"), x["start_s"].alias("start"),
                          F.concat(open_["firsts"], F.array(x["seg_idx"].cast("int"))).alias("firsts"))
        return F.when(stays, open_).otherwise(opened)

    return F.aggregate(lines, none, step, lambda x: x["firsts"])


def _record_spans(segments: DataFrame) -> DataFrame:
    """Spans of sources cut out of one input record: the lines of a record meet as one array, as they came."""
    line = F.struct("seg_idx", "start_s", "end_s", "chapter_id", "text")
    lines = segments.groupBy("source_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    cut = lines.withColumn("firsts", span_firsts("lines"))
    after = F.coalesce(F.get("firsts", F.col("span_id") + 1), F.size("lines"))
    spans = cut.select("source_id", "lines", "firsts", F.posexplode("firsts").alias("span_id", "first_seg")).select(
        "source_id", "span_id", "first_seg", F.slice("lines", F.col("first_seg") + 1, after - F.col("first_seg")).alias("s"))
    last = F.element_at("s", -1)
    return spans.select(
        "source_id", "span_id", F.col("s")[0]["chapter_id"].alias("chapter_id"), F.col("s")[0]["start_s"].alias("start_s"),
        last["end_s"].alias("end_s"), F.array_join(F.col("s.text"), " ").alias("text"), "first_seg",
        last["seg_idx"].alias("last_seg"))


def record_chapters(lines: str, duration: str) -> Column:
    """``pause_chapters`` of one record, as a list, from its ``lines`` in order and its duration; the position is the id."""
    paused = F.filter(lines, lambda x, i: (i > 0) & (x["start_s"] - F.get(lines, i - 1)["end_s"] > fixed.PAUSE_GAP_SECONDS))
    last_second = F.greatest(F.lit(1), F.floor(duration).cast("int")) - 1
    blocks = F.transform(F.sequence(F.lit(0), last_second, F.lit(fixed.BLOCK_SECONDS)), lambda x: x.cast("double"))
    starts = F.when(F.size(paused) > 0, F.concat(F.array(F.lit(0.0)), F.transform(paused, lambda x: x["start_s"]))).otherwise(blocks)
    # Zipped with what follows, so that the starts are made once a record and not once a chapter.
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.lit(None).cast("double")))
    bounds = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), F.coalesce(e, F.greatest(F.col(duration), s + 1.0)).alias("e")))
    return F.transform(bounds, lambda b, i: F.struct(
        i.alias("chapter_id"), F.concat(F.lit("Segment "), (i + 1).cast("string"), F.lit(" ("), timecode.minutes_stamp(b["s"]), F.lit("-"),
                                        timecode.minutes_stamp(b["e"]), F.lit(")")).alias("title"), b["s"].alias("start_s"), b["e"].alias("end_s")))


def build_spans(segments: DataFrame, one_record: bool = False) -> DataFrame:
    """Spans of about 30 s inside one chapter, from segments with ``chapter_id``."""
    if one_record:
        return _record_spans(segments)
    slim = cut_lineage(segments.select("source_id", "seg_idx", "start_s", "end_s", "chapter_id", "text"))
    opened = slim.join(span_starts(slim).withColumn("__opens", F.lit(True)), ["source_id", "seg_idx"], "left")
    parts = running_totals(opened, KEY, "seg_idx", {"first_seg": F.when(F.col("__opens"), F.col("seg_idx"))}, F.max, BLOCK_ROWS)
    line = F.struct("seg_idx", "text")
    spans = parts.groupBy("source_id", "first_seg").agg(
        F.min("chapter_id").alias("chapter_id"), F.min_by("start_s", "seg_idx").alias("start_s"),
        F.max_by("end_s", "seg_idx").alias("end_s"), F.max("seg_idx").alias("last_seg"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), " ").alias("text"))
    placed = row_index(spans, KEY, [F.col("first_seg")], F.floor(F.col("first_seg") / 65536), "span_id")
    return placed.withColumn("span_id", F.col("span_id").cast("int")).select(
        "source_id", "span_id", "chapter_id", "start_s", "end_s", "text", "first_seg", "last_seg")


def stamped_line() -> Column:
    return F.concat(F.lit("["), timecode.minutes_stamp(F.col("start_s")), F.lit("] "), F.col("text"))


def span_context(spans: DataFrame, segments: DataFrame, pad: int = 0) -> DataFrame:
    """The padded segments of each span as one block; extra columns of ``spans`` are kept.

    ``spans`` needs ``source_id, first_seg, last_seg``; a span covers about 30 s, so few rows.
    """
    extra = [c for c in spans.columns if c not in ("source_id", "first_seg", "last_seg")]
    wide = spans.withColumn("seg_idx", F.explode(F.sequence(
        F.greatest(F.col("first_seg") - pad, F.lit(0)), F.col("last_seg") + pad)))
    lines = wide.select("source_id", *extra, "first_seg", "last_seg", "seg_idx").join(
        segments.select("source_id", "seg_idx", "start_s", "end_s", stamped_line().alias("line")),
        ["source_id", "seg_idx"])
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "line")))
    return lines.groupBy("source_id", *extra, "first_seg", "last_seg").agg(
        F.min_by("start_s", "seg_idx").alias("t0"), F.max_by("end_s", "seg_idx").alias("t1"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("block"))
