"""Evidence selection under a text and frame budget, for every question and source that meet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timesift.functions import fixed, measures, text, timecode
from timesift.operators import retrieval
from timesift.operators import segments as seg
from timesift.operators.keyed import ordered_fold, row_index
from timesift.operators.spacing import keep_spaced
from timesift.operators.retrieval import PAIR
from timesift.session import cut_lineage

SPAN = ["question_id", "source_id", "span_id"]


@dataclass
class Scout:
    """The reusable reading of a corpus: segments with chapters, chapters, spans with tokens."""

    segments: DataFrame
    chapters: DataFrame
    spans: DataFrame


def scout(segments: DataFrame, one_record: bool = False, metadata: DataFrame | None = None) -> Scout:
    """Read the corpus once and keep the result as tables in the shared folder.

    ``metadata`` is ``(source_id, duration, chapters)``: its usable chapters and durations come first, pauses stand in elsewhere.
    """
    if metadata is None:
        marked = cut_lineage(seg.pause_marks(segments, one_record))
        chapters = cut_lineage(seg.pause_chapters(segments, one_record=one_record))
    else:
        segments = cut_lineage(segments)
        chapters = cut_lineage(seg.chapters_from_metadata(metadata, segments))
        told = metadata.where("duration > 0").select("source_id", F.col("duration").cast("double").alias("told"))
        ends = seg.durations(segments).join(told, "source_id", "left").select("source_id", F.coalesce("told", "duration").alias("duration"))
        marked = cut_lineage(seg.attach_chapters(segments, chapters).join(ends, "source_id"))
    spans = cut_lineage(retrieval.with_tokens(seg.build_spans(marked, one_record)))
    return Scout(marked, chapters, spans)


def chapter_sizes(segments: DataFrame) -> DataFrame:
    """(source_id, chapter_id, chars): length of the chapter as stamped lines."""
    return segments.groupBy("source_id", "chapter_id").agg(
        (F.sum(F.length(seg.stamped_line())) + F.count(F.lit(1)) - 1).alias("chars"))


def budget_rollup(ranks: DataFrame, sizes: DataFrame, budget: int = fixed.TEXT_BUDGET, budgets: DataFrame | None = None) -> DataFrame:
    """Chapters kept while walking the ranking: the first always, then each that still fits.

    ``budgets`` is ``(question_id, text_budget)`` where questions have budgets of their own.
    """
    rows = ranks.join(sizes, ["source_id", "chapter_id"])
    rows = rows.join(budgets, "question_id") if budgets is not None else rows.withColumn("text_budget", F.lit(budget))
    rows = rows.select(*PAIR, F.col("rank").cast("int").alias("rank"), "chapter_id", "best", "chars", "text_budget")

    def step(used, chars: int, budget: int):
        if used is None:
            return (), int(chars)
        return ((), used + int(chars)) if used + chars <= budget else (None, used)

    return ordered_fold(rows, PAIR, "rank", ["chars", "text_budget"], step).drop("text_budget")


def numeric_guard(pairs: DataFrame, selected: DataFrame, segments: DataFrame, spans: DataFrame,
                  pattern: str = fixed.NUMERIC, cap: int = fixed.NUMERIC_GUARD_CAP) -> DataFrame:
    """(pair, span_id, guard_no): the first number-bearing spans outside the selected chapters."""
    numeric = segments.where(F.col("text").rlike(pattern)).select("source_id", "seg_idx")
    # Spans partition the segments: each numeric segment lies in exactly one.
    inside = spans.select("source_id", "span_id", "chapter_id",
                          F.explode(F.sequence("first_seg", "last_seg")).alias("seg_idx"))
    hits = numeric.join(inside, ["source_id", "seg_idx"]).groupBy("source_id", "span_id", "chapter_id").agg(
        F.min("seg_idx").alias("at"))
    open_hits = pairs.join(hits, "source_id").join(
        selected.select(*PAIR, "chapter_id"), [*PAIR, "chapter_id"], "left_anti")
    order = Window.partitionBy(*PAIR).orderBy("at")
    return open_hits.withColumn("guard_no", F.row_number().over(order)).where(F.col("guard_no") <= cap).select(
        *SPAN, "chapter_id", "guard_no")


def span_facets(spans: DataFrame, facets: DataFrame) -> DataFrame:
    """(source_id, span_id, chapter_id, facet, facet_no): facets whose words a span holds."""
    return spans.select("source_id", "span_id", "chapter_id", F.explode("tokens").alias("word")).join(
        facets, "word").select("source_id", "span_id", "chapter_id", "facet", "facet_no").distinct()


def facet_coverage(fired: DataFrame, selected: DataFrame, chosen_spans: DataFrame, held: DataFrame) -> DataFrame:
    """(pair, facet, facet_no, covered) for each fired facet of a pair."""
    by_chapter = selected.select(*PAIR, "chapter_id").join(
        held.select("source_id", "chapter_id", "facet").distinct(), ["source_id", "chapter_id"]).select(*PAIR, "facet")
    by_span = chosen_spans.select(*SPAN).join(held, ["source_id", "span_id"]).select(*PAIR, "facet")
    seen = by_chapter.unionByName(by_span).distinct().withColumn("__c", F.lit(True))
    return fired.join(seen, [*PAIR, "facet"], "left").select(
        *PAIR, "facet", "facet_no", F.coalesce("__c", F.lit(False)).alias("covered"))


def facet_expansion(coverage: DataFrame, selected: DataFrame, chosen_spans: DataFrame, spans: DataFrame,
                    facets: DataFrame, held: DataFrame, top: int = fixed.FACET_EXPANSION_TOP) -> DataFrame:
    """(pair, span_id, facet, score): up to three best spans for each uncovered facet, in facet order.

    A later facet sees what earlier ones added. Earlier facets add at most ``top`` spans each, so
    a facet never needs more than its best ``top * facets`` spans outside the first choice; one
    pair folds over that short list.
    """
    depth = top * len(fixed.FACETS)
    weights = facets.select("facet", text.normalize_token(F.col("word")).alias("term")).groupBy(
        "facet", "term").agg(F.count(F.lit(1)).alias("weight"))
    open_facets = coverage.where("not covered").select(*PAIR, "facet", "facet_no")
    read = spans.join(open_facets.select("source_id").distinct(), "source_id", "left_semi")
    scored = retrieval.span_scores(retrieval.term_parts(read, weights), weights, by="facet")
    fresh = (
        open_facets.join(scored, ["source_id", "facet"])
        .join(selected.select(*PAIR, "chapter_id"), [*PAIR, "chapter_id"], "left_anti")
        .join(chosen_spans.select(*SPAN), SPAN, "left_anti"))
    order = Window.partitionBy(*PAIR, "facet").orderBy(F.desc("score"), "span_id")
    best = fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)
    words = held.groupBy("source_id", "span_id").agg(F.collect_set("facet_no").alias("holds"))
    listed = best.join(words, ["source_id", "span_id"]).groupBy(*PAIR).agg(F.array_sort(F.collect_list(
        F.struct("facet_no", "rank", "span_id", "facet", "score", "holds"))).alias("items"))

    kind = listed.schema["items"].dataType.elementType
    entry = f"struct<span_id:{kind['span_id'].dataType.simpleString()},facet:string,score:double>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("taken"), F.array().cast("array<int>").alias("covered"),
                     F.lit(-1).alias("facet_no"), F.lit(False).alias("skip"), F.lit(0).alias("n"))

    def step(acc: Column, item: Column) -> Column:
        changed = acc["facet_no"] != item["facet_no"]
        skip = F.when(changed, F.array_contains(acc["covered"], item["facet_no"])).otherwise(acc["skip"])
        n = F.when(changed, 0).otherwise(acc["n"])
        take = ~skip & (n < top) & ~F.exists(acc["taken"], lambda t: t["span_id"] == item["span_id"])
        own = F.struct(item["span_id"].alias("span_id"), item["facet"].alias("facet"), item["score"].alias("score")).cast(entry)
        return F.struct(
            F.when(take, F.concat(acc["taken"], F.array(own))).otherwise(acc["taken"]).alias("taken"),
            F.when(take, F.array_union(acc["covered"], item["holds"])).otherwise(acc["covered"]).alias("covered"),
            item["facet_no"].alias("facet_no"), skip.alias("skip"),
            F.when(take, n + 1).otherwise(n).alias("n"))

    # A span may stand under several facets: the entry names the one that took it.
    taken = listed.select(*PAIR, F.explode(F.aggregate("items", start, step, lambda acc: acc["taken"])).alias("t"))
    return taken.select(*PAIR, "t.span_id", "t.facet", "t.score")


def span_rescue(scores: DataFrame, selected: DataFrame, chosen_spans: DataFrame,
                per_chapter: int = fixed.SPAN_RESCUE_PER_CHAPTER, top: int = fixed.SPAN_RESCUE_TOP) -> DataFrame:
    """(pair, span_id, score): best spans outside the selected chapters, two a chapter, eight a pair."""
    left = scores.join(selected.select(*PAIR, "chapter_id"), [*PAIR, "chapter_id"], "left_anti").join(
        chosen_spans.select(*SPAN), SPAN, "left_anti")
    inside = Window.partitionBy(*PAIR, "chapter_id").orderBy(F.desc("score"), "span_id")
    held = left.withColumn("__r", F.row_number().over(inside)).where(F.col("__r") <= per_chapter)
    order = Window.partitionBy(*PAIR).orderBy(F.desc("score"), "span_id")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        *SPAN, "chapter_id", "score", "rank")


def chapter_anchor(start: Column, end: Column, duration: Column) -> Column:
    """Ten seconds into the chapter, its middle when that is too late, never past the last half second."""
    at = start + fixed.CHAPTER_FRAME_OFFSET
    at = F.when(at >= end, (start + end) / 2).otherwise(at)
    return F.least(at, F.greatest(F.lit(0.0), duration - 0.5))


def durations(chapters_segments: DataFrame) -> DataFrame:
    return chapters_segments.groupBy("source_id").agg(F.max("duration").alias("duration"))


def targeted_specs(selected: DataFrame, guards: DataFrame, scouted: Scout,
                   deictic: str = fixed.DEICTIC) -> DataFrame:
    """(pair, class, ord, ts, reason, title): wanted frames in order of priority."""
    titled = scouted.chapters.select("source_id", "chapter_id", "title", "start_s", "end_s")
    known = durations(scouted.segments)
    chosen = selected.select(*PAIR, "chapter_id").join(titled, ["source_id", "chapter_id"])
    anchors = chosen.join(known, "source_id").select(
        *PAIR, F.lit(0).alias("class"), F.col("chapter_id").cast("long").alias("ord"),
        chapter_anchor(F.col("start_s"), F.col("end_s"), F.col("duration")).alias("ts"),
        F.lit("chapter-start").alias("reason"), "title")
    middle = scouted.spans.select("source_id", "span_id", ((F.col("start_s") + F.col("end_s")) / 2).alias("ts"))
    guarded = guards.join(middle, ["source_id", "span_id"]).join(
        titled.select("source_id", "chapter_id", "title"), ["source_id", "chapter_id"]).select(
        *PAIR, F.lit(1).alias("class"), F.col("guard_no").cast("long").alias("ord"), "ts",
        F.lit("numeric-guard").alias("reason"), "title")
    cues = scouted.segments.where(F.col("text").rlike(deictic)).select(
        "source_id", "chapter_id", "seg_idx", F.col("start_s").alias("ts"))
    pointed = chosen.select(*PAIR, "chapter_id", "title").join(cues, ["source_id", "chapter_id"]).select(
        *PAIR, F.lit(2).alias("class"), F.col("seg_idx").cast("long").alias("ord"), "ts",
        F.lit("deictic-cue").alias("reason"), "title")
    return anchors.unionByName(guarded).unionByName(pointed)


def coverage_specs(scouted: Scout, max_frames: int = fixed.COVERAGE_FRAMES,
                   deictic: str = fixed.DEICTIC) -> DataFrame:
    """Wanted frames of a full reading: every chapter, pointing cues, an even grid."""
    known = durations(scouted.segments)
    anchors = scouted.chapters.join(known, "source_id").select(
        "source_id", F.lit(0).alias("class"), F.col("chapter_id").cast("long").alias("ord"),
        chapter_anchor(F.col("start_s"), F.col("end_s"), F.col("duration")).alias("ts"),
        F.lit("chapter-start").alias("reason"), "title")
    pointed = scouted.segments.where(F.col("text").rlike(deictic)).join(
        scouted.chapters.select("source_id", "chapter_id", "title"), ["source_id", "chapter_id"]).select(
        "source_id", F.lit(1).alias("class"), F.col("seg_idx").cast("long").alias("ord"), F.col("start_s").alias("ts"),
        F.lit("deictic-cue").alias("reason"), "title")
    grid = uniform_grid(known, max_frames).select(
        "source_id", F.lit(2).alias("class"), F.col("i").cast("long").alias("ord"), "ts",
        F.lit("uniform-fill").alias("reason"), F.lit(None).cast("string").alias("title"))
    return anchors.unionByName(pointed).unionByName(grid)


def uniform_grid(known: DataFrame, n: int) -> DataFrame:
    """(…, i, ts): ``n`` middles of equal parts of ``duration``."""
    return known.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "ts", F.col("duration") * (F.col("i") + 0.5) / n)


def spaced_evidence(specs: DataFrame, keys: list[str], spacing: float = fixed.FRAME_DEDUPE_SECONDS) -> DataFrame:
    """Of ``(keys, class, ord, ts, …, cap)`` in order of class and ord, the times at least ``spacing``
    from every better one kept, at most ``cap`` a key, which is the same on all its rows."""
    return keep_spaced(specs, keys, "ts", [F.col("class"), F.col("ord")], spacing, F.col("cap"))


def unmet_terms(questions: DataFrame, pairs: DataFrame, rescued: DataFrame, shown: DataFrame,
                segments: DataFrame) -> DataFrame:
    """(pair, term, note_no): capitalised question terms that the shown text never has, three a pair.

    ``shown`` is ``(pair, seg_idx)``-wide: rows ``(pair, first_seg, last_seg)`` of shown blocks and
    ``(pair, chapter_id)`` rows with null bounds.
    """
    words = F.regexp_extract_all("text", F.lit("[A-Za-z][a-z0-9']+"), F.lit(0))
    capital = F.filter(words, lambda w, i: (i > 0) & w.rlike("^[A-Z]"))
    named = questions.select("question_id", F.explode(F.transform(
        capital, lambda w: text.normalize_token(F.lower(w)))).alias("term")).distinct()
    asked = retrieval.question_terms(questions).join(named, ["question_id", "term"], "left_semi").where(
        F.length("term") >= fixed.FUZZY_MIN_LEN).select("question_id", "term", "first_at")
    hits = segments.select("source_id", "seg_idx", "chapter_id",
                           F.explode(F.array_distinct(text.evidence_tokens(F.col("text")))).alias("term")).join(
        asked.select("term").distinct(), "term", "left_semi")
    by_chapter = shown.where("first_seg is null").select(*PAIR, "chapter_id").join(
        hits, ["source_id", "chapter_id"]).select(*PAIR, "term")
    by_block = shown.where("first_seg is not null").select(
        *PAIR, F.explode(F.sequence("first_seg", "last_seg")).alias("seg_idx")).join(
        hits, ["source_id", "seg_idx"]).select(*PAIR, "term")
    seen = by_chapter.unionByName(by_block).distinct()
    missing = pairs.join(asked, "question_id").join(
        rescued.select(*PAIR, "term"), [*PAIR, "term"], "left_anti").join(seen, [*PAIR, "term"], "left_anti")
    order = Window.partitionBy(*PAIR).orderBy("first_at")
    return missing.withColumn("note_no", F.row_number().over(order)).where(
        F.col("note_no") <= fixed.NOTE_LIMIT).select(*PAIR, "term", "note_no")


@dataclass
class Selection:
    """What was chosen for each (question, source) that meet."""

    pairs: DataFrame
    selected: DataFrame
    guards: DataFrame
    facets: DataFrame
    rescues: DataFrame
    rescued: DataFrame
    frames: DataFrame
    blocks: DataFrame
    unmet: DataFrame


def select_targeted(questions: DataFrame, scouted: Scout, *, budget: int = fixed.TEXT_BUDGET,
                    max_frames: int = fixed.TARGETED_FRAMES, facets: DataFrame | None = None,
                    numeric_facets: tuple[str, ...] = fixed.NUMERIC_FACETS,
                    numeric: str = fixed.NUMERIC, deictic: str = fixed.DEICTIC) -> Selection:
    """The targeted policy for all questions at once.

    A question with a ``source_id`` is asked of that source alone, and keeps the source's first chapter when no
    span scores. A null ``source_id``, or no such column, searches all sources: the question and a source then form a
    pair when at least one span scores above zero. Columns ``text_budget`` and ``max_frames`` give questions limits of their own.
    """
    spark = questions.sparkSession
    bound = retrieval.bindings(questions)
    facets = retrieval.facet_table(spark) if facets is None else facets
    spans, segments = scouted.spans, scouted.segments
    terms = retrieval.question_terms(questions)
    rescued = cut_lineage(retrieval.fuzzy_rescue(terms, spans, bound))

    fires = retrieval.facet_fires(terms, facets)
    near_fires = rescued.join(facets, F.col("match") == F.col("word")).select(*PAIR, "facet", "facet_no").distinct()
    new_fires = near_fires.join(fires.select("question_id", "facet"), ["question_id", "facet"], "left_anti")
    weights, own_weights = retrieval.bind(retrieval.term_weights(terms, fires, facets), bound)
    pair_weights = rescued.select(
        *PAIR, text.normalize_token(F.col("match")).alias("term"), (F.col("n") * fixed.QUESTION_TERM_WEIGHT).alias("w")
    ).unionByName(new_fires.join(facets.select("facet", "word"), "facet").select(
        *PAIR, text.normalize_token(F.col("word")).alias("term"), F.lit(1).alias("w"))
    )
    if own_weights is not None:
        pair_weights = pair_weights.unionByName(own_weights.withColumnRenamed("weight", "w"))
    pair_weights = cut_lineage(pair_weights.groupBy(*PAIR, "term").agg(F.sum("w").alias("weight")))
    scores = cut_lineage(retrieval.span_scores(retrieval.term_parts(spans, weights, pair_weights), weights, pair_weights))

    ranks = retrieval.chapter_ranks(scores)
    if bound is not None:
        first = scouted.chapters.groupBy("source_id").agg(F.min("chapter_id").alias("chapter_id"))
        silent = bound.join(ranks.select(*PAIR).distinct(), PAIR, "left_anti").join(first, "source_id")
        ranks = ranks.unionByName(silent.select(*PAIR, "chapter_id", F.lit(0.0).alias("best"), F.lit(0.0).alias("top_two"), F.lit(0).alias("rank")))
    own_budgets = questions.select("question_id", "text_budget") if "text_budget" in questions.columns else None
    selected = cut_lineage(budget_rollup(ranks, chapter_sizes(segments), budget, own_budgets))
    pairs = selected.where("rank = 0").select(*PAIR)
    fired = pairs.join(fires, "question_id").unionByName(new_fires.join(pairs, PAIR, "left_semi"))

    guard_pairs = fired.where(F.col("facet").isin(list(numeric_facets))).select(*PAIR).distinct()
    guards = cut_lineage(numeric_guard(guard_pairs, selected, segments, spans, numeric))
    held = span_facets(spans, facets)
    covered = facet_coverage(fired, selected, guards, held)
    added = cut_lineage(facet_expansion(covered, selected, guards, spans, facets, held))
    rescues = cut_lineage(span_rescue(scores, selected, guards.select(*SPAN).unionByName(added.select(*SPAN))))

    extent = spans.select("source_id", "span_id", "first_seg", "last_seg")
    wide = guards.select(*SPAN, F.lit("numeric-guard").alias("reason"), F.lit(None).cast("double").alias("score")).unionByName(
        rescues.select(*SPAN, F.lit("span-rescue").alias("reason"), "score")).join(extent, ["source_id", "span_id"])
    exact = added.select(*SPAN, F.lit("facet-expansion").alias("reason"), "score").join(extent, ["source_id", "span_id"])
    blocks = cut_lineage(seg.span_context(wide, segments, pad=1).unionByName(seg.span_context(exact, segments)))

    span_chars = blocks.groupBy(*PAIR).agg(F.sum(F.length("block")).alias("more"))
    chars = selected.groupBy(*PAIR).agg(F.sum("chars").alias("chars")).join(span_chars, PAIR, "left").select(
        *PAIR, (F.col("chars") + F.coalesce("more", F.lit(0))).alias("chars"))
    if "max_frames" in questions.columns:
        chars = chars.join(questions.select("question_id", "max_frames"), "question_id")
    else:
        chars = chars.withColumn("max_frames", F.lit(max_frames))
    cap = measures.reader_budget(F.col("chars"), F.col("max_frames")).cast("int")
    specs = targeted_specs(selected, guards, scouted, deictic).join(chars.select(*PAIR, cap.alias("cap")), PAIR)
    frames = spaced_evidence(specs, PAIR)

    shown = selected.select(*PAIR, "chapter_id", F.lit(None).cast("int").alias("first_seg"),
                            F.lit(None).cast("int").alias("last_seg")).unionByName(
        blocks.select(*PAIR, F.lit(None).cast("int").alias("chapter_id"),
                      (F.col("first_seg") - F.when(F.col("reason") == "facet-expansion", 0).otherwise(1)).alias("first_seg"),
                      (F.col("last_seg") + F.when(F.col("reason") == "facet-expansion", 0).otherwise(1)).alias("last_seg")))
    unmet = unmet_terms(questions, pairs, rescued, shown, segments)
    return Selection(pairs, selected, guards, added, rescues, rescued, cut_lineage(frames), blocks, unmet)


def evidence_rows(chosen: Selection, scouted: Scout) -> DataFrame:
    """(pair, t_start, t_end, chapter, modality, reason, score, start_s): one row per piece of evidence."""
    titles = scouted.chapters.select("source_id", "chapter_id", "title", "start_s", "end_s")
    stamp = timecode.minutes_stamp
    whole = chosen.selected.join(titles, ["source_id", "chapter_id"]).select(
        *PAIR, stamp(F.col("start_s")).alias("t_start"), stamp(F.col("end_s")).alias("t_end"),
        F.col("title").alias("chapter"), F.lit("transcript").alias("modality"), F.lit("chapter-rollup").alias("reason"),
        F.round("best", 3).alias("score"), "start_s")
    owner = scouted.spans.select("source_id", "span_id", "chapter_id").join(
        titles.select("source_id", "chapter_id", "title"), ["source_id", "chapter_id"])
    parts = chosen.blocks.join(owner, ["source_id", "span_id"]).select(
        *PAIR, stamp(F.col("t0")).alias("t_start"), stamp(F.col("t1")).alias("t_end"),
        F.col("title").alias("chapter"), F.lit("transcript").alias("modality"), "reason",
        F.round("score", 3).alias("score"), F.col("t0").alias("start_s"))
    shots = chosen.frames.select(
        *PAIR, stamp(F.col("ts")).alias("t_start"), stamp(F.col("ts")).alias("t_end"), F.col("title").alias("chapter"),
        F.lit("frame").alias("modality"), "reason", F.lit(None).cast("double").alias("score"), F.col("ts").alias("start_s"))
    return whole.unionByName(parts).unionByName(shots)


def notes(chosen: Selection) -> DataFrame:
    """(pair, note_no, note): spelling matches first, then terms the evidence never names."""
    spelled = chosen.rescued.join(chosen.pairs, PAIR, "left_semi").where(F.col("note_no") <= fixed.NOTE_LIMIT).select(
        *PAIR, "note_no", F.concat(F.lit("question term '"), "term", F.lit("' not in transcript; matched transcript spelling '"),
                                   "match", F.lit("'")).alias("note"))
    missed = chosen.unmet.select(
        *PAIR, (F.col("note_no") + fixed.NOTE_LIMIT).alias("note_no"),
        F.concat(F.lit("question term '"), "term", F.lit(
            "' not found in selected evidence; retrieval may be incomplete -- consider --detail balanced")).alias("note"))
    return spelled.unionByName(missed)


def manifests(questions: DataFrame, chosen: Selection, scouted: Scout) -> DataFrame:
    """One nested document per pair. What one pair holds is bounded by its text and frame budgets."""
    rows = evidence_rows(chosen, scouted).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("start_s", "t_start", "t_end", "chapter", "modality", "reason", "score"))).alias("evidence"),
        F.count_if(F.col("modality") == "frame").alias("frames"))
    texts = notes(chosen).groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("note_no", "note"))).alias("n"))
    sizes = chosen.selected.groupBy(*PAIR).agg(F.sum("chars").alias("chapter_chars"))
    return rows.join(texts, PAIR, "left").join(sizes, PAIR).join(questions.select("question_id", "text"), "question_id").select(
        *PAIR, F.lit(1).alias("schema_version"), F.lit("targeted").alias("policy"), F.col("text").alias("question"),
        "evidence", F.struct("chapter_chars", "frames").alias("reader_cost"),
        F.struct(text.obligations(F.col("text")).alias("obligations"),
                 F.coalesce(F.transform("n", lambda x: x["note"]), F.array().cast("array<string>")).alias("notes")).alias("retrieval"))


def select_coverage(scouted: Scout, max_frames: int = fixed.COVERAGE_FRAMES, deictic: str = fixed.DEICTIC) -> DataFrame:
    """Coverage policy: (source_id, t_start, t_end, chapter, modality, reason) of the whole text and its frames."""
    stamp = timecode.minutes_stamp
    whole = scouted.segments.groupBy("source_id").agg(
        (F.sum(F.length(seg.stamped_line())) + F.count(F.lit(1)) - 1).alias("chars"), F.max("duration").alias("duration"))
    cap = measures.reader_budget(F.col("chars"), F.lit(max_frames)).cast("int")
    specs = coverage_specs(scouted, max_frames, deictic).join(whole.select("source_id", cap.alias("cap")), "source_id")
    frames = spaced_evidence(specs, ["source_id"]).select(
        "source_id", stamp(F.col("ts")).alias("t_start"), stamp(F.col("ts")).alias("t_end"), F.col("title").alias("chapter"),
        F.lit("frame").alias("modality"), "reason")
    full = whole.select(
        "source_id", F.lit("00:00").alias("t_start"), stamp(F.col("duration")).alias("t_end"),
        F.lit(None).cast("string").alias("chapter"), F.lit("transcript").alias("modality"),
        F.lit("coverage-full-transcript").alias("reason"))
    return full.unionByName(frames)


def report_lines(questions: DataFrame, chosen: Selection, scouted: Scout) -> DataFrame:
    """(pair, section, ord, sub, line): the printed report as rows, ready for an ordered text sink.

    All text that came from a source is sanitized; blocks are ordered by start time. Every transcript
    line is a row of its own, so no block is held as a whole.
    """
    titles = scouted.chapters.select("source_id", "chapter_id", "title", "start_s", "end_s")
    stamp = timecode.minutes_stamp

    def rows(df: DataFrame, section: int, ord_: Column, line: Column, sub: Column | None = None) -> DataFrame:
        return df.select(*PAIR, F.lit(section).alias("section"), ord_.cast("double").alias("ord"),
                         (F.lit(-1) if sub is None else sub).alias("sub"), line.alias("line"))

    head = chosen.pairs.join(questions.select("question_id", "text"), "question_id").select(*PAIR, F.posexplode(F.array(
        F.lit("# Evidence report"), F.concat(F.lit("Question: "), "text"), F.lit("Policy: targeted"),
        F.lit(""), F.lit("## Selected chapters"))).alias("at", "text"))
    span_of = F.concat(F.lit("["), stamp(F.col("start_s")), F.lit("-"), stamp(F.col("end_s")), F.lit("]"))
    # Source text is sanitized once per source, before pairs multiply it.
    titles = titles.withColumn("listed", text.sanitize(F.concat("title", F.lit(" "), span_of)))
    picked = chosen.selected.select(*PAIR, "chapter_id").join(titles, ["source_id", "chapter_id"])
    listed = F.col("listed")
    told = notes(chosen)
    lines = scouted.segments.select("source_id", "chapter_id", "seg_idx", text.sanitize(seg.stamped_line()).alias("stamped"))
    spoken = picked.select(*PAIR, "chapter_id", F.col("start_s").alias("from_s")).join(lines, ["source_id", "chapter_id"])
    owner = scouted.spans.select("source_id", "span_id", "chapter_id").join(
        titles.select("source_id", "chapter_id", "title"), ["source_id", "chapter_id"])
    header = F.concat("reason", F.lit(" ["), stamp(F.col("t0")), F.lit("-"), stamp(F.col("t1")), F.lit("] ("), "title", F.lit(")"))
    parts = chosen.blocks.join(owner, ["source_id", "span_id"])
    return (
        rows(head, 0, F.col("at"), F.col("text"))
        .unionByName(rows(picked, 1, F.col("start_s"), F.concat(F.lit("- "), listed)))
        .unionByName(rows(told, 2, F.col("note_no"), F.concat(F.lit("- "), text.sanitize(F.col("note")))))
        .unionByName(rows(chosen.frames, 3, F.col("ts"), F.concat(F.lit("- t="), stamp(F.col("ts")), F.lit(" ("), "reason", F.lit(")"))))
        .unionByName(rows(picked, 4, F.col("start_s"), F.concat(F.lit("### "), listed)))
        .unionByName(rows(spoken, 4, F.col("from_s"), F.col("stamped"), F.col("seg_idx")))
        .unionByName(rows(parts, 4, F.col("t0"), F.concat(F.lit("### "), text.sanitize(header), F.lit("\n"), text.sanitize(F.col("block")))))
    )
