"""Spans, chapters and lines of a source ranked for every question, in the row of the source.

A question's words and weights are the small side: blocks of questions of at most ``WEIGHTS_PER_BLOCK`` words are broadcast
one by one, and an Arrow step scores the spans of many sources against a block at once, so no row is made for a span,
a question and a term, and none is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timesift.functions import fixed, text

WEIGHTS_PER_BLOCK = 200_000
#: Scores held at a time, one for each span and question; a source is never parted.
CELLS = 1 << 20

CHAPTER = "chapter_id:int,best:double,top_two:double"
HITS = "hits:array<struct<neg:double,span_id:int,score:double>>"


def ranked(shelf: DataFrame, weights: DataFrame, hits: bool = False, tokens: str = "spans.tokens", own: str | None = None,
           per_block: int = WEIGHTS_PER_BLOCK) -> DataFrame:
    """One row a pair: its shelf, ``question_id`` and ``ranked``, as ``records.ranked_pairs`` of the scores that ``weights`` give.

    ``ranked`` lists (chapter_id, best, top_two), and the spans of a chapter, best first, where ``hits`` are asked for.
    ``own`` is a list of (question_id, term, weight) that hold in this source only, for questions of ``weights``.
    """
    context, n = shelf.sparkSession.sparkContext, weights.count()
    blocks = max(1, math.ceil(n / per_block))
    kept = [c for c in shelf.columns if c not in (tokens, own)]
    kind = weights.schema["question_id"].dataType.simpleString()
    shape = f"array<struct<question_id:{kind},ranked:array<struct<{CHAPTER}{',' + HITS if hits else ''}>>>>"

    def one(block: int) -> DataFrame:
        part = weights if blocks == 1 else weights.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        rank = F.arrow_udf(_ranker(context.broadcast(_index(part.select("question_id", "term", "weight").toArrow())), hits), shape)
        made = shelf.withColumn("spans_ranked", rank("spans.chapter_id", tokens, *([own] if own else [])))
        # The outer form keeps Spark from testing for emptiness, which would rank everything twice.
        return made.select(*kept, F.explode_outer("spans_ranked").alias("p")).where("p IS NOT NULL").select(*kept, "p.question_id", "p.ranked")

    return reduce(DataFrame.unionByName, [one(block) for block in range(blocks)])


def _index(weights: pa.Table) -> dict:
    """The words of a block of questions, and for each word, in a row, the questions that ask for it and its weight there."""
    words, asked = weights["term"].combine_chunks().dictionary_encode(), weights["question_id"].combine_chunks().dictionary_encode()
    term = words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    count = np.bincount(term, minlength=len(words.dictionary))
    return {"terms": words.dictionary, "questions": asked.dictionary, "count": count, "first": np.cumsum(count) - count,
            "asker": asked.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order],
            "weight": weights["weight"].to_numpy().astype(np.float64)[order]}


def _ranker(shared, hits: bool):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        index = shared.value
        for chapters, tokens, *own in batches:
            cells = np.cumsum(_sizes(chapters)) * max(1, len(index["questions"]))
            at = 0
            while at < len(chapters):
                end = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS, "right")))
                yield _rank(chapters.slice(at, end - at), tokens.slice(at, end - at), index, hits, *[x.slice(at, end - at) for x in own])
                at = end

    return run


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions ``first[i]`` to ``first[i] + size[i] - 1`` of every i, in a row."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _six(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _rank(chapters: pa.Array, tokens: pa.Array, index: dict, hits: bool, own: pa.Array | None = None) -> pa.Array:
    """For each source, the questions that any of its spans meets, each with its chapters in order."""
    n_asked, terms, count, first_asked = len(index["questions"]), index["terms"], index["count"], index["first"]
    if own is not None:
        of, own = np.repeat(np.arange(len(own)), _sizes(own)), own.flatten()
        asker, weight = pc.index_in(own.field("question_id"), value_set=index["questions"]), own.field("weight").to_numpy(zero_copy_only=False)
        more = own.field("term").unique()
        more = more.filter(pc.invert(pc.is_in(more, value_set=terms)))
        terms = pa.concat_arrays([terms, more.cast(terms.type)])
        count, first_asked = (np.append(x, np.zeros(len(more), np.int64)) for x in (count, first_asked))
    n_terms = len(terms)
    n_spans = pc.fill_null(pc.list_value_length(chapters), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    chapter, said = chapters.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tokens.flatten()
    n_tokens = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int64)
    source = np.repeat(np.arange(len(n_spans)), n_spans)

    # Term frequency in a span, and the number of spans of the source that hold the term.
    word = pc.fill_null(pc.index_in(said.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.repeat(np.arange(len(n_tokens)), n_tokens) * n_terms + word
    held, tf = np.unique(held[word >= 0], return_counts=True)
    span, term = np.divmod(held, max(1, n_terms))
    _, same, df = np.unique(source[span] * n_terms + term, return_inverse=True, return_counts=True)
    part = tf * np.log(1 + n_spans[source[span]] / (1.0 + df[same]))

    # Every span and question that share a term.
    size = count[term]
    at = _runs(first_asked[term], size)
    cell, gain = np.repeat(span, size) * n_asked + index["asker"][at], np.repeat(part, size) * index["weight"][at]
    if own is not None:
        known = pc.is_valid(asker).to_numpy(zero_copy_only=False)
        asker = pc.fill_null(asker, 0).to_numpy(zero_copy_only=False).astype(np.int64)[known]
        wanted = (of * n_terms + pc.index_in(own.field("term"), value_set=terms).to_numpy(zero_copy_only=False))[known]
        there = source[span] * n_terms + term
        order = np.argsort(there, kind="stable")
        low, high = (np.searchsorted(there[order], wanted, side) for side in ("left", "right"))
        at = order[_runs(low, high - low)]
        cell = np.append(cell, span[at] * n_asked + np.repeat(asker, high - low))
        gain = np.append(gain, part[at] * np.repeat(weight[known].astype(np.float64), high - low))
    total = np.bincount(cell, gain)
    cell = np.flatnonzero(total)
    span = cell // max(1, n_asked)
    score = _six(total[cell] / (1 + np.log(1.0 + n_tokens[span])))
    cell, span, score = cell[score > 0], span[score > 0], score[score > 0]

    # Chapters of a pair: spans best first, ties by order; then chapters by best span, best two, order.
    n_chapters = int(chapter.max(initial=0)) + 1
    group = (source[span] * n_asked + cell % max(1, n_asked)) * n_chapters + chapter[span]
    order = np.lexsort((-score, group))
    group, span, score = group[order], span[order], score[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(first, append=len(group))
    best = score[first]
    two = _six(best + np.where(size > 1, np.append(score, 0.0)[first + 1], 0.0))
    pair, of = np.divmod(group[first], n_chapters)
    order = np.lexsort((-two, -best, pair))
    pair, first, size = pair[order], first[order], size[order]
    fields = {"chapter_id": pa.array(of[order].astype(np.int32)), "best": pa.array(best[order]), "top_two": pa.array(two[order])}
    if hits:
        at = _runs(first, size)
        start = np.cumsum(n_spans) - n_spans
        number = (span - start[source[span]])[at].astype(np.int32)
        fields["hits"] = _lists(size, pa.StructArray.from_arrays([pa.array(-score[at]), pa.array(number), pa.array(score[at])], ["neg", "span_id", "score"]))

    opens = np.flatnonzero(np.diff(pair, prepend=-1))
    listed = _lists(np.diff(opens, append=len(pair)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    by, asked = np.divmod(pair[opens], max(1, n_asked))
    pairs = pa.StructArray.from_arrays([index["questions"].take(pa.array(asked)), listed], ["question_id", "ranked"])
    return _lists(np.bincount(by, minlength=len(n_spans)), pairs)


LINES = "array<struct<seg_idx:int,start_s:double,score:double>>"
STEPS = "array<struct<obligation:string,indices:array<int>>>"
#: What a line can meet of a question beside being an answer, in order: the bits of its mark.
DUTIES = ["exact-number", "negation", "before-state", "after-state"]


def record_lines(segments: DataFrame) -> DataFrame:
    """(source_id, lines), one row a source: its lines (seg_idx, start_s, text) in order."""
    return segments.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start_s", "text"))).alias("lines"))


def lexical(lines: DataFrame, questions: DataFrame, limit: int = fixed.LEXICAL_LIMIT, every: bool = False, seeds: int | None = None,
            per_block: int = WEIGHTS_PER_BLOCK) -> DataFrame:
    """One row a pair of ``lines(source_id, lines)``: (pair, ranked), the lines of ``retrieval.lexical_rank``, best first.

    A pair without such a line has a row only where ``every`` pair is asked for. With ``seeds``, (pair, chosen, expansions) of
    ``retrieval.progressive_expand`` instead.
    """
    context, negating = lines.sparkSession.sparkContext, text.strings(fixed.NEGATION)
    only = F.col("source_id").cast("long") if "source_id" in questions.columns else F.lit(None).cast("long")
    asked = questions.select("question_id", only.alias("only"), F.array_distinct(text.exact_tokens(F.col("text"))).alias("terms"), F.transform(
        text.numbers(F.col("text")), F.lower).alias("values"), text.obligations(F.col("text")).alias("duties")).withColumn(
        "denied", F.arrays_overlap("terms", negating))
    n = asked.agg(F.sum(F.greatest(F.size("terms"), F.lit(0)) + F.greatest(F.size("values"), F.lit(0)) + 1)).first()[0] or 0
    blocks = max(1, math.ceil(n / per_block))
    kind = questions.schema["question_id"].dataType.simpleString()
    made = f"ranked:{LINES}" if seeds is None else f"chosen:array<int>,expansions:{STEPS}"
    names = ["ranked"] if seeds is None else ["chosen", "expansions"]

    def each(make) -> Column:
        return F.transform("lines", lambda x: make(x["text"]))

    def mark(said: Column) -> Column:
        low, out = F.lower(said), F.lit(0)
        marks = [low.rlike(fixed.NUMBER), F.arrays_overlap(text.exact_tokens(low), negating)] + [
            reduce(Column.__or__, [low.contains(w) for w in words]) for words in (fixed.BEFORE_WORDS, fixed.AFTER_WORDS)]
        for i, met in enumerate(marks):
            out = out + F.when(met, 1 << i).otherwise(0)
        return out

    inputs = [F.col("source_id").cast("long"), F.col("lines.seg_idx"), F.col("lines.start_s"), each(text.exact_tokens),
              each(lambda x: F.when(x.rlike(r"(?U)\d"), F.lower(x))), *([each(mark)] if seeds is not None else [])]

    def one(block: int) -> DataFrame:
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block)
        rank = F.arrow_udf(_line_ranker(context.broadcast(_asked_words(part.toArrow())), limit, every, seeds),
                           f"array<struct<question_id:{kind},{made}>>")
        # The outer form keeps Spark from testing for emptiness, which would rank everything twice.
        pairs = lines.withColumn("pairs", rank(*inputs)).select("source_id", F.explode_outer("pairs").alias("p"))
        return pairs.where("p IS NOT NULL").select("p.question_id", "source_id", *[f"p.{c}" for c in names])

    return reduce(DataFrame.unionByName, [one(block) for block in range(blocks)])


def _asked_words(asked: pa.Table) -> dict:
    """What a block of questions asks for, by word and by number, and of whom. Rows of one question that deny and ask alike add up."""
    askers, ids, words, values, rows = {}, {}, {}, {}, []
    for question, only, terms, numbers, duties, denied in zip(*[asked[c].to_pylist() for c in ("question_id", "only", "terms", "values", "duties", "denied")], strict=True):
        of = ids.setdefault(question, len(ids))
        by = askers.setdefault((of, bool(denied), only), len(askers))
        rows.append((of, sum(1 << i for i, duty in enumerate(DUTIES) if duty in duties)))
        for to, found in ((words, terms), (values, numbers)):
            for x in found or []:
                to.setdefault(x, {})
                to[x][by] = to[x].get(by, 0) + 1
    count = np.array([len(w) for w in words.values()], dtype=np.int64)
    by_key = {}
    for value, by in values.items():
        key = (re.search(r"\d\d", value) or re.search(r"\d", value))[0]
        by_key.setdefault(key, []).append((value, np.fromiter(by.keys(), np.int64), 2.0 * np.fromiter(by.values(), np.int64)))
    rows.sort()
    return {"terms": pa.array(list(words), pa.string()), "count": count, "first": np.cumsum(count) - count,
            "asker": np.array([a for w in words.values() for a in w], dtype=np.int64),
            "weight": np.array([n for w in words.values() for n in w.values()], dtype=np.float64), "values": by_key,
            "of": np.array([of for of, _, _ in askers], dtype=np.int64), "denied": np.flatnonzero([d for _, d, _ in askers]),
            "bound": [(i, only) for i, (_, _, only) in enumerate(askers) if only is not None],
            "questions": pa.array(list(ids), asked.schema.field("question_id").type), "rows": np.bincount(np.array([of for of, _ in rows], dtype=np.int64), minlength=len(ids)),
            "duties": np.array([d for _, d in rows], dtype=np.int64)}


def _line_ranker(shared, limit: int, every: bool, seeds: int | None):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        index = shared.value
        for batch in batches:
            cells = np.cumsum(_sizes(batch[1])) * max(1, len(index["of"]))
            at = 0
            while at < len(cells):
                end = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS, "right")))
                yield _rank_lines(*[x.slice(at, end - at) for x in batch], index=index, limit=limit, every=every, seeds=seeds)
                at = end

    return run


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _line_scores(source: np.ndarray, of: np.ndarray, n_lines: np.ndarray, tokens: pa.Array, low: pa.Array, index: dict) -> np.ndarray:
    """The score of each line for each asker."""
    n_asked, n_terms = len(index["of"]), len(index["terms"])
    said, sizes = tokens.flatten(), _sizes(tokens)
    line = np.repeat(np.arange(len(of)), sizes)
    word = pc.fill_null(pc.index_in(said, value_set=index["terms"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    held, tf = np.unique((line * n_terms + word)[word >= 0], return_counts=True)
    at, term = np.divmod(held, max(1, n_terms))
    _, same, df = np.unique(of[at] * n_terms + term, return_inverse=True, return_counts=True)
    part = (1 + np.log(tf)) * np.log((n_lines[of[at]] + 1) / (df[same] + 0.5))
    size = index["count"][term]
    ask = _runs(index["first"][term], size)
    total = np.bincount(np.repeat(at, size) * n_asked + index["asker"][ask], np.repeat(part, size) * index["weight"][ask], len(of) * n_asked)
    total = total.astype(np.float64).reshape(len(of), n_asked)
    if index["values"]:
        numbered = np.flatnonzero(low.is_valid().to_numpy(zero_copy_only=False))
        texts = low.take(pa.array(numbered))
        for key, values in index["values"].items():
            some = np.flatnonzero(pc.match_substring(texts, key).to_numpy(zero_copy_only=False))
            among = texts.take(pa.array(some))
            for value, askers, gain in values if len(some) else []:
                there = numbered[some[pc.match_substring(among, value).to_numpy(zero_copy_only=False)]]
                total[np.ix_(there, askers)] += gain
    if len(index["denied"]):
        negated = np.unique(line[pc.is_in(said, value_set=pa.array(fixed.NEGATION)).to_numpy(zero_copy_only=False)])
        total[np.ix_(negated, index["denied"])] += 1.0
    for asker, only in index["bound"]:
        total[source[of] != only, asker] = 0.0
    return _six(total)


def _rank_lines(source: pa.Array, seg: pa.Array, start: pa.Array, tokens: pa.Array, low: pa.Array, marks: pa.Array | None = None, *, index: dict,
                limit: int, every: bool, seeds: int | None) -> pa.Array:
    """For each source, the questions that any of its lines meets, each with its best lines in order."""
    n_lines, n_ids = _sizes(seg), len(index["questions"])
    of = np.repeat(np.arange(len(n_lines)), n_lines)
    seg, start = seg.flatten(), start.flatten()
    score = _line_scores(pc.fill_null(source, -1).to_numpy(zero_copy_only=False), of, n_lines, tokens.flatten(), low.flatten(), index)
    order = np.lexsort((seg.to_numpy(zero_copy_only=False), pc.fill_null(start, -np.inf).to_numpy(zero_copy_only=False), of))
    score = score[order]
    line, asker = np.nonzero(score > 0)
    pair, score = of[order[line]] * n_ids + index["of"][asker], score[line, asker]
    by = np.lexsort((-score, pair))
    line, pair, score = order[line[by]], pair[by], score[by]
    opens = np.flatnonzero(np.diff(pair, prepend=-1))
    rank = np.arange(len(pair)) - np.repeat(opens, np.diff(opens, append=len(pair)))
    line, pair, score = line[rank < limit], pair[rank < limit], score[rank < limit]
    pairs = np.arange(len(n_lines) * n_ids) if every else pair[np.flatnonzero(np.diff(pair, prepend=-1))]
    size = np.searchsorted(pair, pairs, "right") - np.searchsorted(pair, pairs)
    if seeds is None:
        fields = {"ranked": _lists(size, pa.StructArray.from_arrays([seg.take(pa.array(line)), start.take(pa.array(line)), pa.array(score)], ["seg_idx", "start_s", "score"]))}
    else:  # one row of a pair for each row of its question
        times = index["rows"][pairs % max(1, n_ids)]
        first = np.repeat(np.cumsum(size) - size, times)
        duty = index["duties"][_runs((np.cumsum(index["rows"]) - index["rows"])[pairs % max(1, n_ids)], times)]
        pairs, size = np.repeat(pairs, times), np.repeat(size, times)
        best = np.full((len(pairs), limit), -1)
        best[np.repeat(np.arange(len(pairs)), size), _runs(np.zeros(len(size), np.int64), size)] = line[_runs(first, size)]
        ends = np.cumsum(n_lines)
        fields = _expand(best, duty, marks.flatten().to_numpy(zero_copy_only=False), (ends - n_lines)[pairs // max(1, n_ids)], ends[pairs // max(1, n_ids)], seg, seeds)
    made = pa.StructArray.from_arrays([index["questions"].take(pa.array(pairs % max(1, n_ids))), *fields.values()], ["question_id", *fields])
    return _lists(np.bincount(pairs // max(1, n_ids), minlength=len(n_lines)), made)


def _expand(best: np.ndarray, duty: np.ndarray, marks: np.ndarray, first: np.ndarray, end: np.ndarray, seg: pa.Array, seeds: int) -> dict:
    """``chosen`` and ``expansions`` of pairs whose ``best`` lines lie from ``first`` to before ``end``.

    Something is chosen, so the answer is met; no other obligation can be met across lines, so each line is marked with those it meets.
    """
    n, empty = len(best), -1
    chosen = np.full((n, seeds + 3 * fixed.MAX_EXPANSIONS), empty)
    chosen[:, :min(seeds, best.shape[1])] = best[:, :seeds]
    stopped, steps = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
    at_step, names = [], []
    for i, name in enumerate(DUTIES):
        open_ = np.flatnonzero((duty >> i & 1 > 0) & ~stopped)
        met = ((marks[chosen[open_]] >> i & 1 > 0) & (chosen[open_] != empty)).any(axis=1) if len(marks) else np.zeros(len(open_), dtype=bool)
        open_ = open_[~met]
        free = (best[open_] != empty) & ~(best[open_][:, :, None] == chosen[open_][:, None, :]).any(axis=2)
        go = free.any(axis=1) & (steps[open_] < fixed.MAX_EXPANSIONS)
        stopped[open_[~go]] = True
        open_, free = open_[go], free[go]
        middle = best[open_, free.argmax(axis=1)]
        for side in (-1, 0, 1):
            near = middle + side
            chosen[open_, seeds + 3 * steps[open_] + side + 1] = np.where((near >= first[open_]) & (near < end[open_]), near, empty)
        at_step.append(np.stack([open_, steps[open_]], axis=1))
        names.append(np.full(len(open_), i))
        steps[open_] += 1
    number = seg.to_numpy(zero_copy_only=False)

    def listed(rows: np.ndarray) -> pa.Array:
        """The distinct lines of each row, in order, by number."""
        rows = np.sort(rows, axis=1)
        kept = (rows != empty) & (np.diff(rows, axis=1, prepend=empty) != 0)
        return _lists(kept.sum(axis=1), pa.array(number[rows[kept]].astype(np.int32)))

    at, names = np.concatenate(at_step), np.concatenate(names)
    order = np.lexsort((at[:, 1], at[:, 0]))
    at, names = at[order], names[order]
    near = chosen[at[:, :1], seeds + 3 * at[:, 1:] + np.arange(3)]
    taken = pa.StructArray.from_arrays([pa.array(DUTIES, pa.string()).take(pa.array(names)), listed(near)], ["obligation", "indices"])
    return {"chosen": listed(chosen), "expansions": _lists(steps, taken)}
