"""Lexical retrieval of many questions over many sources through joins on terms.

Questions meet sources only where a term occurs in both, so no pair is made for nothing.
Each step aggregates before it joins; ``source_id`` is part of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timesift.functions import fixed, text
from timesift.operators.keyed import row_index
from timesift.session import cut_lineage

PAIR = ["question_id", "source_id"]


def facet_table(spark) -> DataFrame:
    """(facet, facet_no, word): the fixed word lists as rows."""
    rows = [(name, no, word) for no, (name, words) in enumerate(fixed.FACETS.items()) for word in words]
    return spark.createDataFrame(rows, "facet string, facet_no int, word string")


def question_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term, n, first_at): how often a term is asked for."""
    terms = questions.select("question_id", F.posexplode(text.evidence_tokens(F.col("text"))).alias("at", "term"))
    return terms.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


def with_tokens(spans: DataFrame) -> DataFrame:
    return spans.withColumn("tokens", text.evidence_tokens(F.col("text")))


def facet_fires(terms: DataFrame, facets: DataFrame) -> DataFrame:
    """(question_id, facet, facet_no) for each facet a question names."""
    return terms.join(facets, terms["term"] == facets["word"]).select("question_id", "facet", "facet_no").distinct()


def term_weights(terms: DataFrame, fires: DataFrame, facets: DataFrame) -> DataFrame:
    """(question_id, term, weight): asked terms count twice, words of named facets once each."""
    asked = terms.select("question_id", text.normalize_token(F.col("term")).alias("term"),
                         (F.col("n") * fixed.QUESTION_TERM_WEIGHT).alias("w"))
    listed = fires.join(facets.select("facet", "word"), "facet").select(
        "question_id", text.normalize_token(F.col("word")).alias("term"), F.lit(1).alias("w"))
    return asked.unionByName(listed).groupBy("question_id", "term").agg(F.sum("w").alias("weight"))


def bindings(questions: DataFrame) -> DataFrame | None:
    """(question_id, source_id) of the questions that ask one source only."""
    if "source_id" not in questions.columns:
        return None
    return questions.where("source_id IS NOT NULL").select("question_id", "source_id")


def bind(weights: DataFrame, bound: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Weights of the questions that search all sources, and those of the others with their source."""
    if bound is None:
        return weights, None
    return weights.join(bound, "question_id", "left_anti"), weights.join(bound, "question_id").select(*PAIR, "term", "weight")


def asked_of(rows: DataFrame, bound: DataFrame | None) -> DataFrame:
    """Rows ``(question_id, source_id, ...)`` without those of a source that the question does not ask."""
    if bound is None:
        return rows
    only = bound.withColumnRenamed("source_id", "__only")
    return rows.join(only, "question_id", "left").where("__only IS NULL OR __only = source_id").drop("__only")


def term_parts(spans: DataFrame, wanted: DataFrame, in_source: DataFrame | None = None) -> DataFrame:
    """(source_id, span_id, chapter_id, n_tokens, term, part) of the wanted terms.

    ``part`` is tf times the inverse span frequency within the source. ``in_source`` holds terms that are wanted
    in one source only: what questions bound to a source read does not grow with the corpus.
    """
    everywhere = wanted.select("term").distinct()
    words = spans.select("source_id", "span_id", "chapter_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("term"))
    found = words.join(everywhere, "term", "left_semi")
    if in_source is not None:
        there = in_source.select("source_id", "term").distinct().join(everywhere, "term", "left_anti")
        found = found.unionByName(words.join(there, ["source_id", "term"], "left_semi").select(*found.columns))
    tf = found.groupBy("source_id", "span_id", "chapter_id", "n_tokens", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut_lineage(tf)  # read twice: for the span frequency and for the parts
    sizes = spans.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_spans"))
    rarity = tf.groupBy("source_id", "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, "source_id").select(
        "source_id", "term", F.ln(1 + F.col("n_spans") / (1 + F.col("df"))).alias("rarity"))
    return tf.join(rarity, ["source_id", "term"]).select(
        "source_id", "span_id", "chapter_id", "n_tokens", "term", (F.col("tf") * F.col("rarity")).alias("part"))


def span_scores(parts: DataFrame, weights: DataFrame, pair_weights: DataFrame | None = None,
                by: str = "question_id") -> DataFrame:
    """(question_id, source_id, span_id, chapter_id, score), positive scores only.

    ``pair_weights`` holds weights that a question has in one source only.
    """
    hits = parts.join(weights, "term")
    if pair_weights is not None:
        hits = hits.unionByName(parts.join(pair_weights, ["source_id", "term"]))
    total = F.sum(F.col("part") * F.col("weight")) / (1 + F.ln(1 + F.col("n_tokens")))
    return hits.groupBy(by, "source_id", "span_id", "chapter_id", "n_tokens").agg(
        F.round(total, 6).alias("score")).drop("n_tokens").where("score > 0")


def chapter_ranks(scores: DataFrame) -> DataFrame:
    """(pair, chapter_id, best, top_two, rank from 0) by best span, then best two, then order."""
    inside = Window.partitionBy(*PAIR, "chapter_id").orderBy(F.desc("score"), "span_id")
    best_two = scores.withColumn("__r", F.row_number().over(inside)).where("__r <= 2")
    tops = best_two.groupBy(*PAIR, "chapter_id").agg(
        F.max("score").alias("best"), F.round(F.sum("score"), 6).alias("top_two"))
    return row_index(cut_lineage(tops), PAIR, [F.desc("best"), F.desc("top_two"), F.col("chapter_id")],
                     -F.floor(F.col("best") * 10), "rank").withColumn("rank", F.col("rank").cast("int"))


def _edit_keys(word: Column) -> Column:
    """The word and all its one-letter deletions: two words one edit apart share a key."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def near_words(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, match) with edit distance of at most one, over distinct words, by equal deletion keys."""
    left = terms.select("term").distinct().select("term", F.explode(_edit_keys(F.col("term"))).alias("k"))
    right = vocabulary.select(F.col("token").alias("match")).distinct().select(
        "match", F.explode(_edit_keys(F.col("match"))).alias("k"))
    return left.join(right, "k").where(F.levenshtein("term", "match", 1) >= 0).select("term", "match").distinct()


def fuzzy_rescue(terms: DataFrame, spans: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """(question_id, source_id, term, match, note_no): asked words of five letters or more that a
    source never has, and its first word (in order) one edit away; questions of ``bound`` ask their source only."""
    asked = terms.where(F.length("term") >= fixed.FUZZY_MIN_LEN)
    near = near_words(asked, spans.select(F.explode("tokens").alias("token")).where(
        F.length("token") >= fixed.FUZZY_MIN_LEN - 1))
    wanted = near.select(F.col("match").alias("token")).union(near.select("term")).distinct()
    present = spans.select("source_id", F.explode("tokens").alias("token")).join(
        wanted, "token", "left_semi").distinct()
    found = present.join(near, F.col("token") == F.col("match")).groupBy("source_id", "term").agg(
        F.min("match").alias("match"))
    missing = found.join(present.withColumnRenamed("token", "term"), ["source_id", "term"], "left_anti")
    order = Window.partitionBy(*PAIR).orderBy("first_at")
    return asked_of(missing.join(asked, "term"), bound).select(
        *PAIR, "term", "match", "n", "first_at", F.row_number().over(order).alias("note_no"))


def _digit_keys(value: Column, full: bool) -> Column:
    runs = F.regexp_extract_all(value, F.lit(r"(?U)\d{2}"), F.lit(0))
    if not full:
        return F.coalesce(F.get(runs, F.lit(0)), F.regexp_extract(value, r"(?U)\d", 0))
    odd = F.regexp_extract_all(value, F.lit(r"(?U)\d(?=(\d))"), F.lit(0))
    nxt = F.regexp_extract_all(value, F.lit(r"(?U)\d(?=(\d))"), F.lit(1))
    return F.array_distinct(F.concat(F.zip_with(odd, nxt, lambda a, b: F.concat(a, b)),
                                     F.regexp_extract_all(value, F.lit(r"(?U)\d"), F.lit(0))))


def lexical_rank(questions: DataFrame, segments: DataFrame, limit: int = fixed.LEXICAL_LIMIT) -> DataFrame:
    """(pair, seg_idx, start_s, score, rank from 1): exact tokens, named numbers, shared negation.

    A question with a ``source_id`` is met with that source alone; one without searches all sources.
    """
    bound = bindings(questions)
    docs = segments.select("source_id", "seg_idx", "start_s", "text", text.exact_tokens(F.col("text")).alias("tokens"))
    asked = questions.select("question_id", "text", F.array_distinct(text.exact_tokens(F.col("text"))).alias("terms"))
    terms = asked.select("question_id", F.explode("terms").alias("term"))
    free, own = bind(terms.withColumn("weight", F.lit(1)), bound)
    everywhere = free.select("term").distinct()
    words = docs.select("source_id", "seg_idx", F.explode("tokens").alias("term"))
    found = words.join(everywhere, "term", "left_semi")
    if own is not None:
        there = own.select("source_id", "term").distinct().join(everywhere, "term", "left_anti")
        found = found.unionByName(words.join(there, ["source_id", "term"], "left_semi").select(*found.columns))
    tf = found.groupBy("source_id", "seg_idx", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = cut_lineage(tf)
    sizes = segments.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_segs"))
    rarity = tf.groupBy("source_id", "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, "source_id").select(
        "source_id", "term", F.ln((F.col("n_segs") + 1) / (F.col("df") + 0.5)).alias("rarity"))
    impacts = tf.join(rarity, ["source_id", "term"]).select(
        "source_id", "seg_idx", "term", ((1 + F.ln("tf")) * F.col("rarity")).alias("part"))
    by_term = impacts.join(free, "term").select(*PAIR, "seg_idx", "part")
    if own is not None:
        by_term = by_term.unionByName(impacts.join(own, ["source_id", "term"]).select(*PAIR, "seg_idx", "part"))

    values = asked.select("question_id", F.explode(text.numbers(F.col("text"))).alias("v")).select(
        "question_id", F.lower("v").alias("value")).withColumn("k", _digit_keys(F.col("value"), False))
    digits = docs.where(F.col("text").rlike(r"(?U)\d")).select("source_id", "seg_idx", F.lower("text").alias("low"))
    by_number = digits.withColumn("k", F.explode(_digit_keys(F.col("low"), True))).join(values, "k").where(
        F.contains("low", "value")).select(*PAIR, "seg_idx", F.lit(2.0).alias("part"))

    negating = text.strings(fixed.NEGATION)
    denied = asked.where(F.arrays_overlap("terms", negating)).select("question_id")
    # A negating segment that matches nothing else scores 1, so only the earliest ``limit`` of a
    # source can still be ranked; those that do match come through the other branches.
    negated = docs.where(F.arrays_overlap("tokens", negating)).select(
        "source_id", "seg_idx", "start_s", F.array_intersect("tokens", negating).alias("words"))
    early = Window.partitionBy("source_id").orderBy("start_s", "seg_idx")
    first_ones = negated.withColumn("__r", F.row_number().over(early)).where(F.col("__r") <= limit).select(
        "source_id", "seg_idx", F.get("words", F.lit(0)).alias("word"))
    matched = by_term.unionByName(asked_of(by_number, bound))
    lone = asked_of(denied.select("question_id", F.explode(negating).alias("word")).join(first_ones, "word"), bound).select(
        *PAIR, "seg_idx")
    scored = matched.unionByName(lone.withColumn("part", F.lit(0.0))).groupBy(*PAIR, "seg_idx").agg(
        F.sum("part").alias("part"))
    both = scored.join(denied.withColumn("__q", F.lit(1.0)), "question_id", "left").join(
        negated.select("source_id", "seg_idx", F.lit(1.0).alias("__s")), ["source_id", "seg_idx"], "left")
    total = F.col("part") + F.coalesce(F.col("__q") * F.col("__s"), F.lit(0.0))
    ranked = both.select(*PAIR, "seg_idx", F.round(total, 6).alias("score")).where("score > 0").join(
        segments.select("source_id", "seg_idx", "start_s"), ["source_id", "seg_idx"])
    order = Window.partitionBy(*PAIR).orderBy(F.desc("score"), "start_s", "seg_idx")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(
        *PAIR, "seg_idx", "start_s", "score", "rank")


def claim_conflicts(segments: DataFrame) -> DataFrame:
    """(source_id, subject, value, n_segments) where one subject carries several numbers."""
    words = F.filter(text.exact_tokens(F.col("text")), lambda t: ~t.isin(fixed.NEGATION))
    named = segments.select(
        "source_id", "seg_idx", F.substring(F.array_join(words, " "), 1, 80).alias("subject"),
        F.explode(text.numbers(F.col("text"))).alias("number"))
    claims = named.groupBy("source_id", "subject", F.lower("number").alias("value")).agg(
        F.count(F.lit(1)).alias("n_segments"))
    several = claims.groupBy("source_id", "subject").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return claims.join(several, ["source_id", "subject"], "left_semi")


def rank_fusion(rankings: DataFrame, keys: list[str], k: int = fixed.RANK_FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of rows ``(keys, item, rank from 1)``."""
    return rankings.groupBy(*keys, "item").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"))


def doubtful(first: Column, second: Column, duties: Column) -> Column:
    """Nothing was ranked, the ``second`` score is close to the ``first``, or more than two obligations."""
    close = F.coalesce((first > 0) & (second / first >= 0.92), F.lit(False))
    return first.isNull() | close | (duties > 2)


def uncertainty(ranked: DataFrame, questions: DataFrame, segments: DataFrame) -> DataFrame:
    """(pair, uncertain) of each question and each source of ``segments`` that it searches: nothing was ranked, the top two are close,
    or more than two obligations."""
    tops = ranked.where("rank <= 2").groupBy(F.col("question_id").alias("__q"), F.col("source_id").alias("__s")).agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    duties = questions.where("question_id IS NOT NULL").select("question_id", F.size(text.obligations(F.col("text"))).alias("duties"))
    pairs = asked_of(segments.select("source_id").distinct().crossJoin(duties), bindings(questions))
    told = pairs.join(tops, (F.col("question_id") == F.col("__q")) & F.col("source_id").eqNullSafe(F.col("__s")), "left")
    return told.select(*PAIR, doubtful(F.col("a"), F.col("b"), F.col("duties")).alias("uncertain"))


def expansion_rows(ranked: DataFrame, segments: DataFrame) -> DataFrame:
    """Ranked rows with the text of the row and its two neighbours (at most ``limit`` per pair)."""
    near = ranked.withColumn("at", F.explode(F.array(F.col("seg_idx") - 1, F.col("seg_idx"), F.col("seg_idx") + 1)))
    return near.join(segments.select("source_id", F.col("seg_idx").alias("at"), "text"), ["source_id", "at"]).groupBy(
        *PAIR, "seg_idx", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("around"))


def progressive_expand(ranked: DataFrame, questions: DataFrame, segments: DataFrame,
                       seeds: int = fixed.LEXICAL_SEEDS) -> DataFrame:
    """(pair, chosen ARRAY, expansions ARRAY<STRUCT<obligation, indices>>).

    A pair holds at most the ranked rows with their neighbours, so one array per pair is small.
    Each unmet obligation takes the best ranked row outside what is chosen, with its neighbours.
    """
    rows = expansion_rows(ranked, segments).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("rank", "seg_idx", "around"))).alias("ranked"))
    return expand_lists(rows, questions, seeds)


def expand_lists(rows: DataFrame, questions: DataFrame, seeds: int = fixed.LEXICAL_SEEDS) -> DataFrame:
    """``progressive_expand`` from ``(pair, ranked ARRAY<STRUCT<rank, seg_idx, around>>)``."""
    joined = rows.join(questions.select("question_id", text.obligations(F.col("text")).alias("duties")), "question_id")
    seg_type = "array<struct<at:int,text:string>>"
    start = F.flatten(F.transform(F.filter("ranked", lambda r: r["rank"] <= seeds), lambda r: F.filter(
        r["around"], lambda a: a["at"] == r["seg_idx"]))).cast(seg_type)
    empty = F.array().cast("array<struct<obligation:string,indices:array<int>>>")
    state = F.struct(F.array_distinct(start).alias("chosen"), empty.alias("steps"), F.lit(False).alias("stopped"))

    def any_word(low: Column, words: list[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        return hit

    def satisfied(duty: Column, chosen: Column) -> Column:
        low = F.lower(F.array_join(F.transform(F.array_sort(chosen), lambda a: a["text"]), " "))
        return (F.when(duty == "answer", F.size(chosen) > 0).when(duty == "exact-number", low.rlike(fixed.NUMBER))
                .when(duty == "negation", F.arrays_overlap(text.exact_tokens(low), text.strings(fixed.NEGATION)))
                .when(duty == "before-state", any_word(low, fixed.BEFORE_WORDS))
                .otherwise(any_word(low, fixed.AFTER_WORDS)))

    def step(acc: Column, duty: Column) -> Column:
        taken = F.transform(acc["chosen"], lambda a: a["at"])
        best = F.get(F.filter(F.col("ranked"), lambda r: ~F.array_contains(taken, r["seg_idx"])), F.lit(0))
        met = satisfied(duty, acc["chosen"])
        halt = ~met & (best.isNull() | (F.size(acc["steps"]) >= fixed.MAX_EXPANSIONS))
        go = ~met & ~halt & ~acc["stopped"]
        added = F.struct(duty.alias("obligation"), F.transform(best["around"], lambda a: a["at"]).alias("indices"))
        return F.struct(
            F.when(go, F.array_distinct(F.concat(acc["chosen"], best["around"].cast(seg_type)))).otherwise(acc["chosen"]).alias("chosen"),
            F.when(go, F.concat(acc["steps"], F.array(added))).otherwise(acc["steps"]).alias("steps"),
            (acc["stopped"] | halt).alias("stopped"))

    return joined.withColumn("__s", F.aggregate("duties", state, step)).select(
        *PAIR, F.array_sort(F.transform(F.col("__s.chosen"), lambda a: a["at"])).alias("chosen"),
        F.col("__s.steps").alias("expansions"))
