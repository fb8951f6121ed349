"""Spans and chapters ranked in the row of their source: the same pairs as by joins on terms."""

import os

import pytest
from pyspark.sql import functions as F

from timesift.operators import ranking, records
from timesift.plans import all_queries

SF = "/root/testdata/sf0.001"
SPANS = "source_id long, spans array<struct<span_id:int,chapter_id:int,tokens:array<string>>>"
SHELVES = [(1, [(0, 0, ["red", "fox", "red"]), (1, 0, ["blue"]), (2, 1, ["red", "fox", "red"]), (3, 3, [])]),
           (2, [(0, 2, ["blue", "sky"]), (1, 2, ["blue", "sky"]), (2, 2, ["blue"])]),
           (3, [(0, 0, ["none"])]), (4, []), (5, None)]
WEIGHTS = [(7, "red", 2), (7, "sky", 1), (8, "blue", 4), (8, "fox", 2), (9, "never", 2)]


def listed(pairs):
    return sorted((r["question_id"], r["source_id"], [(c["chapter_id"], c["best"], c["top_two"], [tuple(h) for h in c["hits"]]) for c in r["ranked"]])
                  for r in pairs.select("question_id", "source_id", "ranked").collect())


@pytest.mark.parametrize("cells, per_block", [(1 << 20, 100), (1, 100), (1 << 20, 1)])
def test_pairs_equal_those_of_joins(spark, monkeypatch, cells, per_block):
    monkeypatch.setattr(ranking, "CELLS", cells)
    shelf = spark.createDataFrame(SHELVES, SPANS)
    weights = spark.createDataFrame(WEIGHTS, "question_id long, term string, weight long")
    want = listed(records.ranked_pairs(records.span_scores(records.term_parts(shelf, weights), weights)))
    assert len(want) == 4 and want[0][2][0][2] < 2 * want[0][2][0][1]
    assert listed(ranking.ranked(shelf, weights, hits=True, per_block=per_block)) == want


def test_no_question(spark):
    shelf = spark.createDataFrame(SHELVES, SPANS)
    none = spark.createDataFrame([], "question_id long, term string, weight long")
    assert ranking.ranked(shelf, none).count() == 0


def test_no_row_is_made_for_a_span_and_a_question(spark):
    """A source is ranked in its own row: nothing is dealt, sorted or grouped, and it is ranked once."""
    shelf = spark.createDataFrame(SHELVES, SPANS)
    weights = spark.createDataFrame(WEIGHTS, "question_id long, term string, weight long")
    plan = ranking.ranked(shelf, weights).where(F.size("ranked") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and not any(x in plan for x in ("Exchange", "Sort", "Aggregate", "Join"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["chapter_rank", "budget_rollup", "facet_coverage", "frame_specs"])
def test_a_shelf_read_once_is_not_written(spark, name):
    """Only the weights of the words are written, and lines are dealt by source alone."""
    plan = all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "titled:array" not in plan and "tokens:array" not in plan
    assert plan.count("Exchange hashpartitioning(source_id") == 1 and "documents.parquet" in plan


@pytest.mark.parametrize("cells, per_block", [(1 << 20, 100), (1, 100), (1 << 20, 1)])
def test_weights_of_one_source(spark, monkeypatch, cells, per_block):
    """Words that weigh in one source only, beside the same words elsewhere, of no question and of no span."""
    monkeypatch.setattr(ranking, "CELLS", cells)
    shelf = spark.createDataFrame(SHELVES, SPANS)
    weights = spark.createDataFrame(WEIGHTS, "question_id long, term string, weight long")
    own = spark.createDataFrame([(1, [(7, "blue", 2), (8, "red", 1), (7, "red", 3), (7, "absent", 9)]), (3, [(9, "none", 4), (7, "sky", 1)]), (4, [(7, "red", 1)]), (5, None)],
                                "source_id long, own array<struct<question_id:long,term:string,weight:long>>")
    wanted = spark.createDataFrame([(t,) for t in ("red", "sky", "blue", "fox", "never", "none", "absent")], "term string")
    want = listed(records.ranked_pairs(records.span_scores(records.term_parts(shelf, wanted), weights, own)))
    assert len(want) == 5
    assert listed(ranking.ranked(shelf.join(own, "source_id", "left"), weights, hits=True, own="own", per_block=per_block)) == want
