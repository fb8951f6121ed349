"""Operators over sources of one record: the same rows as the operators for sources of any length, without a shuffle of pairs."""

import os
import re
from pathlib import Path

import pytest

from timesift.operators import compiling, evidence, records, retrieval
from timesift.plans import all_queries, evidence_plans, views
from timesift.session import _tables_dir

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """The keys by which the plan deals rows, without those of small broadcast sides."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def pair_shuffles(df):
    return [keys for keys in shuffles(df) if "question_id" in keys and "source_id" in keys]


@pytest.fixture(scope="module")
def inputs(spark):
    return views.questions(spark, SF), views.segments(spark, SF)


def test_lexical_rank(inputs, rows):
    assert rows.got(records.lexical_rank(*inputs)) == rows.got(retrieval.lexical_rank(*inputs))


def test_lexical_rank_of_bound_questions(inputs, rows):
    questions = inputs[0].selectExpr("*", "CASE WHEN question_id % 3 > 0 THEN question_id * 5 END AS source_id")
    got = rows.got(records.lexical_rank(questions, inputs[1]))
    assert got and got == rows.got(retrieval.lexical_rank(questions, inputs[1]))


def test_progressive_expand(inputs, rows):
    ranked = retrieval.lexical_rank(*inputs)
    want = rows.got(retrieval.progressive_expand(ranked, *inputs))
    assert rows.got(retrieval.expand_lists(records.expansion_lists(ranked, inputs[1]), inputs[0])) == want


@pytest.mark.parametrize("name", ["lexical_rank", "uncertainty_flag", "progressive_expand", "span_score", "chapter_rank", "budget_rollup",
                                  "numeric_guard", "facet_coverage", "facet_expansion", "span_rescue", "frame_specs", "spaced_evidence", "unmet_terms"])
def test_pairs_are_made_where_their_source_lies(spark, name):
    assert pair_shuffles(all_queries()[name](spark, SF)) == []


@pytest.fixture(scope="module")
def few(inputs):
    """Some questions over some sources, chosen by both ways: (questions, scout, selection, segments)."""
    questions, segments = inputs[0].where("question_id < 12"), inputs[1].where("source_id < 40")
    scouted = evidence.scout(segments, one_record=True)
    return questions, scouted, evidence.select_targeted(questions, scouted), segments


def test_manifests(few, rows):
    questions, scouted, chosen, segments = few
    got = rows.got(records.manifests(records.select_targeted(questions, records.shelve(segments)), questions))
    assert got and got == rows.got(evidence.manifests(questions, chosen, scouted))


def test_report_lines(few, rows):
    questions, scouted, chosen, segments = few
    shelf = records.stamped(records.shelve(segments))
    got = rows.got(records.report_lines(records.select_targeted(questions, shelf), questions))
    assert got and got == rows.got(evidence.report_lines(questions, chosen, scouted))


@pytest.mark.parametrize("name", ["targeted_evidence", "evidence_manifest", "evidence_report", "fuzzy_rescue"])
def test_targeted_pairs_are_made_where_their_source_lies(spark, name):
    assert pair_shuffles(all_queries()[name](spark, SF)) == []


def test_coverage(inputs, rows):
    segments = inputs[1].where("source_id < 60")
    got = rows.got(records.coverage(segments))
    assert got and got == rows.got(evidence.select_coverage(evidence.scout(segments, one_record=True)))


def test_coverage_writes_no_table(spark):
    home = Path(_tables_dir(spark))
    before = set(home.iterdir()) if home.exists() else set()
    out = all_queries()["coverage_evidence"](spark, SF)
    assert out.columns == ["source_id", "t_start", "t_end", "chapter", "modality", "reason"]
    assert (set(home.iterdir()) if home.exists() else set()) == before


def test_requests_over_a_shelf(spark, rows):
    """Captions in which a chapter of the metadata holds no line, and requests of both kinds with limits of their own."""
    texts = evidence_plans.captions(spark, SF).where("source_id < 25")
    chapters = "array<struct<start_time:string,end_time:string,title:string>>"
    told = spark.createDataFrame([(3, None, [("0", "9", "One"), ("9", "9", "none"), ("x", "1", "bad"), ("9", "900", "")]), (5, 33.0, [])],
                                 f"source_id long, duration double, chapters {chapters}")
    requests = evidence_plans._requests(spark, SF).where("question_id IN (1, 2, 3, 9, 19, 29)")
    general = compiling.compile_requests(requests, compiling.scout_captions(texts, told))
    made = compiling.compile_records(requests, records.shelve_captions(texts, told))
    got = rows.got(compiling.record_rows(made), *sorted(general.rows.columns))
    assert got and got == rows.got(general.rows, *sorted(general.rows.columns))
    assert pair_shuffles(compiling.record_rows(made)) == []
    assert rows.got(compiling.record_manifests(made)) == rows.got(compiling.manifests(general))
