"""Lines ranked in the row of their source: the same rows as by joins on terms, and every pair where all are asked for."""

import pytest

from timesift.operators import ranking, records, retrieval

LINES = [(1, 0, 0.0, "The red fox runs"), (1, 1, 2.0, "not a fox at 42 ms"), (1, 2, 4.0, "then the fox sleeps"), (1, 3, 6.0, "never 1,042 ms"),
         (1, 4, 8.0, "without words"), (2, 0, 0.0, "blue sky"), (2, 1, 1.0, "blue sky"), (2, 2, 2.0, "no fox, first"), (3, 0, 0.0, "Unrelated"),
         (4, 1, 5.0, "fox one"), (4, 0, 5.0, "fox two")]
ASKED = [(7, "which fox"), (8, "fox not seen after 42 ms"), (9, "blue sky"), (9, "blue sky"), (10, "quite absent"), (11, ""), (12, None), (13, "10 42 042"),
         (None, "fox")]


@pytest.fixture(scope="module")
def inputs(spark):
    segments = spark.createDataFrame(LINES, "source_id long, seg_idx int, start_s double, text string")
    return spark.createDataFrame(ASKED, "question_id long, text string"), segments


@pytest.mark.parametrize("cells, limit", [(1 << 20, 16), (1, 16), (1 << 20, 2)])
def test_lines_equal_those_of_joins(inputs, rows, monkeypatch, cells, limit):
    monkeypatch.setattr(ranking, "CELLS", cells)
    got = rows.got(records.lexical_rank(*inputs, limit))
    assert len(got) > 10 and got == rows.got(retrieval.lexical_rank(*inputs, limit))


def test_blocks_of_questions(inputs, rows):
    pairs = ranking.lexical(ranking.record_lines(inputs[1]), inputs[0], per_block=3)
    assert rows.got(pairs) == rows.got(ranking.lexical(ranking.record_lines(inputs[1]), inputs[0]))


def test_no_question_and_no_line(spark, inputs):
    assert records.lexical_rank(inputs[0].limit(0), inputs[1]).count() == 0
    assert records.lexical_rank(inputs[0], inputs[1].limit(0)).count() == 0
    assert records.uncertainty(inputs[0].limit(0), inputs[1]).count() == 0


@pytest.mark.parametrize("bound", [False, True])
def test_what_nothing_matches_is_uncertain(inputs, rows, bound):
    """A question and a source without a ranked line are a pair, and an uncertain one."""
    questions, segments = inputs
    if bound:
        questions = questions.distinct().selectExpr("*", "CASE WHEN question_id % 2 = 1 THEN 2 END AS source_id")
    got = rows.got(records.uncertainty(questions, segments))
    assert got == rows.got(retrieval.uncertainty(retrieval.lexical_rank(questions, segments), questions, segments))
    told = {(q, s): u for q, s, u in got}
    assert told[10, 1] and told[10, 3] and told[12, 2 if bound else 1]
    assert bound or not told[7, 2] and told[8, 3] and len(got) == 4 * 8
    assert not bound or {s for q, s, _ in got if q == 9} == {2}


@pytest.mark.parametrize("cells, seeds", [(1 << 20, 8), (1, 1), (1 << 20, 2)])
def test_expansions_equal_those_of_joins(spark, rows, monkeypatch, cells, seeds):
    """Obligations that are met, that one neighbour meets and that nothing meets, at both ends of a source."""
    monkeypatch.setattr(ranking, "CELLS", cells)
    texts = ["fox", "fox fox", "plain", "fox 7 ms", "fox", "never", "fox initial", "fox", "and finally", "fox fox fox"]
    lines = [(s, i, float(i), t) for s in (1, 2) for i, t in enumerate(texts[s - 1:][:8 + s])] + [(3, 0, 0.0, "fox"), (4, 0, 0.0, "sky")]
    segments = spark.createDataFrame(lines, "source_id long, seg_idx int, start_s double, text string")
    questions = spark.createDataFrame([(1, "fox"), (2, "no fox before 9 ms"), (3, "fox then"), (4, "not fox"), (5, "next 7"), (5, "fox 3")], "question_id long, text string")
    want = retrieval.progressive_expand(retrieval.lexical_rank(questions, segments), questions, segments, seeds)
    got = rows.got(records.progressive_expand(questions, segments, seeds))
    assert (seeds == 8 or any(r[3] for r in got)) and got == rows.got(want)
