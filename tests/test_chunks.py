"""Chunk planning, silence, budgets, fallback, repetition."""

import random

import pytest
from pyspark.sql import functions as F

from test_segments import SEGMENT, segments
from timesift.operators import chunks
from timesift.streaming.folds import budget_step


def plan(spark, duration, size, limit, points, loose=None):
    sources = spark.createDataFrame([(1, float(duration), size)], "source_id int, duration double, bytes long")
    make = lambda p: spark.createDataFrame([(1, float(x)) for x in p], "source_id int, point double")
    got = chunks.chunk_plan(sources, make(points), None if loose is None else make(loose), limit).orderBy("chunk").collect()
    return [(r.offset_s, r.duration_s) for r in got], [r.hard for r in got]


def test_cuts_move_to_near_silences(spark):
    assert plan(spark, 90, 300, 100, [28, 61]) == ([(0.0, 28.0), (28.0, 33.0), (61.0, 29.0)], [False] * 3)
    assert plan(spark, 90, 100, 100, [28]) == ([(0.0, 90.0)], [False])
    assert plan(spark, 90, 300, 100, [28]) == ([(0.0, 28.0), (28.0, 32.0), (60.0, 30.0)], [False, False, True])
    assert plan(spark, 90, 300, 100, [28], loose=[63, 29.9]) == ([(0.0, 29.9), (29.9, 33.1), (63.0, 27.0)], [False] * 3)
    assert plan(spark, 60, 200, 100, [29, 31])[0] == [(0.0, 29.0), (29.0, 31.0)]


def test_silence(spark):
    parts = spark.createDataFrame([(1, 0, 0.0, 60.0), (1, 1, 60.0, 60.0), (1, 2, 120.0, 40.0), (2, 0, 0.0, 9.0)], "source_id int, chunk int, offset_s double, duration_s double")
    quiet = spark.createDataFrame([(1, 0.0, 59.6), (1, 70.0, 110.0), (1, 119.9, float("inf"))], "source_id int, start_s double, end_s double")
    totals = spark.createDataFrame([(1, 150.0), (2, 9.0)], "source_id int, total_s double")
    got = {(r.source_id, r.chunk): (round(r.speech_s, 6), r.silent) for r in chunks.classify_silence(parts, quiet, totals, 25.0).collect()}
    assert got == {(1, 0): (0.4, True), (1, 1): (19.9, False), (1, 2): (0.0, True), (2, 0): (9.0, False)}


def test_overlapping_pairs_are_found_once(spark):
    rng = random.Random(6)
    def some(n, p):
        return [(1, i, a := rng.random() * 200, a + rng.random() * 60) for i in range(n)]
    left, right = some(30, "l"), some(30, "r")
    a = spark.createDataFrame(left, "k int, l int, l_start double, l_end double")
    b = spark.createDataFrame(right, "k int, r int, r_start double, r_end double")
    got = [(x.l, x.r) for x in chunks.overlapping(a, b, ["k"], 17.0).collect()]
    want = [(x[1], y[1]) for x in left for y in right if x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("sizes,limit,sends,allowed", [
    ([40, 60, 1], 100, 0, [True, True, False]), ([40, 61, 1], 100, 0, [True, False, False]),
    ([5, 5, 5], 0, 2, [True, True, False]), ([5, 500], 0, 0, [True, True]), ([100, 0], 100, 0, [True, False]), ([101, 5], 100, 0, [False, False])])
def test_budget_latch(spark, sizes, limit, sends, allowed):
    df = spark.createDataFrame([(1, i + 1, b) for i, b in enumerate(sizes)], "source_id int, ord int, bytes long")
    assert [r.allowed for r in chunks.budget_prefix(df, limit, sends).orderBy("ord").collect()] == allowed
    state, step, got = None, budget_step(limit, sends), []
    for b in sizes:
        out, state = step(state, b)
        got.append(out[0])
    assert got == allowed


@pytest.mark.parametrize("tried,complete,want", [
    ([("a", "success")], True, ("success", "a", 1)), ([("a", "unavailable"), ("b", "success")], True, ("degraded", "b", 2)),
    ([("a", "partial"), ("b", "partial"), ("c", "unavailable")], True, ("partial", "b", 3)), ([("a", "partial"), ("b", "success")], False, ("partial", "a", 1)),
    ([("a", "partial"), ("b", "fatal"), ("c", "success")], True, ("fatal", "b", 2)), ([("a", "no_speech"), ("b", "success")], True, ("no_speech", "a", 1)),
    ([("a", "unavailable")], True, ("unavailable", None, 1))])
def test_fallback(spark, tried, complete, want):
    df = spark.createDataFrame([(1, i + 1, a, s, None) for i, (a, s) in enumerate(tried)], "source_id int, ord int, adapter string, state string, failure_code string")
    r = chunks.fallback_choice(df, complete).first()
    assert (r.state, r.adapter, r.n_attempts) == want


def test_cost_code_survives(spark):
    df = spark.createDataFrame([(1, 1, "a", "unavailable", "remote_cost_limit_exceeded"), (1, 2, "b", "partial", "incomplete_chunks")],
                               "source_id int, ord int, adapter string, state string, failure_code string")
    assert chunks.fallback_choice(df).first().failure_code == "remote_cost_limit_exceeded"


def verdict(spark, texts):
    return chunks.loop_verdict(segments(spark, [(i, i + 1, t) for i, t in enumerate(texts)])).first().verdict


def test_loops(spark):
    assert verdict(spark, ["Thank you."] * 20).startswith("one sentence repeated 20x")
    assert verdict(spark, ["ありがとう。" * 30]).startswith("one sentence repeated 30x")
    assert verdict(spark, ["same line" if i % 4 else f"other {i}" for i in range(60)]) == "one sentence is 45/60"
    assert verdict(spark, ["im sorry " * 30]) == "one 2-word phrase repeated 30x"
    assert verdict(spark, ["la la la land"] * 8 + [f"verse {i}" for i in range(20)]) is None
    assert verdict(spark, ["Thank you."] * 19 + ["bye"]) is None
    assert verdict(spark, ["hello there"] + ["[Music]"] * 50) is None


def test_retention(spark):
    rows = spark.createDataFrame([(1, i, float(i), 1000.0 if i else 5.0, 10) for i in range(8)], "source_id int, item_id int, created_at double, expires_at double, bytes long")
    got = {r.item_id: r.verdict for r in chunks.retention(rows, 10.0, 45, 5, 3).collect()}
    assert got == {0: "expired", 1: "over bytes", 2: "over bytes", 3: "over bytes", 4: "over count", 5: "kept", 6: "kept", 7: "kept"}


def test_outcome_and_receipts(spark):
    df = spark.createDataFrame([(1, False, True, False, False, False), (1, False, False, True, False, False), (2, True, False, False, False, False),
                                (3, False, False, False, True, True)], "source_id int, silent boolean, cached boolean, looped boolean, failed boolean, cost_limited boolean")
    got = {r.source_id: (r.state, r.failure_code) for r in chunks.chunk_outcome(df).collect()}
    assert got == {1: ("partial", "incomplete_chunks"), 2: ("no_speech", None), 3: ("unavailable", "remote_cost_limit_exceeded")}
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    held = spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "key string, good int")
    assert {r.key: r.status for r in chunks.split_by_receipts(work, held, F.col("good") == 1).collect()} == {"a": "reused", "b": "todo", "c": "todo"}


def test_tracks(spark):
    names = ["video.de.vtt", "video.en-orig.vtt", "video.en.vtt", "video.fr.vtt"]
    df = spark.createDataFrame([(1, n) for n in names], "source_id int, name string")
    got = [r.name for r in chunks.preferred_tracks(df, ["fr", "en-US"]).orderBy("rank").collect()]
    assert got == ["video.fr.vtt", "video.en.vtt", "video.en-orig.vtt", "video.de.vtt"]
    assert spark.createDataFrame([], SEGMENT).count() == 0


def test_loops_of_a_record_are_read_once(spark, rows):
    """One reading and one deal of the segments; the same verdicts as for sources of any length."""
    from timesift.plans import all_queries, views

    sf = "/root/testdata/sf0.001"
    made = all_queries()["loop_verdict"](spark, sf)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    segments = views.looped(spark, sf).where("source_id < 100")
    runs = chunks.loop_verdict(segments, one_record=True)
    assert rows.got(runs, "source_id", "verdict") == rows.got(chunks.loop_verdict(segments), "source_id", "verdict")
