"""Paired evaluation: the golden cases, gates, agreement."""

import math
import random

import pytest
from pyspark.sql import functions as F

from timesift.operators import evaluation as ev

JUDGE = "case_id string, arm string, correctness int, completeness int, citation int, adherence int, refused boolean"


def golden(spark):
    judged = []
    for case, arm, score, refused in [("overlap", "control", 8, False), ("overlap", "candidate", 9, False), ("candidate-failure", "control", 8, False),
                                      ("control-failure", "candidate", 7, False), ("refusal", "control", 0, True), ("refusal", "candidate", 0, True)]:
        judged += [(case, arm, score, score, score, score, refused)] * 2
    cases = spark.createDataFrame([("overlap", "a", False, False, False), ("candidate-failure", "a", False, True, False), ("control-failure", "b", True, False, False),
                                   ("both-failure", "c", False, False, True), ("refusal", "c", False, False, False)],
                                  "case_id string, family_id string, control_failure boolean, candidate_failure boolean, both_failure boolean")
    return cases, spark.createDataFrame(judged, JUDGE)


def test_golden_family_deltas(spark):
    cases, judged = golden(spark)
    got = {r.family_id: round(r.delta, 12) for r in ev.family_deltas(ev.case_deltas(cases, ev.arm_scores(judged))).collect()}
    assert got == {"a": -3.5, "b": 7.0, "c": 0.0}


def test_bootstrap_repeats_the_fixed_generator(spark):
    deltas = {"a": -3.5, "b": 7.0, "c": 0.0}
    rng = random.Random(17)
    names = sorted(deltas)
    means = sorted(sum(deltas[rng.choice(names)] for _ in names) / 3 for _ in range(10_000))
    df = spark.createDataFrame([("m", k, v) for k, v in deltas.items()], "metric string, family_id string, delta double")
    r = ev.bootstrap_exact(df, 17).first()
    assert (r.n, r.mean, r.lower_95) == (3, sum(deltas.values()) / 3, means[499])
    many = {str(i): i * 0.25 for i in range(130)}  # one generator, whatever the size
    rng, keys = random.Random(17), sorted(many)
    want = sorted(sum(many[rng.choice(keys)] for _ in keys) / 130 for _ in range(10_000))[499]
    mixed = df.unionByName(spark.createDataFrame([("big", k, v) for k, v in many.items()], df.schema))
    got = {x.metric: x for x in ev.bootstrap_exact(mixed, 17).collect()}
    assert got["m"].lower_95 == r.lower_95 and got["big"].n == 130 and abs(got["big"].lower_95 - want) < 1e-9
    d = ev.bootstrap_drawn(df, 17).first()
    assert d.n == 3 and min(deltas.values()) <= d.lower_95 <= d.mean


def test_evidence_match_on_the_golden_case(spark):
    schema = "case_id int, item_id int, kind string, start_s double, end_s double"
    gold = spark.createDataFrame([(1, 1, "interval", 0.0, 10.0), (1, 2, "point", 20.0, 20.0), (2, 1, "point", 5.0, 5.0)], schema)
    picked = spark.createDataFrame([(1, 1, "interval", 0.0, 5.0), (1, 2, "point", 21.0, 21.0), (2, 1, "point", 7.5, 7.5)], schema)
    got = {r.case_id: (r.recall, r.temporal_iou) for r in ev.evidence_match(gold, picked).collect()}
    assert got == {1: (1.0, 0.5), 2: (0.0, 1.0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_evidence_match_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    def some(n):
        return [(1, i, "point", a, a) if rng.random() < 0.5 else (1, i, "interval", a, a + rng.random() * 90) for i in range(n) for a in [round(rng.random() * 500, 2)]]
    gold, picked = some(25), some(25)
    hits, ious = 0, []
    for _, _, kind, a, b in gold:
        if kind == "point":
            hits += any(abs(p[3] - a) <= 2 if p[2] == "point" else p[3] <= a <= p[4] for p in picked)
        else:
            best = max((max(0.0, min(b, p[4]) - max(a, p[3])) / (max(b, p[4]) - min(a, p[3])) for p in picked if p[2] == "interval"), default=0.0)
            ious.append(best)
            hits += best >= 0.25
    schema = "case_id int, item_id int, kind string, start_s double, end_s double"
    r = ev.evidence_match(spark.createDataFrame(gold, schema), spark.createDataFrame(picked, schema), width=30.0).first()
    assert math.isclose(r.recall, hits / 25) and math.isclose(r.temporal_iou, sum(ious) / len(ious))


def test_latency(spark):
    def arms(**values):
        return spark.createDataFrame([("e", arm, float(v)) for arm, vs in values.items() for v in vs], "env string, arm string, ms double")
    ok = ev.latency_gates(arms(noop=[10] * 30, control=[100] * 30, candidate=[102] * 30), ["env"]).first()
    assert (ok.allowance, ok.median_delta, ok["pass"]) == (5.0, 2.0, True)
    slow = ev.latency_gates(arms(noop=[10] * 30, control=[100] * 30, candidate=[100] * 28 + [120] * 2), ["env"]).first()
    assert (slow.median_delta, slow.p95_delta, slow["pass"]) == (0.0, 20.0, False)
    few = ev.latency_gates(arms(noop=[10] * 29, control=[100] * 30, candidate=[100] * 30), ["env"]).first()
    assert not few["pass"]


def test_reduction_before_after_kappa(spark):
    rows = spark.createDataFrame([("t", arm, v) for arm, vs in (("control", [100, 90, 120]), ("candidate", [40, 41, 39])) for v in vs], "c string, arm string, v int")
    assert ev.token_reduction(rows, ["c"], "v").first().reduction == 0.6
    times = spark.createDataFrame([(1, 1.0), (1, 9.0), (2, 9.0), (3, 8.0), (3, 1.0)], "case_id int, t double")
    assert {r.case_id: r.matched for r in ev.before_after(times, (0.0, 2.0), (8.0, 10.0)).collect()} == {1: True, 2: False, 3: True}
    votes = spark.createDataFrame([(i, i % 2, i % 2, (i + (i % 10 == 0)) % 2) for i in range(30)] + [(99, 0, 1, 1)], "case_id int, human_a int, human_b int, grader int")
    r = ev.kappa(votes).first()
    # 27 of 30 agree; chance is .5 * (12 + 18) / 30.
    assert r.dual_cases == 30 and math.isclose(r.accuracy, 0.9) and math.isclose(r.kappa, 0.8) and r.validated


def test_pairs_and_attempts(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    rows = spark.createDataFrame([(1, "control"), (1, "candidate"), (2, "control"), (2, "control"), (9, "control"), (3, "odd")], "case_id int, arm string")
    got = {(r.case_id, r.rule) for r in ev.pair_violations(rows, cases).collect()}
    assert got == {(2, "duplicate paired rows"), (2, "lacks paired rows"), (9, "unrelated case"), (3, "invalid arm"), (3, "lacks paired rows")}
    runs = spark.createDataFrame([("x", "control", 1, 1), ("x", "control", 3, 1), ("x", "candidate", 1, 2)], "case_id string, arm string, attempt int, order int")
    rules = {(r.arm, r.rule) for r in ev.attempt_violations(runs).collect()}
    assert ("control", "dropped attempt") in rules


def test_completion_uses_the_last_attempt(spark):
    cases = spark.createDataFrame([(1, "e"), (2, "e")], "case_id int, environment_id string")
    runs = spark.createDataFrame([(1, "control", 1, "fatal"), (1, "control", 2, "success"), (1, "candidate", 1, "fatal"), (2, "control", 1, "degraded"), (2, "candidate", 1, "success")],
                                 "case_id int, arm string, attempt int, state string")
    r = ev.completion(cases, runs).first()
    assert (r.total, r.control, r.candidate) == (2, 2, 1)


def test_pareto(spark):
    rows = spark.createDataFrame([("a", "recall", 1.0, 1.0), ("a", "wall", 5.0, 4.0), ("b", "recall", 1.0, 0.9), ("b", "wall", 5.0, 6.0)], "k string, metric string, control double, candidate double")
    got = {r.k: (r.no_worse, r.regressions) for r in ev.pareto({"recall": "up", "wall": "down"}, rows, ["k"]).collect()}
    assert got == {"a": (True, ""), "b": (False, "recall|wall")}
    assert rows.where(F.col("k") == "a").count() == 2


def test_a_sheet_holds_both_arms_of_a_case_in_one_row(spark):
    rows = [(1, "control", 5, False), (1, "control", 7, False), (1, "control", 9, True), (1, "candidate", 4, False), (2, "candidate", 3, True),
            (3, "odd", 1, False), (3, None, 1, False)]
    judged = spark.createDataFrame(rows, "case_id long, arm string, citation int, refused boolean").withColumns(
        {c: F.col("citation") for c in ("correctness", "completeness", "adherence")})
    sheet = {r.case_id: r for r in ev.case_sheet(judged, lambda own: ev.score_means(own) | {"n": F.count_if(own)}).collect()}
    alone = {(r.case_id, r.arm): (r.score, r.citation) for r in ev.arm_scores(judged).collect()}
    assert set(sheet) == {1, 2, 3} and sheet[3].control is None and sheet[3].candidate is None and sheet[2].control is None
    for case, arm, n in ((1, "control", 3), (1, "candidate", 1), (2, "candidate", 1)):
        assert tuple(sheet[case][arm]) == (*alone[case, arm], n)
