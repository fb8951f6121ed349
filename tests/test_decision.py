"""Decisions: rules as rows, refusals that block."""

import pytest

from timesift.functions import fixed
from timesift.operators import decision

GOOD = [("quality.mean", "all", 0.4), ("quality_class.mean", "how", -0.1), ("recall.mean", "all", 0.0), ("recall_class.mean", "how", 0.0),
        ("citation.mean", "all", 0.0), ("completion.excess", "linux", -0.5), ("completion.drop", "linux", 0.0), ("latency.excess", "linux:cold", -1.0),
        ("asr.wer", "all", 0.5), ("asr.language_failed", "all", 0.0), ("asr.boundary_median", "all", 0.25), ("asr.boundary_p95", "all", 1.0),
        ("before_after.failed", "all", 0.0), ("blockers.count", "all", 0.0), ("usage.tokens", "how", 1.02), ("usage.dollars", "how", 1.0),
        ("quality.lower_95", "all", -0.2), ("quality_class.lower_95", "how", -0.49), ("recall.lower_95", "all", 0.0), ("citation.lower_95", "all", 0.0),
        ("tokens.reduction", "targeted", 0.5), ("tokens.reduction", "coverage", 0.25), ("resource.cpu_ms", "linux:cold", 0.0)]


def decided(spark, changes=(), drop=(), split="development", rules=None):
    changed = {(m, s): v for m, s, v in changes}
    rows = [(m, s, changed.pop((m, s), v)) for m, s, v in GOOD if m not in drop] + [(m, s, v) for (m, s), v in changed.items()]
    metrics = spark.createDataFrame(rows, "metric string, scope string, value double")
    got = decision.decide(metrics, decision.rule_table(spark, rules), split).where("role = 'decision'").collect()
    return {r.name: r.holds for r in got}


def test_nine_development_gates_and_promotion(spark):
    got = decided(spark)
    assert got.pop("pareto_promote") and got.pop("no_regression")
    assert got == dict.fromkeys(["quality", "recall", "citation", "before_after", "completion", "latency", "asr", "blockers",
                                 "primary_improvement"], True)


@pytest.mark.parametrize("change, gate", [
    (("quality.mean", "all", -0.26), "quality"), (("quality_class.mean", "why", -0.51), "quality"), (("recall.mean", "all", -0.021), "recall"),
    (("citation.mean", "all", -0.021), "citation"), (("completion.excess", "mac", 0.1), "completion"), (("latency.excess", "mac:warm", 0.1), "latency"),
    (("latency.excess", "mac:warm", float("inf")), "latency"), (("asr.wer", "all", 1.1), "asr"), (("blockers.count", "all", 1.0), "blockers"),
    (("before_after.failed", "all", 2.0), "before_after"), (("recall.mean", "all", None), "recall")])
def test_each_margin_blocks(spark, change, gate):
    got = decided(spark, [change])
    assert not got[gate] and not got["pareto_promote"]


def test_regressions_block_what_gates_let_pass(spark):
    for change in (("recall.mean", "all", -0.011), ("usage.tokens", "how", 1.021), ("usage.calls", "how", 1.001), ("completion.drop", "linux", 1.0),
                   ("resource.cpu_ms", "linux:cold", 0.5)):
        got = decided(spark, [change])
        assert not got["no_regression"] and not got["pareto_promote"]
        assert all(v for k, v in got.items() if k not in ("no_regression", "pareto_promote"))


def test_promotion_asks_for_an_improvement(spark):
    got = decided(spark, [("quality.mean", "all", 0.1), ("tokens.reduction", "targeted", 0.02), ("tokens.reduction", "coverage", 0.02)])
    assert not got["primary_improvement"] and not got["pareto_promote"]
    assert decided(spark, [("quality.mean", "all", 0.0), ("citation_class.mean", "how", 0.02)])["primary_improvement"]


def test_a_required_metric_that_is_absent_fails(spark):
    for metric, gate in (("latency.excess", "latency"), ("recall.mean", "recall"), ("asr.wer", "asr"), ("completion.excess", "completion")):
        assert not decided(spark, drop=[metric])[gate]
    assert decided(spark, drop=["before_after.failed"]).get("before_after", True)


def test_confirmatory_bounds_and_token_gates(spark):
    got = decided(spark, split="confirmatory")
    assert got["targeted_tokens"] and got["coverage_tokens"] and got["pareto_promote"]
    assert not decided(spark, [("quality.lower_95", "all", -0.25)], split="confirmatory")["quality"]  # strictly above
    assert not decided(spark, [("tokens.reduction", "coverage", 0.24)], split="confirmatory")["coverage_tokens"]
    assert not decided(spark, drop=["tokens.reduction"], split="confirmatory")["targeted_tokens"]
    assert not decided(spark, [("completion.drop", "linux", 1.0)], split="confirmatory")["completion"]


def test_a_new_rule_needs_no_code(spark):
    rules = [*fixed.DECISION_RULES, ("any", "gate", "privacy", "privacy.matches", None, "<=", 0.0, True)]
    assert not decided(spark, rules=rules)["privacy"]
    got = decided(spark, [("privacy.matches", "all", 0.0)], rules=rules)
    assert got["privacy"] and got["pareto_promote"]


def test_violations_leave_no_decision(spark):
    schema = "case_id long, question_class string, environment_id string, split string"
    fine = [(1, "how", "linux", "development"), (2, "why", "mac", "development")]
    metrics = spark.createDataFrame(GOOD, "metric string, scope string, value double")
    made = decision.decide(metrics, decision.rule_table(spark))

    def rules_of(rows):
        found = decision.case_violations(spark.createDataFrame(rows, schema), "development", ["how", "why"], ["linux"])
        assert (decision.refuse(made, found).count() == 0) == (found.count() > 0)
        return sorted({r.rule for r in found.collect()})
    assert rules_of(fine) == []
    assert rules_of([*fine, (3, "how", "linux", "confirmatory")]) == ["case outside the evaluation split"]
    assert rules_of([*fine, (3, "how", "linux", None)]) == ["case outside the evaluation split"]
    assert rules_of([*fine, fine[0]]) == ["duplicate canonical case"]
    assert rules_of(fine[1:]) == ["required class not covered", "required environment not covered"]
    assert "no canonical case rows" in rules_of([])


def test_metrics_from_rows(spark):
    cases = spark.createDataFrame([(i, i % 3, "how" if i < 6 else "why") for i in range(9)], "case_id long, family_id long, question_class string")
    scores = spark.createDataFrame([(i, arm, i * (0.5 if arm == "control" else 1.0)) for i in range(9) for arm in ("control", "candidate")]
                                   + [(99, "control", 1.0)], "case_id long, arm string, score double")
    got = {(r.metric, r.scope): r.value for r in decision.quality_metrics(cases, scores, "score", "quality", "development", 1).collect()}
    assert got == {("quality.mean", "all"): 2.0, ("quality_class.mean", "how"): 1.25, ("quality_class.mean", "why"): 3.5}
    bounds = {(r.metric, r.scope): r.value for r in decision.quality_metrics(cases, scores, "score", "quality", "confirmatory", 1).collect()}
    assert bounds[("quality.mean", "all")] == 2.0 and 1.5 <= bounds[("quality.lower_95", "all")] <= 2.0
    assert set(bounds) == {(f"{m}.{s}", c) for m, cs in (("quality", ["all"]), ("quality_class", ["how", "why"])) for s in ("mean", "lower_95") for c in cs}


def test_names_read_together_equal_names_read_alone(spark):
    rows = [(i, i % 3, "how" if i < 6 else "why", None if i == 4 else i * 0.5, 1.0 - i) for i in range(9)]
    deltas = spark.createDataFrame(rows, "case_id long, family_id long, question_class string, quality double, recall double")
    for split in ("development", "confirmatory"):
        both = {tuple(r) for r in decision.delta_metrics(deltas, ["quality", "recall"], split, 3).collect()}
        alone = set()
        for name in ("quality", "recall"):
            scores = deltas.selectExpr("case_id", f"inline(array(struct('control' AS arm, 0.0D AS v), struct('candidate' AS arm, {name} AS v)))")
            alone |= {tuple(r) for r in decision.quality_metrics(deltas, scores, "v", name, split, 3).collect()}
        assert both == alone and {m for m, _, _ in both} >= {"quality.mean", "recall_class.mean"}
