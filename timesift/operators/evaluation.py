"""Paired experiments: matching, deltas, bootstrap bounds, gates, agreement.

Order statistics go through ``order_statistics``, so a cell of a few keys may hold any number of
rows. Everything else is grouping that combines before the shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timesift.functions import fixed, identity, measures
from timesift.operators.chunks import overlapping
from timesift.operators.keyed import order_statistics, row_index
from timesift.session import cut_lineage

CASE_ARM = ["case_id", "arm"]
GOOD = ["success", "degraded"]


def evidence_match(gold: DataFrame, selected: DataFrame, tolerance: float = 2.0, width: float = 3600.0) -> DataFrame:
    """(case_id, recall, temporal_iou) of ``(case_id, item_id, kind, start_s, end_s)`` rows.

    A point has equal bounds. A gold point is hit by a point within the tolerance or an interval
    around it, a gold interval by an interval of at least a quarter overlap.
    """
    point = F.col("kind") == "point"
    left = gold.select("case_id", "item_id", F.col("kind").alias("l_kind"),
                       F.when(point, F.col("start_s") - tolerance).otherwise(F.col("start_s")).alias("l_start"),
                       F.when(point, F.col("end_s") + tolerance).otherwise(F.col("end_s")).alias("l_end"))
    right = selected.select("case_id", F.col("kind").alias("r_kind"), F.col("start_s").alias("r_start"),
                            F.col("end_s").alias("r_end"))
    pairs = overlapping(left, right, ["case_id"], width)
    at = F.col("l_start") + tolerance
    near = F.when(F.col("r_kind") == "point", F.abs(F.col("r_start") - at) <= tolerance).otherwise(
        at.between(F.col("r_start"), F.col("r_end")))
    iou = F.when(F.col("r_kind") == "interval", measures.interval_iou(
        F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")))
    best = pairs.groupBy("case_id", "item_id").agg(
        F.bool_or(F.when(F.col("l_kind") == "point", near)).alias("near"),
        F.max(F.when(F.col("l_kind") == "interval", iou)).alias("iou"))
    judged = gold.select("case_id", "item_id", "kind").join(best, ["case_id", "item_id"], "left")
    is_point = F.col("kind") == "point"
    hit = F.when(is_point, F.coalesce("near", F.lit(False))).otherwise(F.coalesce("iou", F.lit(0.0)) >= 0.25)
    return judged.groupBy("case_id").agg(
        (F.count_if(hit) / F.count(F.lit(1))).alias("recall"),
        F.coalesce(F.avg(F.when(~is_point, F.coalesce("iou", F.lit(0.0)))), F.lit(1.0)).alias("temporal_iou"))


def before_after(times: DataFrame, before: tuple[float, float], after: tuple[float, float]) -> DataFrame:
    """(case_id, matched): a selected time in each window, the earliest before ahead of the latest after."""
    first = F.min(F.when(F.col("t").between(*before), F.col("t")))
    last = F.max(F.when(F.col("t").between(*after), F.col("t")))
    return times.groupBy("case_id").agg(F.coalesce(first < last, F.lit(False)).alias("matched"))


def pair_violations(rows: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, rule): everything that keeps a case from being exactly one row per arm."""
    counted = rows.groupBy("case_id").agg(
        F.count_if(F.col("arm") == "control").alias("control"), F.count_if(F.col("arm") == "candidate").alias("candidate"),
        F.count_if(~F.col("arm").isin("control", "candidate")).alias("other"))
    unknown = counted.join(cases.select("case_id"), "case_id", "left_anti").select(
        "case_id", F.lit("unrelated case").alias("rule"))
    judged = cases.select("case_id").join(counted, "case_id", "left").fillna(0, ["control", "candidate", "other"])
    rules = F.array_compact(F.array(
        F.when(F.col("other") > 0, "invalid arm"),
        F.when((F.col("control") > 1) | (F.col("candidate") > 1), "duplicate paired rows"),
        F.when((F.col("control") == 0) | (F.col("candidate") == 0), "lacks paired rows")))
    return unknown.unionByName(judged.select("case_id", F.explode(rules).alias("rule")))


def rubric() -> Column:
    return measures.judge_score(*[F.col(c) for c in fixed.RUBRIC])


def arm_scores(judgments: DataFrame) -> DataFrame:
    """(case_id, arm, score, citation): means of judgments that were not refused, null under two."""
    return judgments.groupBy(*CASE_ARM).agg(*[c.alias(name) for name, c in score_means(F.lit(True)).items()])


def score_means(own: Column) -> dict[str, Column]:
    """The aggregates of ``arm_scores`` over the rows that are ``own``."""
    valid = own & ~F.col("refused")
    enough = F.count_if(valid) >= 2
    return {"score": F.when(enough, F.avg(F.when(valid, rubric()))),
            "citation": F.when(enough, F.avg(F.when(valid, F.col("citation") / 10.0)))}


def case_sheet(rows: DataFrame, measured: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(case_id, control, candidate): what is ``measured`` over the rows of each arm, as structs in the one row of a case.

    An arm without rows is null. ``measured`` is given the test for the arm's own rows. All that is asked of a case comes
    from one grouping, so rows dealt by case are not shuffled again.
    """
    def of(arm: str) -> Column:
        own = F.coalesce(F.col("arm") == arm, F.lit(False))
        return F.when(F.count_if(own) > 0, F.struct(*[c.alias(name) for name, c in measured(own).items()])).alias(arm)

    return rows.groupBy("case_id").agg(of("control"), of("candidate"))


def by_arm(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, control, candidate): the two arms side by side."""
    keys = keys or ["case_id"]
    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("arm") == "control", F.col(value))).alias("control"),
        F.max(F.when(F.col("arm") == "candidate", F.col(value))).alias("candidate"))


def case_deltas(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """(case_id, family_id, delta) from ``cases(…, control_failure, candidate_failure, both_failure)``."""
    paired = cases.join(by_arm(scores, "score"), "case_id", "left")
    control = F.when(F.col("control_failure"), 0.0).otherwise(F.col("control"))
    candidate = F.when(F.col("candidate_failure"), 0.0).otherwise(F.col("candidate"))
    return paired.select("case_id", "family_id", F.when(F.col("both_failure"), 0.0).otherwise(candidate - control).alias("delta"))


def family_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.where("delta is not null").groupBy("family_id").agg(F.avg("delta").alias("delta"))


def bootstrap_exact(families: DataFrame, seed: int) -> DataFrame:
    """(metric, n, mean, lower_95) of every metric of ``families(metric, family_id, delta)``, of any size.

    The fixed generator is one sequence of draws over a metric's families (8 bytes each), so a metric is one task. The task takes the
    sequence in blocks; it never holds more than a block of draws. ``bootstrap_drawn`` spreads its draws over the cluster.
    """
    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        deltas = rows.assign(k=rows["family_id"].astype(str)).sort_values("k")["delta"].to_numpy(dtype=np.float64)
        n, bits = len(deltas), len(rows).bit_length()
        state = random.Random(seed).getstate()[1]
        stream = np.random.RandomState()
        stream.set_state(("MT19937", np.array(state[:-1], dtype=np.uint32), state[-1]))
        means, rest = [], np.empty(0, dtype=np.int64)
        while len(means) < fixed.BOOTSTRAP_REPLICATES:
            # A draw is the top bits of one 32-bit number, taken again while it is no position.
            drawn = stream.randint(0, 2 ** 32, size=max(n, 1 << 20), dtype=np.uint32) >> np.uint32(32 - bits)
            rest = np.concatenate((rest, drawn[drawn < n].astype(np.int64)))
            whole = min(len(rest) // n, fixed.BOOTSTRAP_REPLICATES - len(means))
            means += (deltas[rest[:whole * n].reshape(whole, n)].sum(axis=1) / n).tolist()
            rest = rest[whole * n:]
        lower = sorted(means)[-(-fixed.BOOTSTRAP_REPLICATES * 5 // 100) - 1]
        return pd.DataFrame({"metric": [rows["metric"].iloc[0]], "n": [n], "mean": [deltas.mean()], "lower_95": [lower]})

    return families.groupBy("metric").applyInPandas(draw, "metric string, n long, mean double, lower_95 double")


def bootstrap_drawn(families: DataFrame, seed: int, replicates: int = fixed.BOOTSTRAP_REPLICATES) -> DataFrame:
    """The same bound with hashed draws, spread over the cluster for any number of families.

    Draw ``j`` of replicate ``r`` takes the family at ``sha256(seed:metric:r:j)`` modulo the number of families.
    """
    spread = F.substring(F.sha2(F.col("family_id").cast("string"), 256), 1, 2)
    numbered = row_index(families, ["metric"], [spread, F.col("family_id")], spread, "j")
    sizes = families.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    draws = numbered.join(sizes, "metric").select(
        "metric", "n", "j", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"))
    text = F.concat_ws(":", F.lit(str(seed)), "metric", F.col("r").cast("string"), F.col("j").cast("string"))
    pick = F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), F.col("n"))
    drawn = draws.select("metric", "n", "r", pick.alias("j")).join(numbered.select("metric", "j", "delta"), ["metric", "j"])
    means = drawn.groupBy("metric", "n", "r").agg(F.round(F.avg("delta"), 9).alias("mean"))
    bound = order_statistics(means, ["metric"], "mean", {"lower_95": 0.05}, width=0.05).drop("n")
    return families.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("mean")).join(bound, "metric")


def latency_gates(rows: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """(keys, allowance, median_delta, p95_delta, enough, pass) from rows of three arms."""
    stats = order_statistics(rows.select(*keys, "arm", value), [*keys, "arm"], value, {"median": "median", "p95": 0.95})

    def of(arm: str, name: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(name)))

    wide = stats.groupBy(*keys).agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("arms"),
        *[of(arm, name).alias(f"{arm}_{name}") for arm in ("noop", "control", "candidate") for name in ("median", "p95")])
    allowance = F.greatest(F.lit(5.0), 0.05 * F.col("control_median"), F.col("noop_p95") - F.col("noop_median"))
    enough = (F.col("arms") == 3) & (F.col("least") >= fixed.MIN_LATENCY_REPEATS)
    out = wide.select(*keys, allowance.alias("allowance"), (F.col("candidate_median") - F.col("control_median")).alias("median_delta"),
                      (F.col("candidate_p95") - F.col("control_p95")).alias("p95_delta"), enough.alias("enough"))
    return out.withColumn("pass", F.col("enough") & (F.col("median_delta") <= F.col("allowance")) & (F.col("p95_delta") <= F.col("allowance")))


def token_reduction(rows: DataFrame, keys: list[str], value: str, width: float = 64.0) -> DataFrame:
    """(keys, control, candidate, reduction) of arm medians; null where the control median is not positive."""
    stats = order_statistics(rows.select(*keys, "arm", value), [*keys, "arm"], value, {"median": "median"}, width)
    return by_arm(stats, "median", keys).withColumn("reduction", F.when(
        F.col("control") > 0, (F.col("control") - F.col("candidate")) / F.col("control")))


def asr_gate(rows: DataFrame) -> DataFrame:
    """One row: macro WER delta, language check, boundary deltas, pass.

    ``rows`` is one per (case, arm): counts of errors, ``reference_words``, ``language``, ``boundary_errors``.
    """
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    wer = rows.withColumn("wer", 100.0 * errors / F.col("reference_words"))
    paired = wer.groupBy("case_id").agg(
        F.max(F.when(F.col("arm") == "control", F.col("wer"))).alias("control"),
        F.max(F.when(F.col("arm") == "candidate", F.col("wer"))).alias("candidate"),
        F.max(F.when(F.col("arm") == "candidate", F.col("language"))).alias("language"),
        F.max(F.when(F.col("arm") == "control", F.col("boundary_errors"))).alias("control_errors"),
        F.max(F.when(F.col("arm") == "candidate", F.col("boundary_errors"))).alias("candidate_errors"))
    return asr_paired_gate(paired)


def asr_paired_gate(cases: DataFrame) -> DataFrame:
    """As ``asr_gate``, of one row a case: ``(control, candidate)`` WER, the ``language``, ``control_errors`` and ``candidate_errors``."""
    paired = cases.where("control is not null and candidate is not null")
    language = paired.groupBy("language").agg(F.avg(F.col("candidate") - F.col("control")).alias("d")).agg(
        F.bool_and(F.col("d") <= 2.0).alias("language_pass"))
    overall = paired.agg((F.avg("candidate") - F.avg("control")).alias("wer_delta_points"), F.count(F.lit(1)).alias("cases"))
    spread = paired.select(F.explode(F.array(*[F.struct(F.lit(arm).alias("arm"), F.col(f"{arm}_errors").alias("errors"))
                                                for arm in ("control", "candidate")])).alias("x")).select(
        "x.arm", F.explode("x.errors").alias("e"))
    edge = order_statistics(spread, ["arm"], "e", {"median": "median", "p95": 0.95}, width=0.05)

    def of(arm: str, name: str) -> Column:
        return F.max(F.when(F.col("arm") == arm, F.col(name)))

    bounds = edge.agg((of("candidate", "median") - of("control", "median")).alias("median_delta"),
                      (of("candidate", "p95") - of("control", "p95")).alias("p95_delta"))
    parts = overall.unionByName(language, allowMissingColumns=True).unionByName(bounds, allowMissingColumns=True)
    one = parts.agg(*[F.max(c).alias(c) for c in ("cases", "wer_delta_points", "language_pass", "median_delta", "p95_delta")])
    return one.withColumn("pass", (F.col("wer_delta_points") <= 1.0) & F.col("language_pass")
                          & (F.col("median_delta") <= 0.25) & (F.col("p95_delta") <= 1.0))


def usage_totals(usage: DataFrame, metrics: list[str]) -> DataFrame:
    """(case_id, arm, metrics): sums over all attempts, failed ones included."""
    return usage.groupBy(*CASE_ARM).agg(*[F.sum(m).alias(m) for m in metrics])


def final_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*CASE_ARM).agg(F.max_by("state", "attempt").alias("state"))


def completion(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(environment_id, total, control, candidate): cases whose last attempt succeeded."""
    done = final_runs(runs).groupBy("case_id").agg(
        F.bool_or((F.col("arm") == "control") & F.col("state").isin(GOOD)).alias("control"),
        F.bool_or((F.col("arm") == "candidate") & F.col("state").isin(GOOD)).alias("candidate"),
        F.count(F.lit(1)).alias("arms")).where("arms = 2")
    return cases.join(done, "case_id").groupBy("environment_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("control").alias("control"), F.count_if("candidate").alias("candidate"))


def metric_medians(rows: DataFrame, keys: list[str], metrics: list[str], width: float = 1.0) -> DataFrame:
    """(keys, arm, metric, median) of several columns at once."""
    tall = rows.select(*keys, "arm", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])))
    return order_statistics(tall, [*keys, "arm", "metric"], "v", {"median": "median"}, width)


def attempt_violations(runs: DataFrame) -> DataFrame:
    """(case_id, arm, rule) for attempts that are not exactly 1..max, and first attempts out of order."""
    keyed = runs.groupBy(*CASE_ARM, "attempt").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("order"))
    shape = keyed.groupBy(*CASE_ARM).agg(
        F.max("n").alias("most"), F.count(F.lit(1)).alias("distinct"), F.min("attempt").alias("low"), F.max("attempt").alias("top"),
        F.max(F.when(F.col("attempt") == 1, F.col("order"))).alias("first_order"))
    first = identity.first_arm(F.col("case_id").cast("string"))
    expected = F.when(F.col("arm") == first, 1).otherwise(2)
    arms = shape.groupBy("case_id").agg(F.count_if(F.col("first_order").isNotNull()).alias("arms"))
    rules = F.array_compact(F.array(
        F.when(F.col("most") > 1, "duplicate attempt"),
        F.when((F.col("low") != 1) | (F.col("top") != F.col("distinct")), "dropped attempt"),
        F.when(F.col("arms") < 2, "initial attempt lacks a pair"),
        F.when((F.col("arms") == 2) & (F.col("first_order") != expected), "paired order")))
    return shape.join(arms, "case_id").select(*CASE_ARM, F.explode(rules).alias("rule"))


def kappa(rows: DataFrame) -> DataFrame:
    """One row: agreement of a grader with two people who agree, null under 20 such cases."""
    dual = rows.where("human_a = human_b").select(F.col("human_a").cast("string").alias("human"), F.col("grader").cast("string").alias("grader"))
    table = dual.groupBy("human", "grader").agg(F.count(F.lit(1)).alias("n"))
    whole = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("human") == F.col("grader"), F.col("n")).otherwise(0)).alias("same"))
    human = table.groupBy(F.col("human").alias("label")).agg(F.sum("n").alias("h"))
    grader = table.groupBy(F.col("grader").alias("label")).agg(F.sum("n").alias("g"))
    chance = human.join(grader, "label").agg(F.coalesce(F.sum(F.col("h") * F.col("g")), F.lit(0)).alias("hg"))
    both = whole.unionByName(chance, allowMissingColumns=True).agg(
        F.max("n").alias("n"), F.max("same").alias("same"), F.max("hg").alias("hg")).where("n >= 20")
    accuracy, expected = F.col("same") / F.col("n"), F.col("hg") / (F.col("n") * F.col("n"))
    value = F.when(expected < 1, (accuracy - expected) / (1 - expected)).otherwise(1.0)
    return both.select(F.col("n").alias("dual_cases"), accuracy.alias("accuracy"), value.alias("kappa")).withColumn(
        "validated", (F.col("accuracy") >= 0.80) & (F.col("kappa") >= 0.60))


def pareto(control: dict[str, str], metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, no_worse, regressions) of ``(keys, metric, control, candidate)``; ``control`` maps a metric to
    ``"up"`` (more is better) or ``"down"``."""
    up = [m for m, way in control.items() if way == "up"]
    worse = F.when(F.col("metric").isin(up), F.col("candidate") < F.col("control")).otherwise(F.col("candidate") > F.col("control"))
    return metrics.groupBy(*keys).agg(
        (~F.bool_or(worse) & (F.count(F.lit(1)) == len(control))).alias("no_worse"),
        F.array_join(F.array_sort(F.collect_set(F.when(worse, F.col("metric")))), "|").alias("regressions"))
