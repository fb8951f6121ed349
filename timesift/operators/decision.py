"""A promotion decision as data.

Metrics are rows ``(metric, scope, value)``, rules are rows of ``fixed.DECISION_RULES``; one interpreter joins them, so a new
gate, margin or direction is a row and not code. Every metric is a small aggregate; only aggregates meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timesift.functions import fixed
from timesift.operators import evaluation as ev
from timesift.session import cut_lineage

RULE_SCHEMA = "split string, role string, name string, metric string, scope string, op string, bound double, required boolean"
INFINITE = float("inf")


def rule_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(fixed.DECISION_RULES if rules is None else rules, RULE_SCHEMA)


def _named(metric: str, rows: DataFrame, scope: Column, value: Column) -> DataFrame:
    return rows.select(F.lit(metric).alias("metric"), scope.alias("scope"), F.round(value.cast("double"), 9).alias("value"))


def _all() -> Column:
    return F.lit("all")


def quality_metrics(cases: DataFrame, scores: DataFrame, value: str, name: str, split: str, seed: int) -> DataFrame:
    """``name.mean`` and ``name_class.mean``; for a confirmatory split means over families, and the bootstrap's lower bounds.

    ``scores`` is ``(case_id, arm, value)``; cases that lack an arm take no part.
    """
    paired = cases.join(ev.by_arm(scores, value), "case_id").select(
        "family_id", "question_class", (F.col("candidate") - F.col("control")).alias(name))
    return delta_metrics(paired, [name], split, seed)


def delta_metrics(deltas: DataFrame, names: list[str], split: str, seed: int) -> DataFrame:
    """As ``quality_metrics`` for several names at once: ``deltas`` is ``(family_id, question_class)`` and a column of each name.

    Rows are read once, into sums by class (and family); all means are made of these.
    """
    family = [] if split == "development" else ["family_id"]
    sums = cut_lineage(deltas.groupBy("question_class", *family).agg(
        *[F.struct(F.sum(n).alias("total"), F.count(n).alias("n")).alias(n) for n in names]))
    out = None
    for name in names:
        for metric, scope in ((name, _all()), (f"{name}_class", F.col("question_class"))):
            means = sums.where(F.col(name)["n"] > 0).groupBy(scope.alias("metric"), *family).agg(
                (F.sum(F.col(name)["total"]) / F.sum(F.col(name)["n"])).alias("delta"))
            if not family:
                parts = _named(f"{metric}.mean", means, F.col("metric"), F.col("delta"))
            else:
                families = cut_lineage(means.select("metric", "family_id", F.round("delta", 9).alias("delta")))
                bound = cut_lineage(ev.bootstrap_drawn(families, seed))
                parts = _named(f"{metric}.mean", bound, F.col("metric"), F.col("mean")).unionByName(
                    _named(f"{metric}.lower_95", bound, F.col("metric"), F.col("lower_95")))
            out = parts if out is None else out.unionByName(parts)
    return out


def completion_metrics(done: DataFrame) -> DataFrame:
    """``completion.drop``, and ``completion.excess`` over the drop that a development split allows, by environment, of ``ev.completion``."""
    drop = F.col("control") - F.col("candidate")
    scope = F.col("environment_id")
    return _named("completion.drop", done, scope, drop).unionByName(
        _named("completion.excess", done, scope, drop - F.least(F.lit(1.0), 0.01 * F.col("total"))))


def latency_metrics(latency: DataFrame, keys: list[str]) -> DataFrame:
    """``latency.excess`` of the greater delta over the allowance; infinite where repeats are too few."""
    gates = ev.latency_gates(latency, keys)
    excess = F.greatest("median_delta", "p95_delta") - F.col("allowance")
    return _named("latency.excess", gates, F.concat_ws(":", *keys), F.when(F.col("enough"), excess).otherwise(F.lit(INFINITE)))


def asr_metrics(one: DataFrame) -> DataFrame:
    """``asr.*`` of the one row of ``ev.asr_gate``."""
    parts = {"asr.wer": F.col("wer_delta_points"), "asr.boundary_median": F.col("median_delta"), "asr.boundary_p95": F.col("p95_delta"),
             "asr.language_failed": F.when(F.col("language_pass"), 0.0).otherwise(1.0)}
    tall = one.select(F.explode(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))])).alias("metric", "value"))
    return tall.select("metric", _all().alias("scope"), F.round("value", 9).alias("value"))


def usage_metrics(usage: DataFrame, metrics: list[str], reader: str) -> DataFrame:
    """``usage.<metric>``, the ratio of the arms' medians by class, and ``tokens.reduction`` of the column ``reader``.

    ``usage`` holds a row for each case and arm with ``question_class``. A metric that appears from nothing has an infinite ratio.
    """
    wide = cut_lineage(ev.by_arm(ev.metric_medians(usage, ["question_class"], metrics, 100.0), "median", ["question_class", "metric"]))
    ratio = F.when(F.col("control") > 0, F.col("candidate") / F.col("control")).when(F.col("candidate") > 0, F.lit(INFINITE)).otherwise(1.0)
    ratios = wide.select(F.concat(F.lit("usage."), "metric").alias("metric"), F.col("question_class").alias("scope"), F.round(ratio, 9).alias("value"))
    saved = wide.where((F.col("metric") == reader) & (F.col("control") > 0))
    return ratios.unionByName(_named("tokens.reduction", saved, F.col("question_class"),
                                     (F.col("control") - F.col("candidate")) / F.col("control")))


def resource_metrics(medians: DataFrame, keys: list[str]) -> DataFrame:
    """``resource.<metric>``: how much more the candidate's median is, of ``(keys, arm, metric, median)``."""
    wide = ev.by_arm(medians, "median", [*keys, "metric"])
    return wide.select(F.concat(F.lit("resource."), "metric").alias("metric"), F.concat_ws(":", *keys).alias("scope"),
                       F.round(F.col("candidate") - F.col("control"), 9).alias("value"))


def count_metric(metric: str, rows: DataFrame) -> DataFrame:
    """The number of ``rows`` as a metric: blockers, unmatched before and after times."""
    return _named(metric, rows.agg(F.count(F.lit(1)).alias("n")), _all(), F.col("n"))


def decide(metrics: DataFrame, rules: DataFrame, split: str = "development") -> DataFrame:
    """(role, name, metric, scope, value, holds): every rule that met a metric, each gate, and ``pareto_promote``.

    A gate holds when all of its rules hold in all scopes; a required rule without a metric does not. The gate
    ``primary_improvement`` asks for one improvement. Promotion asks for all gates and no regression.
    """
    live = rules.where((F.col("split") == split) | (F.col("split") == "any"))
    met = live.join(metrics.withColumnsRenamed({"metric": "m", "scope": "s"}),
                    (F.col("metric") == F.col("m")) & F.coalesce(F.col("scope") == F.col("s"), F.lit(True)), "left")
    value, bound = F.col("value"), F.col("bound")
    holds = F.when(F.col("op") == ">=", value >= bound).when(F.col("op") == ">", value > bound).when(
        F.col("op") == "<=", value <= bound).when(F.col("op") == "<", value < bound)
    rows = cut_lineage(met.where("m IS NOT NULL OR required").select(
        "role", "name", "metric", F.coalesce("s", "scope", _all()).alias("scope"), "value", F.coalesce(holds, F.lit(False)).alias("holds")))
    gates = rows.where("role = 'gate'").groupBy("name").agg(F.bool_and("holds").alias("holds"))
    better = rows.agg(F.coalesce(F.bool_or(F.when(F.col("role") == "improvement", F.col("holds"))), F.lit(False)).alias("holds")).select(
        F.lit("primary_improvement").alias("name"), "holds")
    worse = rows.agg((~F.coalesce(F.bool_or(F.when(F.col("role") == "regression", F.col("holds"))), F.lit(False))).alias("holds")).select(
        F.lit("no_regression").alias("name"), "holds")
    named = gates.unionByName(better).unionByName(worse)
    final = named.agg(F.bool_and("holds").alias("holds")).select(F.lit("pareto_promote").alias("name"), "holds")
    decided = named.unionByName(final).select(
        F.lit("decision").alias("role"), "name", F.lit(None).cast("string").alias("metric"), _all().alias("scope"),
        F.lit(None).cast("double").alias("value"), "holds")
    return rows.unionByName(decided)


def refuse(decision: DataFrame, violations: DataFrame) -> DataFrame:
    """The decision, or no row at all while ``violations`` has one: refused inputs are never judged."""
    any_one = violations.limit(1).select(F.lit(1).alias("__refused"))
    return decision.withColumn("__refused", F.lit(1)).join(any_one, "__refused", "left_anti").drop("__refused")


def case_violations(cases: DataFrame, split: str, required_classes: list[str], required_environments: list[str]) -> DataFrame:
    """(subject, rule): what keeps cases ``(case_id, question_class, environment_id, split)`` from being judged.

    No case at all, repeated ids, cases of another split, required classes and environments that no case covers.
    """
    spark = cases.sparkSession
    none = cases.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("all").alias("subject"), F.lit("no canonical case rows").alias("rule"))
    repeated = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("case_id").cast("string").alias("subject"), F.lit("duplicate canonical case").alias("rule"))
    outside = cases.where(~F.col("split").eqNullSafe(split)).select(
        F.col("case_id").cast("string").alias("subject"), F.lit("case outside the evaluation split").alias("rule"))
    out = none.unionByName(repeated).unionByName(outside)
    for column, wanted, rule in (("question_class", required_classes, "required class not covered"),
                                 ("environment_id", required_environments, "required environment not covered")):
        asked = spark.createDataFrame([(w,) for w in wanted], "subject string")
        out = out.unionByName(asked.join(cases.select(F.col(column).alias("subject")).distinct(), "subject", "left_anti").select(
            "subject", F.lit(rule).alias("rule")))
    return out
