"""Row rules, cross-table checks and refusals, as violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timesift.functions import fixed


def request_rules() -> Column:
    """Refusals of a request row, by name."""
    return F.array_compact(F.array(
        F.when(F.col("schema_version") != 1, "unsupported request schema"),
        F.when((F.coalesce("source", F.lit("")) == "") | F.col("source").contains("\u0000"), "source is required"),
        F.when(F.octet_length("question") > fixed.MAX_QUESTION_BYTES, "question exceeds 16 KiB"),
        F.when(~F.col("detail").isin(list(fixed.DETAILS)), "invalid detail"),
        F.when(~F.col("text_budget").between(1, fixed.MAX_TEXT_BUDGET), "invalid text budget"),
        F.when(~F.col("max_frames").between(1, fixed.MAX_FRAMES), "invalid frame budget")))


def _gone(name: str) -> Column:
    return F.col(name).isNull()


def special_rules(kind: str, columns: set[str]) -> list[Column]:
    """Rules that tie several fields of one row together."""
    c, out = F.col, []
    if kind == "run":
        out += [F.when(c("result_state").isin("fatal", "unavailable", "partial") & _gone("failure_class"),
                       "non-success run requires failure_class"),
                F.when((c("result_state") == "success") & ~_gone("failure_class"), "successful run must have null failure_class")]
    if kind == "case" and {"obligations", "gold_count", "gold_unavailable_reason"} <= columns:
        done = c("status") == "complete"
        out += [F.when(done & _gone("gold_count") & (F.trim(F.coalesce("gold_unavailable_reason", F.lit(""))) == ""),
                       "null gold_evidence requires gold_unavailable_reason"),
                F.when(done & ~_gone("gold_count") & ~_gone("gold_unavailable_reason"), "gold_evidence excludes a reason")]
    if kind == "judgment":
        scores = [c(name).between(0, 10) for name in fixed.RUBRIC]
        ok = scores[0] & scores[1] & scores[2] & scores[3]
        out.append(F.when(~c("refused") & ~F.coalesce(ok, F.lit(False)), "judgment scores must be 0 to 10"))
    if kind == "usage":
        vendor = F.startswith(c("measurement_source"), F.lit("provider:"))
        out += [F.when((c("measurement_kind") == "reported") & ~vendor, "reported usage requires a provider source"),
                F.when((c("measurement_kind") == "estimated") & vendor, "estimated usage cannot claim a provider source")]
    if kind == "resource" and "attempt" in columns:
        idle = c("arm") == "noop"
        out += [F.when(idle & (F.coalesce("attempt", F.lit(-1)) != 0), "noop resource requires attempt 0"),
                F.when(~idle & (F.coalesce("attempt", F.lit(0)) < 1), "resource requires a positive attempt")]
    return out


def row_rules(kind: str, columns: list[str]) -> Column:
    """ARRAY of broken rules of one row of the artifact table ``kind``; absent columns count as missing."""
    spec, have = fixed.ARTIFACTS[kind], set(columns)
    rules: list[Column] = []
    for name in [*fixed.COMMON["required"], *spec["required"]]:
        rule = F.lit(f"missing required field {name}")
        rules.append(F.when(_gone(name), rule) if name in have else rule)
    for name, values in {**fixed.COMMON["enum"], **spec.get("enum", {})}.items():
        if name in have:
            rules.append(F.when(~F.col(name).isin(values), f"{name} has invalid enum value"))
    for name, pattern in {**fixed.COMMON["pattern"], **spec.get("pattern", {})}.items():
        if name in have:
            rules.append(F.when(~F.col(name).rlike(fixed.PATTERNS[pattern]), f"{name} does not match {pattern}"))
    for name, least in [(n, 1) for n in spec.get("positive", [])] + [(n, 0) for n in spec.get("nonnegative", [])]:
        if name in have:
            number = F.col(name).cast("double")
            rules.append(F.when(F.isnan(number) | (F.abs(number) == float("inf")) | (number < least),
                                f"{name} is outside its allowed range"))
    for name, least in spec.get("min_items", {}).items():
        if name in have:
            rules.append(F.when(F.size(name) < least, f"{name} has too few items"))
    for name in spec.get("path", []):
        if name in have:
            rules.append(F.when(F.startswith(F.col(name), F.lit("/")) | F.array_contains(F.split(name, "/"), ".."),
                                f"{name} must be a safe relative path"))
    for name in ("control_commit", "candidate_commit", "candidate_config_hash", "plan_sha256"):
        if name in have:
            rules.append(F.when((F.col("status") != "provisional") & _gone(name), f"{name} may be null only for provisional evidence"))
    return F.array_compact(F.array(*rules, *special_rules(kind, have)))


def dataset_violations(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """(scope, rule): duplicate keys, unpaired or dropped attempts, families in both splits."""
    keyed = runs.groupBy("case_id", "arm", "attempt").agg(F.count(F.lit(1)).alias("n"))
    key = F.concat_ws("/", F.col("case_id").cast("string"), "arm")
    twice = keyed.where("n > 1").select(
        F.concat_ws("/", F.col("case_id").cast("string"), "arm", F.col("attempt").cast("string")).alias("scope"),
        F.lit("duplicate case/arm/attempt").alias("rule"))
    shape = keyed.groupBy("case_id", "arm").agg(F.count(F.lit(1)).alias("d"), F.min("attempt").alias("low"), F.max("attempt").alias("top"))
    dropped = shape.where("low <> 1 or top <> d").select(key.alias("scope"), F.lit("dropped attempt").alias("rule"))
    lone = shape.groupBy("case_id").agg(F.count_if(F.col("arm").isin(fixed.ARMS)).alias("n")).where("n < 2").select(
        F.col("case_id").cast("string").alias("scope"), F.lit("lacks paired runs").alias("rule"))
    leaks = split_leakage(cases).select(F.col("family_id").cast("string").alias("scope"), F.lit("family leaks across splits").alias("rule"))
    return twice.unionByName(dropped).unionByName(lone).unionByName(leaks)


def split_leakage(cases: DataFrame) -> DataFrame:
    """(family_id) of families with both development and confirmatory cases."""
    both = F.bool_or(F.col("split") == "development") & F.bool_or(F.col("split") == "confirmatory")
    return cases.groupBy("family_id").agg(both.alias("both")).where("both").select("family_id")


LABEL = "^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$"


def registry_violations(families: DataFrame, identities: DataFrame, minimum: int = fixed.MIN_FAMILIES,
                        per_class: int = fixed.MIN_FAMILIES_PER_CLASS) -> DataFrame:
    """(scope, rule) of ``families(family_id, split, question_class)`` and ``identities(family_id, identity_id, identity_sha256)``."""
    def found(rows: DataFrame, scope: str, rule: str) -> DataFrame:
        return rows.select(F.col(scope).cast("string").alias("scope"), F.lit(rule).alias("rule"))

    out = found(families.where(~F.col("family_id").rlike(LABEL)).select("family_id").distinct(), "family_id", "family_id must be an opaque label")
    out = out.unionByName(found(families.groupBy("family_id").agg(F.count_distinct("split").alias("n")).where("n > 1"),
                                "family_id", "duplicate family assignment"))
    out = out.unionByName(found(families.join(identities, "family_id", "left_anti").select("family_id").distinct(), "family_id", "family lacks identities"))
    out = out.unionByName(found(identities.where(~F.col("identity_id").rlike(LABEL)), "identity_id", "identity_id must be an opaque label"))
    out = out.unionByName(found(identities.where(~F.col("identity_sha256").rlike(fixed.PATTERNS["sha64"])), "identity_id", "identity requires sha256"))
    for name, rule in (("identity_id", "duplicate identity alias"), ("identity_sha256", "duplicate identity hash")):
        out = out.unionByName(found(identities.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name, rule))
    reserve = families.where("split = 'confirmatory'")
    held = reserve.select("family_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(held.where(F.col("n") < minimum).select(
        F.lit("all").alias("scope"), F.lit("underpowered confirmatory cohort").alias("rule")))
    classes = families.select("question_class").distinct().join(
        reserve.select("question_class", "family_id").distinct().groupBy("question_class").agg(F.count(F.lit(1)).alias("n")),
        "question_class", "left")
    return out.unionByName(found(classes.where(F.coalesce("n", F.lit(0)) < per_class), "question_class", "underpowered confirmatory class"))


def visible_rows(identities: DataFrame, families: DataFrame, executors: DataFrame, actor: str) -> DataFrame:
    """Development identities, and only for a named executor."""
    allowed = families.where("split = 'development'").select("family_id").distinct()
    asking = executors.where(F.col("actor_id") == actor).select("custodian_id").distinct()
    return identities.join(allowed, "family_id", "left_semi").join(asking, "custodian_id", "left_semi")


def slice_violations(cases: DataFrame, identities: DataFrame) -> DataFrame:
    """(case_id, rule) of a development slice against the registered identities.

    ``identities`` is ``(identity_id, split, identity_sha256, classes ARRAY)``.
    """
    known = identities.where("split = 'development'").select(
        "identity_id", F.col("identity_sha256").alias("__sha"), F.col("classes").alias("__classes"))
    twice = cases.groupBy("identity_id").agg(F.count(F.lit(1)).alias("__n"))
    joined = cases.join(known, "identity_id", "left").join(twice, "identity_id")
    rules = F.array_compact(F.array(
        F.when(F.col("__sha").isNull(), "not an authorized development identity"),
        F.when(F.col("__n") > 1, "repeats a development identity"),
        F.when(~F.array_contains("__classes", F.col("question_class")), "class is not registered"),
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "question is empty"),
        F.when(F.size("obligations") < 1, "obligations are empty"),
        F.when(F.col("gold_count").isNull() == F.col("reason").isNull(), "gold evidence or a reason"),
        F.when(F.col("source_sha256") != F.col("__sha"), "identity hash drifted")))
    return joined.select("case_id", F.explode(rules).alias("rule"))


def inventory_violations(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, rule) where ``(path, bytes, sha256)`` of a manifest and of the store do not agree."""
    media = F.lower("path").rlike(r"\.(" + "|".join(fixed.MEDIA_SUFFIXES) + ")$")
    twice = declared.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "path", F.lit("repeated in manifest").alias("rule"))
    left = declared.dropDuplicates(["path"]).select("path", F.col("bytes").alias("b0"), F.col("sha256").alias("s0"), F.col("media_included").alias("m"))
    right = observed.select("path", F.col("bytes").alias("b1"), F.col("sha256").alias("s1"))
    both = left.join(right, "path", "full_outer")
    rules = F.array_compact(F.array(
        F.when(F.col("b1").isNull(), "missing"), F.when(F.col("b0").isNull(), "undeclared"),
        F.when(F.col("b0") != F.col("b1"), "size mismatch"), F.when(F.col("s0") != F.col("s1"), "checksum mismatch"),
        F.when(F.col("b0").isNotNull() & media & ~F.col("m"), "undeclared media")))
    return twice.unionByName(both.select("path", F.explode(rules).alias("rule")))


def arm_diff(rows: DataFrame) -> DataFrame:
    """(case_id, field) where the two arms hold different values, as multisets of ``(case_id, arm, field, value)``."""
    sign = F.when(F.col("arm") == "control", 1).otherwise(-1)
    return rows.groupBy("case_id", "field", "value").agg(F.sum(sign).alias("balance")).where("balance <> 0").select(
        "case_id", "field").distinct()


def coverage_gaps(gates: DataFrame, known_environments: list[str]) -> DataFrame:
    """(gate_id, rule, missing) of ``gates(gate_id, required_classes, covered_classes, required_environments,
    covered_environments)``: what is required and not covered, and environments that nobody knows."""
    known = F.array(*[F.lit(e) for e in known_environments]).cast("array<string>")
    mentioned = F.array_union("required_environments", "covered_environments")
    gaps = F.array(
        F.struct(F.lit("class is not covered").alias("rule"), F.array_except("required_classes", "covered_classes").alias("m")),
        F.struct(F.lit("environment is not covered").alias("rule"), F.array_except("required_environments", "covered_environments").alias("m")),
        F.struct(F.lit("environment is unknown").alias("rule"), F.array_except(mentioned, known).alias("m")))
    each = gates.select("gate_id", F.explode(gaps).alias("g"))
    return each.select("gate_id", "g.rule", F.explode("g.m").alias("missing"))


def manifest_refusal() -> Column:
    """The first reason to refuse the JSON text ``manifest`` of a bundle; null for a complete one."""
    texts = "map<string, string>"
    m = F.from_json("manifest", f"struct<bundle_schema_version: bigint, tool_versions: {texts}, schema_versions: {texts}, evidence_budget: {texts}, "
                                f"completeness_state: string, provenance: {texts}, media_included: boolean, files: array<string>>")

    def empty(name: str) -> Column:
        return F.coalesce(F.cardinality(m[name]), F.lit(0)) < 1

    fields = F.array_sort(F.json_object_keys("manifest"))
    return F.coalesce(
        F.when(~F.coalesce(fields == F.array(*[F.lit(f) for f in sorted(fixed.MANIFEST_FIELDS)]), F.lit(False)), "fields are missing or unknown"),
        F.when(F.coalesce(m["bundle_schema_version"], F.lit(-1)) != fixed.BUNDLE_SCHEMA_VERSION, "another bundle schema"),
        F.when(empty("tool_versions"), "no tool versions"),
        F.when(empty("schema_versions"), "no schema versions"),
        F.when(m["evidence_budget"].isNull(), "no evidence budget"),
        F.when(~F.coalesce(m["completeness_state"].isin(fixed.COMPLETENESS_STATES), F.lit(False)), "invalid completeness"),
        F.when(empty("provenance"), "no provenance"),
        F.when(m["media_included"].isNull(), "no media declaration"),
        F.when(empty("files"), "no files"))
