"""Queries over data quality and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from timesift.operators import audit, quality
from timesift.plans import views
from timesift.plans.catalog import query, table
from timesift.plans.evaluation_plans import _RUNS, runs
from timesift.plans.text_plans import indexed_points
from timesift.plans.views import sql
from timesift.session import cut_lineage

# Run rows as an artifact table, with faults that follow from the data.
_ARTIFACT = """SELECT l_orderkey AS case_id, l_linenumber AS line, l_partkey AS part, 'run' AS artifact_type, 1 AS schema_version,
  CASE WHEN l_partkey % 50 = 0 THEN 'yesterday' ELSE '2026-07-12T00:00:00Z' END AS created_at_utc,
  CASE WHEN l_suppkey % 20 = 0 THEN 'X1' ELSE 'P03' END AS packet_id, CASE WHEN l_partkey % 13 = 0 THEN 'provisional' ELSE 'complete' END AS status,
  CASE WHEN l_linenumber = 7 THEN 'noop' WHEN l_linenumber % 2 = 0 THEN 'control' ELSE 'candidate' END AS arm,
  l_linenumber - 1 AS attempt, CAST(l_partkey % 2 + 1 AS INT) AS `order`,
  CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'degraded' ELSE 'fatal' END AS result_state,
  CASE WHEN l_partkey % 7 = 0 THEN 'http_403' WHEN l_partkey % 7 = 1 THEN 'odd' END AS failure_class,
  CASE WHEN l_suppkey % 9 = 0 THEN '/abs/x.json' WHEN l_suppkey % 9 = 1 THEN 'a/../x.json' WHEN l_suppkey % 9 = 2 THEN NULL ELSE 'm/x.json' END AS raw_manifest_path,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE '0123456789012345678901234567890123456789' END AS control_commit FROM {t}"""
_RULES = [
    ("missing required field raw_manifest_path", "raw_manifest_path IS NULL"),
    ("created_at_utc does not match utc_timestamp", "created_at_utc = 'yesterday'"),
    ("packet_id does not match packet_id", "packet_id = 'X1'"),
    ("arm has invalid enum value", "arm = 'noop'"),
    ("failure_class has invalid enum value", "failure_class = 'odd'"),
    ("attempt is outside its allowed range", "attempt < 1"),
    ("raw_manifest_path must be a safe relative path", "raw_manifest_path IN ('/abs/x.json', 'a/../x.json')"),
    ("control_commit may be null only for provisional evidence", "control_commit IS NULL AND status <> 'provisional'"),
    ("non-success run requires failure_class", "result_state = 'fatal' AND failure_class IS NULL"),
    ("successful run must have null failure_class", "result_state = 'success' AND failure_class IS NOT NULL"),
]


@query("row_rules", "WITH a AS (" + _ARTIFACT.format(t="lineitem").replace("`order`", "ord") + ") SELECT rule, case_id, line, part FROM (" + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, case_id, line, part FROM a WHERE {test}" for rule, test in _RULES) + ")")
def row_rules(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(*_columns(_ARTIFACT))
    return rows.select(F.explode(quality.row_rules("run", rows.columns)).alias("rule"), "case_id", "line", "part")


def _columns(select: str) -> list[str]:
    """The select list of the text above, one expression each."""
    body, out, depth, current = select[len("SELECT "):select.rindex(" FROM ")], [], 0, ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(current.strip())
            current = ""
        else:
            current += c
    return [*out, current.strip()]


def _split_cases(spark, sf):
    split = F.when(F.col("case_id") % 3 == 0, "confirmatory").otherwise("development")
    return views.cases(spark, sf).withColumn("split", F.when(F.col("family_id") < 20, split).otherwise("development"))


_SPLIT = "sc AS (SELECT *, CASE WHEN family_id < 20 AND case_id % 3 = 0 THEN 'confirmatory' ELSE 'development' END AS split FROM v_cases)"
_LEAKS = "leaks AS (SELECT family_id FROM sc GROUP BY family_id HAVING bool_or(split = 'development') AND bool_or(split = 'confirmatory'))"


@query("split_leakage", sql(f"{_SPLIT}, {_LEAKS} SELECT family_id FROM leaks", "v_cases"))
def split_leakage(spark, sf):
    return quality.split_leakage(_split_cases(spark, sf))


@query("dataset_rules", sql(f"""{_RUNS}, {_SPLIT}, {_LEAKS},
k AS (SELECT case_id, arm, attempt, count(*) AS n FROM runs GROUP BY ALL),
s AS (SELECT case_id, arm, count(*) AS d, min(attempt) AS low, max(attempt) AS top FROM k GROUP BY ALL)
SELECT case_id || '/' || arm || '/' || attempt AS scope, 'duplicate case/arm/attempt' AS rule FROM k WHERE n > 1
UNION ALL SELECT case_id || '/' || arm, 'dropped attempt' FROM s WHERE low <> 1 OR top <> d
UNION ALL SELECT CAST(case_id AS VARCHAR), 'lacks paired runs' FROM s GROUP BY case_id HAVING count(*) < 2
UNION ALL SELECT CAST(family_id AS VARCHAR), 'family leaks across splits' FROM leaks""", "v_cases"))
def dataset_rules(spark, sf):
    return quality.dataset_violations(runs(spark, sf), _split_cases(spark, sf))


def _registry(spark, sf):
    cases = _split_cases(spark, sf)
    families = cases.select(F.concat(F.when(F.col("family_id") % 13 == 0, "Family-").otherwise("family-"), F.col("family_id").cast("string")).alias("family_id"),
                            "split", "question_class").distinct()
    doc = table(spark, sf, "documents")
    key = F.col("doc_id")
    identities = doc.select(
        F.concat(F.lit("family-"), (key % 45).cast("string")).alias("family_id"), F.concat(F.lit("id-"), (key % 900).cast("string")).alias("identity_id"),
        F.when(key % 31 == 0, "none").otherwise(F.sha2("text", 256)).alias("identity_sha256"), F.col("lang").alias("custodian_id"))
    return families, identities


_REGISTRY = _SPLIT + """,
fam AS (SELECT DISTINCT CASE WHEN family_id % 13 = 0 THEN 'Family-' ELSE 'family-' END || family_id AS family_id, split, question_class FROM sc),
ids AS (SELECT 'family-' || (doc_id % 45) AS family_id, 'id-' || (doc_id % 900) AS identity_id, CASE WHEN doc_id % 31 = 0 THEN 'none' ELSE sha256(text) END AS identity_sha256, lang FROM documents)"""


@query("registry_rules", sql(_REGISTRY + """
SELECT DISTINCT family_id AS scope, 'family_id must be an opaque label' AS rule FROM fam WHERE NOT regexp_matches(family_id, '^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$')
UNION ALL SELECT family_id, 'duplicate family assignment' FROM fam GROUP BY family_id HAVING count(DISTINCT split) > 1
UNION ALL SELECT DISTINCT family_id, 'family lacks identities' FROM fam WHERE family_id NOT IN (SELECT family_id FROM ids)
UNION ALL SELECT identity_id, 'identity requires sha256' FROM ids WHERE identity_sha256 = 'none'
UNION ALL SELECT identity_id, 'duplicate identity alias' FROM ids GROUP BY identity_id HAVING count(*) > 1
UNION ALL SELECT identity_sha256, 'duplicate identity hash' FROM ids GROUP BY identity_sha256 HAVING count(*) > 1
UNION ALL SELECT 'all', 'underpowered confirmatory cohort' FROM (SELECT count(DISTINCT family_id) AS n FROM fam WHERE split = 'confirmatory') WHERE n < 25
UNION ALL SELECT question_class, 'underpowered confirmatory class' FROM fam GROUP BY question_class HAVING count(DISTINCT family_id) FILTER (WHERE split = 'confirmatory') < 20""".strip(), "v_cases").replace(
    "FROM documents)\nSELECT", "FROM documents) SELECT"))
def registry_rules(spark, sf):
    families, identities = _registry(spark, sf)
    return quality.registry_violations(families, identities.drop("custodian_id"), minimum=25, per_class=20)


@query("visible_rows", sql(_REGISTRY + """ SELECT identity_id, family_id FROM ids WHERE family_id IN (SELECT family_id FROM fam WHERE split = 'development')
  AND lang IN (SELECT CASE WHEN r_regionkey % 2 = 0 THEN 'en' ELSE 'fr' END FROM region WHERE lower(r_name) = 'asia')""", "v_cases"))
def visible_rows(spark, sf):
    families, identities = _registry(spark, sf)
    executors = table(spark, sf, "region").select(F.lower("r_name").alias("actor_id"),
        F.when(F.col("r_regionkey") % 2 == 0, "en").otherwise("fr").alias("custodian_id"))
    return quality.visible_rows(identities, families, executors, "asia").select("identity_id", "family_id")


@query("slice_rules", """WITH c AS (SELECT doc_id AS case_id, 'id-' || (doc_id % 950) AS identity_id, CASE WHEN doc_id % 20 = 0 THEN ' ' ELSE text END AS question, lang AS question_class,
  doc_id % 8 > 0 AS duties, CASE WHEN doc_id % 6 > 1 THEN doc_id END AS gold, CASE WHEN doc_id % 6 = 0 THEN 'none' END AS reason, sha256(text) AS source_sha256 FROM documents),
i AS (SELECT 'id-' || doc_id AS identity_id, CASE WHEN doc_id % 10 = 0 THEN sha256('old') ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 4 <> 0),
j AS (SELECT c.*, i.sha, count(*) OVER (PARTITION BY c.identity_id) AS n FROM c LEFT JOIN i USING (identity_id))
SELECT case_id, 'not an authorized development identity' AS rule FROM j WHERE sha IS NULL UNION ALL SELECT case_id, 'repeats a development identity' FROM j WHERE n > 1
UNION ALL SELECT case_id, 'class is not registered' FROM j WHERE sha IS NOT NULL AND question_class NOT IN ('en', 'fr') UNION ALL SELECT case_id, 'question is empty' FROM j WHERE trim(question) = ''
UNION ALL SELECT case_id, 'obligations are empty' FROM j WHERE NOT duties UNION ALL SELECT case_id, 'gold evidence or a reason' FROM j WHERE (gold IS NULL) = (reason IS NULL)
UNION ALL SELECT case_id, 'identity hash drifted' FROM j WHERE source_sha256 <> sha""")
def slice_rules(spark, sf):
    docs, key = table(spark, sf, "documents"), F.col("doc_id")
    cases = docs.select(
        key.alias("case_id"), F.concat(F.lit("id-"), (key % 950).cast("string")).alias("identity_id"),
        F.when(key % 20 == 0, " ").otherwise(F.col("text")).alias("question"), F.col("lang").alias("question_class"),
        F.when(key % 8 > 0, F.array(F.lit("answer"))).otherwise(F.array().cast("array<string>")).alias("obligations"),
        F.when(key % 6 > 1, key).alias("gold_count"), F.when(key % 6 == 0, "none").alias("reason"), F.sha2("text", 256).alias("source_sha256"))
    identities = docs.select(
        F.concat(F.lit("id-"), key.cast("string")).alias("identity_id"), F.when(key % 4 == 0, "confirmatory").otherwise("development").alias("split"),
        F.when(key % 10 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256)).alias("identity_sha256"), F.array(F.lit("en"), F.lit("fr")).alias("classes"))
    return quality.slice_violations(cases, identities)


@query("artifact_verify", """WITH o AS (SELECT 'd/' || doc_id || CASE WHEN doc_id % 40 = 0 THEN '.mp4' ELSE '.txt' END AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha, doc_id FROM documents),
d AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN bytes + 1 ELSE bytes END AS bytes, CASE WHEN doc_id % 17 = 0 THEN sha256('x') ELSE sha END AS sha FROM o WHERE doc_id % 7 <> 0),
r AS (SELECT * FROM o WHERE doc_id % 5 <> 0)
SELECT path, 'repeated in manifest' AS rule FROM o WHERE doc_id % 7 <> 0 AND doc_id % 23 = 0
UNION ALL SELECT path, 'missing' FROM d WHERE path NOT IN (SELECT path FROM r) UNION ALL SELECT path, 'undeclared' FROM r WHERE path NOT IN (SELECT path FROM d)
UNION ALL SELECT d.path, 'size mismatch' FROM d JOIN r USING (path) WHERE d.bytes <> r.bytes UNION ALL SELECT d.path, 'checksum mismatch' FROM d JOIN r USING (path) WHERE d.sha <> r.sha
UNION ALL SELECT path, 'undeclared media' FROM d WHERE ends_with(path, '.mp4')""")
def artifact_verify(spark, sf):
    from timesift.sources.readers import inventory

    key = F.col("doc_id")
    held = inventory(_documents_as_files(spark, sf)).withColumn("doc_id", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    listed = held.where(key % 7 != 0).withColumns({
        "bytes": F.when(key % 11 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")),
        "sha256": F.when(key % 17 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")), "media_included": F.lit(False)})
    declared = listed.unionByName(listed.where(key % 23 == 0))
    return quality.inventory_violations(declared, held.where(key % 5 != 0))


def _documents_as_files(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 40 == 0, ".mp4").otherwise(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"))


@query("artifact_inventory", "SELECT 'd/' || doc_id || CASE WHEN doc_id % 40 = 0 THEN '.mp4' ELSE '.txt' END AS path, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")
def artifact_inventory(spark, sf):
    from timesift.sources.readers import inventory

    return inventory(_documents_as_files(spark, sf))


@query("arm_diff", """WITH r AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 2 = 0 THEN 'control' ELSE 'candidate' END AS arm,
  unnest(['state', 'tokens', 'mode']) AS field, unnest([l_returnflag, CAST(CAST(l_quantity AS BIGINT) // 10 AS VARCHAR), l_linestatus]) AS value FROM lineitem),
b AS (SELECT case_id, field, value, sum(CASE WHEN arm = 'control' THEN 1 ELSE -1 END) AS n FROM r GROUP BY ALL) SELECT DISTINCT case_id, field FROM b WHERE n <> 0""")
def arm_diff(spark, sf):
    pair = F.explode(F.map_from_arrays(F.array(F.lit("state"), F.lit("tokens"), F.lit("mode")), F.array(
        F.col("l_returnflag"), F.floor(F.floor("l_quantity") / 10).cast("string"), F.col("l_linestatus")))).alias("field", "value")
    return quality.arm_diff(table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") % 2 == 0, "control").otherwise("candidate").alias("arm"), pair))


_ACTION = "CASE kind WHEN 'click' THEN 'authorized_open' WHEN 'purchase' THEN 'exposure' WHEN 'error' THEN 'unknown' ELSE 'authorized_open' END"
_BODY = "CAST(to_json({{action: {a}, item_id: {i}, previous_hash: {p}, sequence: {s}}}) AS VARCHAR)"


_CHAIN = f"""e AS (SELECT source_id AS log_id, item_id, {_ACTION} AS action, row_number() OVER (PARTITION BY source_id ORDER BY t, item_id) - 1 AS idx FROM v_points),
chain AS (SELECT log_id, idx, item_id, action, idx + 1 AS sequence, repeat('0', 64) AS previous_hash, sha256({_BODY.format(a='action', i='item_id', p="repeat('0', 64)", s='idx + 1')}) AS record_hash FROM e WHERE idx = 0
  UNION ALL SELECT e.log_id, e.idx, e.item_id, e.action, e.idx + 1, c.record_hash, sha256({_BODY.format(a='e.action', i='e.item_id', p='c.record_hash', s='e.idx + 1')}) FROM chain c JOIN e ON e.log_id = c.log_id AND e.idx = c.idx + 1),
bent AS (SELECT log_id, idx, item_id, action, CASE WHEN item_id % 97 = 0 THEN sequence + 1 ELSE sequence END AS sequence, previous_hash, CASE WHEN item_id % 89 = 0 THEN sha256(record_hash) ELSE record_hash END AS record_hash FROM chain)"""


@query("hash_chain", sql(f"""{_CHAIN},
v AS (SELECT *, coalesce(lag(record_hash) OVER w, repeat('0', 64)) AS before, count(*) FILTER (WHERE action = 'exposure') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent,
  sha256({_BODY.format(a='action', i='item_id', p='previous_hash', s='sequence')}) AS again FROM bent WINDOW w AS (PARTITION BY log_id ORDER BY idx))
SELECT log_id, idx, 'non-append-only sequence' AS rule FROM v WHERE sequence <> idx + 1 UNION ALL SELECT log_id, idx, 'previous_hash does not chain' FROM v WHERE previous_hash <> before
UNION ALL SELECT log_id, idx, 'record_hash does not verify' FROM v WHERE record_hash <> again UNION ALL SELECT log_id, idx, 'unknown action' FROM v WHERE action = 'unknown'
UNION ALL SELECT log_id, idx, 'reuses a spent cohort' FROM v WHERE spent > 0""", "v_points"))
def hash_chain(spark, sf):
    return audit.log_violations(_bent(_chained(spark, sf)))


def _chained(spark, sf):
    events = indexed_points(spark, sf).select(F.col("source_id").alias("log_id"), "idx", "item_id", F.expr(_ACTION).alias("action"))
    return audit.append_records(events)


def _bent(chained):
    """Some records changed after they were written."""
    return chained.withColumns({
        "sequence": F.when(F.col("item_id") % 97 == 0, F.col("sequence") + 1).otherwise(F.col("sequence")),
        "record_hash": F.when(F.col("item_id") % 89 == 0, F.sha2("record_hash", 256)).otherwise(F.col("record_hash"))})


# Four fifths of every log are sealed; every eleventh seal was changed.
@query("log_tail", sql(f"""{_CHAIN},
n AS (SELECT log_id, count(*) * 4 // 5 AS cut FROM e GROUP BY log_id),
s AS (SELECT log_id, count(*) + CASE WHEN log_id % 11 = 3 THEN 1 ELSE 0 END AS rows, arg_max(record_hash, idx) AS last_hash, count(*) FILTER (WHERE action = 'exposure') AS exposures
  FROM chain JOIN n USING (log_id) WHERE idx < cut GROUP BY log_id),
a AS (SELECT bent.*, lag(record_hash) OVER w AS before, count(*) FILTER (WHERE action = 'exposure') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent,
  sha256({_BODY.format(a='action', i='item_id', p='previous_hash', s='sequence')}) AS again FROM bent JOIN n USING (log_id) WHERE idx >= cut WINDOW w AS (PARTITION BY log_id ORDER BY idx)),
v AS (SELECT a.*, coalesce(rows, 0) AS sealed, coalesce(before, last_hash, repeat('0', 64)) AS due, spent + coalesce(exposures, 0) AS used FROM a LEFT JOIN s USING (log_id))
SELECT log_id, idx, 'non-append-only sequence' AS rule FROM v WHERE sequence <> idx + 1 UNION ALL SELECT log_id, idx, 'previous_hash does not chain' FROM v WHERE previous_hash <> due
UNION ALL SELECT log_id, idx, 'record_hash does not verify' FROM v WHERE record_hash <> again UNION ALL SELECT log_id, idx, 'unknown action' FROM v WHERE action = 'unknown'
UNION ALL SELECT log_id, idx, 'reuses a spent cohort' FROM v WHERE used > 0 UNION ALL SELECT log_id, idx, 'does not follow the seal' FROM v WHERE before IS NULL AND idx <> sealed
UNION ALL SELECT log_id, rows, 'seal does not verify' FROM s WHERE log_id % 11 = 3""", "v_points"))
def log_tail(spark, sf):
    chained = cut_lineage(_chained(spark, sf))
    cuts = chained.groupBy("log_id").agg(F.floor(F.count(F.lit(1)) * 4 / 5).alias("cut"))
    parted = chained.join(cuts, "log_id")
    sealed = audit.seals(parted.where("idx < cut")).withColumn(
        "rows", F.col("rows") + F.when(F.col("log_id") % 11 == 3, 1).otherwise(0))
    return audit.tail_violations(sealed, _bent(parted.where("idx >= cut").drop("cut")))


@query("coverage_gaps", sql("""req AS (SELECT DISTINCT family_id, question_class AS c FROM v_cases WHERE case_id % 2 = 0),
cov AS (SELECT DISTINCT family_id, question_class AS c FROM v_cases WHERE case_id % 2 = 1 AND length(question_class) > family_id % 9),
renv AS (SELECT DISTINCT family_id, environment_id AS c FROM v_cases),
cenv AS (SELECT DISTINCT family_id, environment_id AS c FROM v_cases WHERE environment_id <> CASE WHEN family_id % 4 = 0 THEN 'P' ELSE '' END)
SELECT family_id AS gate_id, 'class is not covered' AS rule, c AS missing FROM (SELECT * FROM req EXCEPT SELECT * FROM cov)
UNION ALL SELECT family_id, 'environment is not covered', c FROM (SELECT * FROM renv EXCEPT SELECT * FROM cenv)
UNION ALL SELECT family_id, 'environment is unknown', c FROM renv WHERE c NOT IN ('F', 'O')""", "v_cases"))
def coverage_gaps(spark, sf):
    even, kind, env = F.col("case_id") % 2 == 0, F.col("question_class"), F.col("environment_id")
    hidden = F.when(F.col("family_id") % 4 == 0, "P").otherwise("")
    gates = views.cases(spark, sf).groupBy(F.col("family_id").alias("gate_id")).agg(
        F.collect_set(F.when(even, kind)).alias("required_classes"),
        F.collect_set(F.when(~even & (F.length(kind) > F.col("family_id") % 9), kind)).alias("covered_classes"),
        F.collect_set(env).alias("required_environments"), F.collect_set(F.when(env != hidden, env)).alias("covered_environments"))
    return quality.coverage_gaps(gates, ["F", "O"])


@query("manifest_rules", """WITH b AS (SELECT doc_id, doc_id % 12 AS v, json_object('bundle_schema_version', CASE doc_id % 12 WHEN 1 THEN 2 ELSE 1 END,
  'tool_versions', CASE doc_id % 12 WHEN 2 THEN CAST('{}' AS JSON) ELSE json_object('engine', lang) END, 'schema_versions', json_object('evidence', '1'),
  'evidence_budget', json_object('chars', n_chars), 'completeness_state', CASE doc_id % 12 WHEN 3 THEN 'unknown' WHEN 4 THEN 'partial' ELSE 'complete' END,
  'provenance', CASE doc_id % 12 WHEN 5 THEN CAST('{}' AS JSON) ELSE json_object('source', source) END, 'media_included', false,
  'files', CASE doc_id % 12 WHEN 7 THEN CAST('[]' AS JSON) ELSE json_array(sha256(text)) END) AS j FROM documents),
m AS (SELECT doc_id, CASE v WHEN 6 THEN json_merge_patch(j, '{"media_included": null}') WHEN 8 THEN json_merge_patch(j, '{"note": "x"}') ELSE j END AS j FROM b)
SELECT doc_id, CASE WHEN list_sort(json_keys(j)) <> ['bundle_schema_version', 'completeness_state', 'evidence_budget', 'files', 'media_included', 'provenance', 'schema_versions', 'tool_versions']
    THEN 'fields are missing or unknown'
  WHEN CAST(j->>'bundle_schema_version' AS BIGINT) <> 1 THEN 'another bundle schema' WHEN len(json_keys(j->'tool_versions')) = 0 THEN 'no tool versions'
  WHEN len(json_keys(j->'schema_versions')) = 0 THEN 'no schema versions' WHEN json_type(j->'evidence_budget') <> 'OBJECT' THEN 'no evidence budget'
  WHEN (j->>'completeness_state') NOT IN ('complete', 'partial', 'degraded') THEN 'invalid completeness' WHEN len(json_keys(j->'provenance')) = 0 THEN 'no provenance'
  WHEN json_type(j->'media_included') <> 'BOOLEAN' THEN 'no media declaration' WHEN json_array_length(j->'files') = 0 THEN 'no files' END AS refusal FROM m""")
def manifest_rules(spark, sf):
    fault = F.col("doc_id") % 12
    none = F.create_map().cast("map<string, string>")

    def unless(n, value):
        return F.when(fault == n, none).otherwise(value)

    manifest = F.to_json(F.struct(
        F.when(fault == 1, 2).otherwise(1).alias("bundle_schema_version"), unless(2, F.create_map(F.lit("engine"), F.col("lang"))).alias("tool_versions"),
        F.create_map(F.lit("evidence"), F.lit("1")).alias("schema_versions"), F.create_map(F.lit("chars"), F.col("n_chars")).alias("evidence_budget"),
        F.when(fault == 3, "unknown").when(fault == 4, "partial").otherwise("complete").alias("completeness_state"),
        unless(5, F.create_map(F.lit("source"), F.col("source"))).alias("provenance"), F.when(fault != 6, False).alias("media_included"),
        F.when(fault == 7, F.array().cast("array<string>")).otherwise(F.array(F.sha2("text", 256))).alias("files"), F.when(fault == 8, "x").alias("note")))
    return table(spark, sf, "documents").select("doc_id", manifest.alias("manifest")).select("doc_id", quality.manifest_refusal().alias("refusal"))
