"""The registry, and a cross-section of queries against their SQL twins on the smallest tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry_points  # noqa: E402
from check_queries import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
PICKED = ["tokenize_norm", "sentence_stream", "url_identity", "secret_scan", "payload_scan", "spaced_topk", "rolling_dedupe", "build_spans", "stretch_spans", "gap_fill", "span_score", "lexical_rank", "frame_dedupe_window",
          "chunk_plan", "budget_prefix", "fallback_choice", "evidence_match", "latency_gate", "gate_decision", "gate_refused", "facet_expansion", "targeted_evidence", "coverage_evidence", "row_rules", "hash_chain", "subtitle_parse"]


def test_registry_is_whole():
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and set(PICKED) <= set(oracles)
    assert len(queries) >= 110


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    df = entry_points.queries()[name](spark, SF)
    cur = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1


def test_hash_similarity_deals_lines_once(spark):
    """A line is hashed once, and no line is dealt again by block."""
    plan = entry_points.queries()["hash_similarity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__block" not in plan and plan.count("sha2(") == 1
