"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timesift.plans import all_queries  # noqa: E402
from timesift.session import build_session, clear_tables  # noqa: E402

HEADLINE = ["tokenize_norm", "rolling_dedupe", "build_spans", "span_score", "lexical_rank", "fuzzy_rescue", "targeted_evidence",
            "coverage_evidence", "frame_dedupe_window", "chunk_plan", "budget_prefix", "evidence_match", "latency_gate",
            "case_delta", "gate_decision", "row_rules", "hash_chain"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) * 2, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, spent = all_queries(), {}
    spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
        clear_tables(spark)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    sources = spark.read.parquet(f"{sf}/documents.parquet").count()
    questions = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": sf,
        "sources_per_s_scout": round(sources / spent["build_spans"], 1),
        "question_source_pairs_per_s": round(sources * questions / spent["targeted_evidence"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
