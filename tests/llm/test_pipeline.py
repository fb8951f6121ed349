"""Each stage against brute force over what the stage before kept, and the queries' SQL twins."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from helpers import docs
from test_decontaminate import brute as overlap
from test_jaccard import brute as near
from timesift.llm import mixing, quality
from timesift.llm.common import cut_lineage, table

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_stages_in_turn(spark):
    docs_ = table(spark, SF, "documents")
    names, kept = docs_.columns, [docs_]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(cut_lineage(stage(spark, kept[-1], SF)))
    assert all(k.columns == names for k in kept[:5])
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept[:5]]
    scores = {r.doc_id: r.predicted for r in quality.score_quality(docs_, table(spark, SF, "labels")).collect()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if scores[r[0]])
    assert sorted(d for d, _ in rows[2]) == sorted({c for _, _, c in near(rows[1])})
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(rows[3]) == sorted(r for r in rows[2] if not overlap(r[1], items)[3])
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert sorted(rows[4]) == sorted(r for r in rows[3] for _ in range(copies[r[0]]))
    assert sorted(r.doc_id for r in kept[5].collect()) == sorted(d for d, _ in rows[4])


def test_stages_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "The cat sat on the mat and was glad of it."), (3, "The cat sat on the mat and was glad of it."), (3, "The cat sat on the mat and was glad of it.")]
    for _, stage in corpus_pipeline.STAGES[1:]:
        for table_ in (docs(spark, rows, extra=True), docs(spark, rows).limit(0)):
            out = stage(spark, table_, SF)
            assert out.count() <= 3 * len(rows)
    one = corpus_pipeline.one_of_each_group(spark, docs(spark, rows), SF).collect()
    assert sorted((r.doc_id for r in one), key=repr) == [1, 2, 3]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op4_decontaminate", "op6_mix", "op7_jaccard"])
def test_query_equals_sql(spark, name):
    from check_queries import rows_of
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SF}/{file}'")
    df = entry_points.queries()[name](spark, SF)
    cur = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_all_are_registered():
    names = entry_points.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
