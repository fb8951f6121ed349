"""The permutation index: footrule, recall against brute force, ties and unusable vectors."""

import os

import numpy as np
import pytest

from timesift.llm import neighbours as nb
from timesift.llm.common import table

SF = "/root/testdata/sf0.1"


def brute(rows, every, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        dist = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, dist)) if ids[j] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[j]), float(dist[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_footrule_of_inverted_files():
    rng = np.random.default_rng(1)
    pivots, x, q = rng.normal(size=(24, 8)), rng.normal(size=(50, 8)), rng.normal(size=(1, 8))
    prefix = 10
    ranks, asked = nb.places(x, pivots, prefix), nb.places(q, pivots, prefix)[0]
    want = np.abs(ranks.astype(int) - asked.astype(int)).sum(axis=1)
    got = np.zeros(50, dtype=int)
    for p in np.flatnonzero(asked < prefix):
        rows, at = nb.inverted_files(ranks, prefix)[p]
        got[rows] += np.abs(at - asked[p]) - (prefix - at) - (prefix - int(asked[p]))
    assert len(set((want - got).tolist())) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_recall_on_the_table(spark):
    df = table(spark, SF, "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 100)
    got = answers(nb.nearest_neighbours(df))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.93 * 10 * len(want)
    exact = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, v in got.items() for i, s in v if (q, i) in exact)


def test_ties_repeated_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 60)]
    same = [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows += [(i, same) for i in range(100, 140)]
    odd = [(600, None), (700, [0.0] * 6), (800, [float("nan")] + [1.0] * 5), (None, same), (601, [1.0, None] + [0.0] * 4), (602, [float("inf")] * 6),
           (603, [1.0, 2.0]), (100, same), (5, rows[4][1])]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("v", F.lit("x"))
    rows = [(i, np.array(v, dtype=np.float32).astype(float).tolist()) for i, v in rows]
    got = answers(nb.nearest_neighbours(df, 20))
    assert got == brute(rows, 20)
    assert [i for i, _ in got[100]] == list(range(101, 111))


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert answers(nb.nearest_neighbours(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema))) == {0: [(1, 1.0)]}
    assert nb.nearest_neighbours(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert nb.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0


def test_blocks_meet_without_a_broadcast(spark, monkeypatch):
    """Blocks are repeated only on the way to the tasks: no broadcast holds them; however they meet, the answers are the same."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 6) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks, queries, meetings in ((8, 64, 48), (2, 1, 1), (3, 2, 2)):
        for name, value in (("BLOCK_ROWS", 25), ("QUERY_ROWS", 7), ("MEET_BLOCKS", blocks), ("MEET_QUERIES", queries), ("MEETINGS", meetings)):
            monkeypatch.setattr(nb, name, value)
        table = nb.usable(df)
        pivots = nb.pick_pivots(table)
        found = nb.search(nb.build_index(table, pivots, 25), nb.build_index(table.filter("vec_id % 10 = 0"), pivots, 7))
        assert answers(found) == brute(rows, 10)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
