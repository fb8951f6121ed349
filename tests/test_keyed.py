"""Blocked building blocks against plain Python, with blocks far smaller than a key."""

import math
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from timesift.operators import keyed

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark, n=61, seed=3):
    rng = random.Random(seed)
    data = [(k, i, rng.randrange(1, 9), rng.random() * 40) for k, size in (("hot", n), ("cold", 3), ("one", 1)) for i in range(size)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, idx long, n int, v double").repartition(3)


def by_key(data):
    out = {}
    for row in sorted(data, key=lambda r: (r[0], r[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("block", [4, 64, None])
def test_previous_row_crosses_block_edges(spark, block, ahead):
    data, df = table(spark)
    got = {(r.k, r.idx): r.near for r in keyed.with_previous(df, ["k"], "idx", {"near": "n"}, block, ahead=ahead).collect()}
    for key, part in by_key(data).items():
        for i, row in enumerate(part):
            j = i + 1 if ahead else i - 1
            assert got[(key, row[1])] == (part[j][2] if 0 <= j < len(part) else None)
    assert len(got) == len(data)


@pytest.mark.parametrize("block", [4, 64, None])
def test_running_totals(spark, block):
    data, df = table(spark)
    got = {(r.k, r.idx): r.total for r in keyed.running_totals(df, ["k"], "idx", {"total": F.col("n")}, block_rows=block).collect()}
    top = {(r.k, r.idx): r.top for r in keyed.running_totals(df, ["k"], "idx", {"top": F.col("n")}, F.max, block_rows=block).collect()}
    for key, part in by_key(data).items():
        for i, row in enumerate(part):
            assert got[(key, row[1])] == sum(r[2] for r in part[: i + 1])
            assert top[(key, row[1])] == max(r[2] for r in part[: i + 1])


def test_row_index_uses_coarse_buckets(spark):
    data, df = table(spark)
    placed = keyed.row_index(df.drop("idx"), ["k"], [F.col("v")], F.floor(F.col("v") / 7)).collect()
    for key, part in by_key(data).items():
        order = sorted(r[3] for r in part)
        assert {r.v: r.idx for r in placed if r.k == key} == {v: i for i, v in enumerate(order)}


@pytest.mark.parametrize("width", [0.5, 7.0, 1000.0])
def test_order_statistics_are_exact(spark, width):
    data, df = table(spark)
    stats = keyed.order_statistics(df, ["k"], "v", {"mid": "median", "p95": 0.95, "low": 0.05}, width).collect()
    assert len(stats) == 3
    for r in stats:
        v = sorted(x[3] for x in data if x[0] == r.k)
        mid = v[len(v) // 2] if len(v) % 2 else (v[len(v) // 2 - 1] + v[len(v) // 2]) / 2
        assert (r.n, r.mid) == (len(v), mid)
        assert r.p95 == v[max(0, math.ceil(0.95 * len(v)) - 1)] and r.low == v[max(0, math.ceil(0.05 * len(v)) - 1)]


def greedy(state, v):
    if state is None or v - state >= 5 or v < state - 11:
        return (v,), v
    return None, state


def counting(state, v):
    """Never forgets: the incoming state of every block changes."""
    state = (state or 0) + v
    return (state,), state


@pytest.mark.parametrize("step", [greedy, counting])
@pytest.mark.parametrize("block", [3, 8, 1000])
def test_fold_over_blocks_equals_one_pass(spark, step, block):
    data, df = table(spark)
    out = keyed.ordered_fold(df, ["k"], "idx", ["v"], step, "kept double", block_rows=block)
    got = {(r.k, r.idx): r.kept for r in out.collect()}
    want = {}
    for key, part in by_key(data).items():
        state = None
        for row in part:
            kept, state = step(state, row[3])
            if kept is not None:
                want[(key, row[1])] = kept[0]
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert out.columns == ["k", "idx", "n", "v", "kept"]
