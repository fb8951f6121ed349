"""Frame thinning at its boundaries and against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from timesift.functions import measures
from timesift.operators import frames, keyed

FRAME = "source_id long, idx int, ts double, thumb array<int>"


def make(spark, thumbs, times=None, source=1):
    times = times or [2.0 * i for i in range(len(thumbs))]
    return spark.createDataFrame([(source, i, float(t), list(x)) for i, (t, x) in enumerate(zip(times, thumbs))], FRAME)


def keepers(df):
    return [r.keeper for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize("block", [2, 1000])
def test_last_kept_decides_and_threshold_is_inclusive(spark, monkeypatch, block):
    monkeypatch.setattr(keyed, "BLOCK_ROWS", block)
    slow = [[i] * 4 for i in (0, 1, 2, 3, 4, 6, 9)]
    assert keepers(frames.mark_near_duplicates(make(spark, slow))) == [0, 0, 0, 3, 3, 5, 6]
    assert keepers(frames.mark_near_duplicates(make(spark, [[0] * 4, [0] * 3, [0] * 3]))) == [0, 1, 1]


def shot(v, n=8):
    return [v] * (3 * n)


def test_window_remembers_four_shots_for_ninety_seconds(spark):
    aba = [shot(0), shot(100), shot(0), shot(200), shot(50), shot(150), shot(0)]
    assert keepers(frames.mark_windowed(make(spark, aba))) == [0, 1, 1, 3, 4, 5, 6]
    assert keepers(frames.mark_windowed(make(spark, [shot(0), shot(100), shot(0)], [0, 10, 90]))) == [0, 1, 1]
    assert keepers(frames.mark_windowed(make(spark, [shot(0), shot(100), shot(0)], [0, 10, 90.5]))) == [0, 1, 2]


def test_cell_share(spark):
    base = [0] * 300
    two = [26] * 3 * 2 + [0] * 294
    three = [0, 26, 0] * 3 + [0] * 291
    df = spark.createDataFrame([(base, two), (base, three), (base, [25] * 300), (base, [0] * 3)], "a array<int>, b array<int>")
    got = [r.p for r in df.select(measures.changed_cell_pct(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [2.0, 3.0, 0.0, float("inf")]
    pairs = spark.createDataFrame([([1, 2], [3, 4]), ([1], [1, 2])], "a array<int>, b array<int>")
    assert [r.d for r in pairs.select(measures.frame_delta(F.col("a"), F.col("b")).alias("d")).collect()] == [2.0, float("inf")]


def filled(kept, pool, floor, most):
    """Plain left-to-right fill: nearest to the middle, then the left part again."""
    out, fills = [], []
    def walk(a, b):
        inside = [p for p in pool if a < p < b]
        if b - a > floor and inside:
            m = min(inside, key=lambda p: (abs(p - (a + b) / 2), p))
            fills.append(m)
            walk(a, m)
            walk(m, b)
    for a, b in zip(kept, kept[1:]):
        walk(a, b)
    return sorted(fills[:most]) + out


@pytest.mark.parametrize("seed,most", [(1, 100), (2, 6), (3, 1), (4, 0)])
def test_gap_fill(spark, seed, most):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(0, 900), 70))
    keeper, rows = 0, []
    for i, t in enumerate(times):
        if i == 0 or rng.random() < 0.12 or i == len(times) - 1:
            keeper = i
        rows.append((1, i, float(t), keeper))
    marked = spark.createDataFrame(rows, "source_id long, idx int, ts double, keeper int")
    limits = spark.createDataFrame([(1, 40.0, most)], "source_id long, floor_s double, max_fill int")
    got = sorted(r.ts for r in frames.gap_fill(marked, limits).collect())
    kept = [r[2] for r in rows if r[1] == r[3]]
    assert got == filled(kept, [r[2] for r in rows if r[1] != r[3]], 40.0, most)


def test_selection_falls_back_when_nothing_moves(spark):
    still = make(spark, [shot(0)] * 12, [10.0 * i for i in range(12)], 1)
    busy = make(spark, [shot(30 * i) for i in range(12)], [10.0 * i for i in range(12)], 2)
    got = frames.select_frames(still.unionByName(busy), budget=100, min_shots=10).collect()
    engines = {r.source_id: r.engine for r in got}
    assert engines[1] == "uniform" and engines[2] == "uniform"
    again = frames.select_frames(still.unionByName(busy), budget=100, min_shots=8).collect()
    assert sum(r.source_id == 2 for r in again) == 12 and all(r.engine == "scene" for r in again)
    # The still source keeps its first shot, one past the horizon, and what the gap fill puts back.
    assert {r.idx for r in again if r.source_id == 1} >= {0, 10}


@pytest.mark.parametrize("block", [3, 1000])
def test_spaced_topk(spark, monkeypatch, block):
    monkeypatch.setattr(keyed, "BLOCK_ROWS", block)
    rng = random.Random(2)
    items = [(1, i, rng.random() * 30, rng.randrange(0, 6) * 1.0) for i in range(40)]
    kept = []
    for i in sorted(items, key=lambda x: (-x[3], x[2], x[1])):
        if len(kept) < 7 and all(abs(i[2] - k[2]) >= 1.5 for k in kept):
            kept.append(i)
    got = frames.spaced_topk(spark.createDataFrame(items, "source_id long, item_id long, t double, score double"), 7, 1.5)
    assert sorted(r.item_id for r in got.collect()) == sorted(k[1] for k in kept)
