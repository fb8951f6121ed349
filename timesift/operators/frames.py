"""Thinning of frames and other timed items.

Frames are ``(source_id, idx, ts, thumb)`` with ``idx`` dense from 0 in time order. The passes
read the signature column only inside the fold; nothing compares all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timesift.functions import fixed, measures
from timesift.operators.keyed import ordered_fold, row_index, with_previous
from timesift.operators.spacing import keep_spaced
from timesift.session import cut_lineage

KEY = ["source_id"]


def _signature(thumb) -> list[int]:
    return [int(x) for x in thumb]


def mark_near_duplicates(frames: DataFrame, threshold: float = fixed.FRAME_DELTA_THRESHOLD) -> DataFrame:
    """Adds ``keeper``: the frame itself, or the last kept frame it hardly differs from."""

    def step(state, idx: int, thumb):
        if state is not None:
            last = np.asarray(state[0])
            now = np.asarray(thumb, dtype=np.int64)
            if len(now) and len(now) == len(last) and np.abs(now - last).mean() <= threshold:
                return (state[1],), state
        return (int(idx),), [_signature(thumb), int(idx)]

    return ordered_fold(frames.select("source_id", "idx", "ts", "thumb"), KEY, "idx", ["idx", "thumb"], step, "keeper int")


def mark_windowed(frames: DataFrame, tolerance: int = fixed.CELL_TOLERANCE,
                  allowed_pct: float = fixed.CHANGED_PCT_THRESHOLD, memory: int = fixed.WINDOW_SIZE,
                  horizon: float = fixed.WINDOW_HORIZON_SECONDS) -> DataFrame:
    """Adds ``keeper``: the frame itself, or the last kept one when it repeats a shot that is among
    the last ``memory`` kept and at most ``horizon`` seconds old. Signatures hold three channels."""

    def repeats(now, seen) -> bool:
        if not len(now) or len(now) != len(seen) or len(now) % 3:
            return False
        moved = np.abs(now - np.asarray(seen)).reshape(-1, 3).max(axis=1) > tolerance
        return moved.sum() <= allowed_pct * len(moved) / 100.0

    def step(state, idx: int, ts: float, thumb):
        now = np.asarray(thumb, dtype=np.int64)
        if state is not None:
            recent, keeper = state
            if any(ts - at <= horizon and repeats(now, seen) for seen, at in recent):
                return (keeper,), state
        else:
            recent = []
        return (int(idx),), [[*recent, [_signature(thumb), float(ts)]][-memory:], int(idx)]

    return ordered_fold(frames.select("source_id", "idx", "ts", "thumb"), KEY, "idx", ["idx", "ts", "thumb"], step, "keeper int")


def gap_fill(marked: DataFrame, limits: DataFrame) -> DataFrame:
    """Dropped frames to put back where kept ones are too far apart: (source_id, idx, ts).

    ``marked`` is ``(source_id, idx, ts, keeper)``, ``limits`` ``(source_id, floor_s, max_fill)``. A gap
    takes the dropped frame nearest its middle, then its left half is looked at, then its right one.
    Gaps do not touch each other, so all halves of one depth are filled in one join; the visiting
    order is the order of the left/right path, which the ``max_fill`` bound follows.
    """
    slim = cut_lineage(marked.select("source_id", "idx", "ts", "keeper"))
    kept = row_index(slim.where("keeper = idx").select("source_id", "idx", "ts"), KEY, [F.col("idx")],
                     F.floor(F.col("idx") / 65536), "at")
    gaps = with_previous(kept, KEY, "at", {"to_ts": "ts"}, ahead=True).join(limits, "source_id").where(
        (F.col("max_fill") > 0) & (F.col("to_ts") - F.col("ts") > F.col("floor_s"))).select(
        "source_id", F.col("idx").alias("gap"), F.lit("").alias("path"), F.col("ts").alias("a"),
        F.col("to_ts").alias("b"), "floor_s")
    pool = slim.where("keeper <> idx").select("source_id", F.col("keeper").alias("gap"), "idx", "ts")
    found = None
    gaps = cut_lineage(gaps)
    while not gaps.isEmpty():
        middle = (F.col("a") + F.col("b")) / 2
        picked = cut_lineage(
            gaps.join(pool, ["source_id", "gap"]).where("ts > a and ts < b")
            .groupBy("source_id", "gap", "path", "a", "b", "floor_s")
            .agg(F.min_by(F.struct("idx", "ts"), F.struct(F.abs(F.col("ts") - middle), "ts", "idx")).alias("p")))
        fills = picked.select("source_id", "gap", "path", F.col("p.idx").alias("idx"), F.col("p.ts").alias("ts"))
        found = fills if found is None else found.unionByName(fills)
        halves = F.array(F.struct(F.lit("0").alias("side"), F.col("a"), F.col("p.ts").alias("b")),
                         F.struct(F.lit("1").alias("side"), F.col("p.ts").alias("a"), F.col("b")))
        gaps = cut_lineage(picked.withColumn("h", F.explode(halves)).select(
            "source_id", "gap", F.concat("path", F.col("h.side")).alias("path"), F.col("h.a").alias("a"),
            F.col("h.b").alias("b"), "floor_s").where("b - a > floor_s"))
    if found is None:
        return slim.select("source_id", "idx", "ts").limit(0)
    placed = row_index(found, KEY, [F.col("gap"), F.col("path")], F.floor(F.col("gap") / 65536), "__n")
    return placed.join(limits, "source_id").where("__n < max_fill").select("source_id", "idx", "ts")


def even_sample(rows: DataFrame, wanted: Column, order: str = "idx") -> DataFrame:
    """Evenly spread rows of each source, first and last included."""
    placed = row_index(rows, KEY, [F.col(order)], F.floor(F.col(order) / 65536), "__at")
    counts = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__n"))
    return placed.join(counts, KEY).where(measures.even_pick(F.col("__at"), F.col("__n"), wanted)).drop("__at", "__n")


def select_frames(frames: DataFrame, budget: int = 100, min_shots: int = fixed.SCENE_MIN_FRAMES,
                  target: int | None = None, **window) -> DataFrame:
    """(source_id, idx, ts, engine): windowed thinning, gap fill and an even sample; sources with too
    few real shots fall back to an even grid of their frames, thinned the same way."""
    frames = cut_lineage(frames.select("source_id", "idx", "ts", "thumb"))
    max_fill = int(fixed.FLOOR_CAP_SHARE * budget)
    shape = frames.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("duration"))
    floor_s = F.greatest(F.lit(fixed.FLOOR_INTERVAL_SECONDS), F.col("duration") / max(max_fill, 1))
    shape = shape.withColumn("floor_s", floor_s).withColumn(
        "shots", F.col("n") - F.when(F.col("duration") > 0, F.floor(F.col("duration") / floor_s)).otherwise(0))
    busy, quiet = shape.where(F.col("shots") >= min_shots), shape.where(F.col("shots") < min_shots)
    marked = cut_lineage(mark_windowed(frames.join(busy.select("source_id"), KEY, "left_semi"), **window).drop("thumb"))
    limits = busy.select("source_id", "floor_s", F.lit(max_fill).alias("max_fill"))
    kept = marked.where("keeper = idx").select("source_id", "idx", "ts").unionByName(gap_fill(marked, limits))
    scene = even_sample(kept, F.lit(budget)).withColumn("engine", F.lit("scene"))
    grid = even_sample(frames.join(quiet.select("source_id"), KEY, "left_semi"), F.lit(min(budget, target or budget)))
    regrid = row_index(grid.withColumnRenamed("idx", "__old"), KEY, [F.col("__old")], F.floor(F.col("__old") / 65536))
    thinned = mark_windowed(regrid.withColumn("idx", F.col("idx").cast("int")), **window)
    uniform = thinned.where("keeper = idx").join(
        regrid.select("source_id", F.col("idx").cast("int").alias("idx"), "__old"), ["source_id", "idx"]).select(
        "source_id", F.col("__old").alias("idx"), "ts", F.lit("uniform").alias("engine"))
    return scene.unionByName(uniform)


def spaced_topk(items: DataFrame, budget: int, spacing: float = 1.0) -> DataFrame:
    """Best-scored ``(source_id, item_id, t, score)`` at least ``spacing`` apart, ``budget`` a source."""
    rank = [F.col("score").isNull(), -F.col("score"), F.col("t"), F.col("item_id")]
    return keep_spaced(items, KEY, "t", rank, spacing, F.lit(budget))


def merge_timeline(primary: DataFrame, pinned: DataFrame) -> DataFrame:
    """Both lists in time order with new positions; at one time the primary item comes first."""
    both = primary.withColumn("__side", F.lit(0)).unionByName(pinned.withColumn("__side", F.lit(1)))
    return row_index(both, KEY, [F.col("t"), F.col("__side"), F.col("item_id")], F.floor(F.col("t") / 3600)).drop("__side")


def gap_stats(placed: DataFrame) -> DataFrame:
    """(source_id, max_gap, mean_gap) between neighbours of ``(source_id, idx, t)``."""
    stepped = with_previous(placed, KEY, "idx", {"__next": "t"}, ahead=True)
    gap = F.col("__next") - F.col("t")
    return stepped.where("__next is not null").groupBy("source_id").agg(
        F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"))
