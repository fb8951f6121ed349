"""Row-level measures: frames, budgets, scores, intervals, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timesift.functions import fixed


def frame_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference of two signatures; infinite when they do not line up."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, d: s + d)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), total / F.size(a)).otherwise(F.lit(float("inf")))


def changed_cell_pct(a: Column, b: Column) -> Column:
    """Share (in %) of three-channel cells whose largest channel change passes the tolerance."""
    cells = F.sequence(F.lit(0), F.floor(F.size(a) / 3).cast("int") - 1)
    gap = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    def moved(i: Column) -> Column:
        return F.greatest(F.get(gap, i * 3), F.get(gap, i * 3 + 1), F.get(gap, i * 3 + 2)) > fixed.CELL_TOLERANCE
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.size(a) % 3 == 0)
    return F.when(ok, F.size(F.filter(cells, moved)) * 100.0 / F.floor(F.size(a) / 3)).otherwise(
        F.lit(float("inf")))


def visual_score(scene: Column, luminance: Column, edge: Column, cue: Column) -> Column:
    zero = F.lit(0.0)
    return (F.lit(0.55) * F.greatest(zero, scene) + F.lit(0.25) * F.greatest(zero, edge)
            + F.lit(0.20) * F.greatest(zero, luminance) + F.when(cue, 1.0).otherwise(0.0))


def auto_target(duration: Column, cap: Column) -> Column:
    """Frame target of a full scan, by duration."""
    return (F.when(duration <= 30, F.least(cap, F.greatest(F.lit(12), F.rint(duration).cast("int"))))
            .when(duration <= 60, F.least(cap, F.lit(40))).when(duration <= 180, F.least(cap, F.lit(60)))
            .when(duration <= 600, F.least(cap, F.lit(80))).otherwise(cap))


def focus_target(duration: Column, cap: Column) -> Column:
    """Denser target of a chosen range."""
    return (F.when(duration <= 5, F.least(cap, F.greatest(F.lit(10), F.rint(duration * 6).cast("int"))))
            .when(duration <= 15, F.least(cap, F.greatest(F.lit(30), F.rint(duration * 4).cast("int"))))
            .when(duration <= 30, F.least(cap, F.lit(60))).when(duration <= 60, F.least(cap, F.lit(80)))
            .otherwise(cap))


def bounded_fps(fps: Column, duration: Column, cap: Column) -> tuple[Column, Column]:
    """(fps, frames) with fps held to the automatic maximum and at least one frame."""
    held = F.least(fps, F.lit(fixed.MAX_FPS))
    return held, F.least(cap, F.greatest(F.lit(1), F.rint(held * duration).cast("int")))


def coverage_fps(user_fps: Column, duration: Column, cap: Column) -> Column:
    """A requested fps, lowered so that the whole window stays covered."""
    ceiling = F.lit(fixed.FPS_FRAME_CEILING)
    return (F.when(duration <= 0, user_fps)
            .when(cap.isNotNull() & (cap != 0),
                  F.least(user_fps, F.greatest(cap / duration, F.lit(0.001))))
            .when(user_fps * duration > ceiling, ceiling / duration).otherwise(user_fps))


def frame_cap(detail: Column) -> Column:
    return (F.when(detail == "efficient", 50).when(detail.isin("token-burner", "transcript"), None)
            .otherwise(100))


def reader_budget(chars: Column, max_frames: Column) -> Column:
    left = F.lit(fixed.EVIDENCE_TOKEN_CAP) - F.floor(chars * fixed.TOKENS_PER_CHAR)
    return F.least(max_frames, F.greatest(F.lit(fixed.MIN_FRAMES), F.floor(left / fixed.TOKENS_PER_FRAME)))


def judge_score(correctness: Column, completeness: Column, citation: Column, adherence: Column) -> Column:
    """Weighted rubric; null when a value is not within 0 to 10."""
    values = {"correctness": correctness, "completeness": completeness, "citation": citation,
              "adherence": adherence}
    ok, total = F.lit(True), F.lit(0.0)
    for name, weight in fixed.RUBRIC.items():
        ok = ok & values[name].between(0, 10)
        total = total + F.lit(weight) * values[name]
    return F.when(ok, total)


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the hull of two intervals."""
    cut = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, cut / hull).otherwise(F.lit(0.0))


def estimated_tokens(chars: Column, frames: Column) -> Column:
    return chars * fixed.TOKENS_PER_CHAR + frames * fixed.TOKENS_PER_FRAME


def reported_tokens(chars: Column, width: Column, height: Column, frames: Column) -> Column:
    """The rule of the published tables: characters / 3.6 plus pixels / 750 per frame."""
    return chars / 3.6 + frames * (width * height / 750.0)


def even_positions(count: Column, wanted: Column) -> Column:
    """``wanted`` evenly spread positions of ``count``, first and last included, halves to even."""
    spread = F.transform(F.sequence(F.lit(0), F.greatest(wanted - 1, F.lit(0)).cast("int")),
                         lambda i: F.rint(i * (count - 1) / F.greatest(wanted - 1, F.lit(1))).cast("int"))
    return (F.when(count <= 0, F.array().cast("array<int>"))
            .when(wanted >= count, F.sequence(F.lit(0), count.cast("int") - 1))
            .when(wanted <= 1, F.array(F.lit(0))).otherwise(spread))


def even_pick(position: Column, count: Column, wanted: Column) -> Column:
    """Whether a row position is one of the evenly spread ones; no list is built."""
    last = F.greatest(count - 1, F.lit(1))
    near = F.floor(position * (wanted - 1) / last)
    hit = F.lit(False)
    for shift in (-1, 0, 1, 2):
        i = near + shift
        hit = hit | ((i >= 0) & (i < wanted) & (F.rint(i * (count - 1) / F.greatest(wanted - 1, F.lit(1))) == position))
    return F.when(wanted >= count, True).when(wanted <= 1, position == 0).otherwise(hit)
