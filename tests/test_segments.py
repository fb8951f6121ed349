"""Segments: the cue fixture, rolling captions, chapters and spans, also across blocks."""

import random

import pytest

from timesift.operators import keyed
from timesift.operators import segments as ops

CUES = [
    (0, 5, "hello and welcome to the workshop"), (9, 13, "there are several bikes on the stands this week"),
    (17, 21, "so we begin right away"), (61, 66, "this cargo bike is our newest cargo bike and it carries two crates"),
    (71, 77, "the bike has wide tyres strong brakes and a longer frame"),
    (96, 102, "the cost of the bike went down since spring"),
    (104, 110, "look at the picture of the frame here"),
    (181, 187, "next we visit the paint room"),
    (201, 207, "a tin of lacquer is $5 for every frame"),
    (241, 246, "the drying oven is really fast faster than fresh air"), (271, 277, "and that was the tour")]
SEGMENT = "source_id long, seg_idx int, start_s double, end_s double, text string"


def segments(spark, cues=CUES, source=1):
    return spark.createDataFrame([(source, i, float(a), float(b), t) for i, (a, b, t) in enumerate(cues)], SEGMENT)


CAPTIONS = ["the river runs south", "river runs south past the mill", "the mill", "mill wheel turns at dawn", "at dawn",
            "turns at dawn slowly and turns", "quiet now", "now so", "evening"]
# Kept: whole captions, and what follows a repeated opening of eight characters or more. Gone: captions inside the last
# kept one, and one whose first half ends it.
KEPT = [(0, "the river runs south"), (1, "past the mill"), (3, "mill wheel turns at dawn"), (5, "slowly and turns"), (6, "quiet now"), (8, "evening")]


def in_sequence(texts):
    """(position, text) of kept captions when all go through the step one after the other."""
    state, kept = None, []
    for i, t in enumerate(texts):
        (_, text), state = ops.rolling_step(state, i, t)
        if text is not None:
            kept.append((i, text))
    return kept


def random_captions(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    out, last = [], ""
    for _ in range(n):
        fresh = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
        roll = rng.random()
        text = fresh if roll < 0.3 else (last[-rng.randrange(1, 20):].strip() + " " + fresh).strip() if roll < 0.8 else last[: rng.randrange(1, 30)] or fresh
        out.append(text.strip() or fresh)
        last = out[-1]
    return out


def test_rolling_captions_by_hand(spark):
    got = ops.collapse_rolling(segments(spark, [(2 * i, 2 * i + 1, t) for i, t in enumerate(CAPTIONS)])).orderBy("seg_idx").collect()
    assert [(r.seg_idx, r.text) for r in got] == KEPT


@pytest.mark.parametrize("block", [5, 100000])
@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_captions(spark, monkeypatch, block, seed):
    monkeypatch.setattr(keyed, "BLOCK_ROWS", block)
    texts = random_captions(43, seed)
    cues = [(2 * i, 2 * i + 3 - (i % 3), t) for i, t in enumerate(texts)]
    kept = in_sequence(texts)
    got = ops.collapse_rolling(segments(spark, cues)).orderBy("seg_idx").collect()
    assert [(r.seg_idx, r.text) for r in got] == kept
    bounds = [i for i, _ in kept] + [len(texts)]
    assert [r.end_s for r in got] == [float(max(c[1] for c in cues[a:b])) for a, b in zip(bounds, bounds[1:])]
    again = ops.collapse_rolling(ops.renumber(ops.collapse_rolling(segments(spark, cues))))
    assert sorted(r.text for r in again.collect()) == sorted(t for _, t in in_sequence([t for _, t in kept]))


def test_repeats_collapse(spark):
    cues = [(0, 1, "a"), (1, 2, "a"), (2, 3, "a b"), (3, 4, "ab"), (4, 5, "a")]
    got = ops.collapse_repeats(segments(spark, cues)).orderBy("seg_idx").collect()
    assert [(r.start_s, r.end_s, r.text) for r in got] == [(0.0, 3.0, "a b"), (3.0, 4.0, "ab"), (4.0, 5.0, "a")]


def test_pause_chapters_and_blocks(spark):
    quick = [(i * 5, i * 5 + 5, "x") for i in range(60)]
    both = segments(spark).unionByName(segments(spark, quick, 2))
    got = {}
    for r in ops.pause_chapters(both).orderBy("chapter_id").collect():
        got.setdefault(r.source_id, []).append((r.start_s, r.end_s))
    assert got[2] == [(0.0, 120.0), (120.0, 240.0), (240.0, 300.0)]
    assert [a for a, _ in got[1]] == [0.0] + [float(c[0]) for p, c in zip(CUES, CUES[1:]) if c[0] - p[1] > 2.0]
    plain = {(r.source_id, r.seg_idx): r.chapter_id for r in ops.attach_chapters(both, ops.pause_chapters(both)).collect()}
    for flag in (True, False):
        assert {(r.source_id, r.seg_idx): r.chapter_id for r in ops.pause_marks(both, flag).collect()} == plain


def test_metadata_chapters_win(spark):
    listed = spark.createDataFrame([(1, 300.0, [("0", "60", "Intro"), ("bad", "9", "no"), ("60", "300", None)])],
                                   "source_id long, duration double, chapters array<struct<start_time:string,end_time:string,title:string>>")
    got = ops.chapters_from_metadata(listed, segments(spark)).orderBy("chapter_id").collect()
    assert [(r.chapter_id, r.title, r.start_s) for r in got] == [(0, "Intro", 0.0), (1, "Chapter 2", 60.0)]


def test_as_of_before_first_chapter(spark):
    chapters = spark.createDataFrame([(1, 0, 50.0), (1, 1, 100.0)], "source_id long, chapter_id int, start_s double")
    got = ops.attach_chapters(segments(spark), chapters).orderBy("seg_idx").collect()
    assert [r.chapter_id for r in got] == [1 if c[0] >= 100 else 0 for c in CUES]


@pytest.mark.parametrize("block", [4, 100000])
def test_spans(spark, monkeypatch, block):
    monkeypatch.setattr(ops, "BLOCK_ROWS", block)
    rng = random.Random(5)
    t, cues = 0.0, []
    for i in range(50):
        t += rng.choice([3.0, 7.5, 15.0])
        cues.append((t, t + 2, f"w{i}"))
    base = segments(spark, cues).selectExpr("*", "cast(seg_idx / 20 as int) as chapter_id")
    want, start, chapter = [], None, None
    for i, (a, _, w) in enumerate(cues):
        if chapter != i // 20 or a - start >= 30:
            want.append([i, i, w])
            start, chapter = a, i // 20
        else:
            want[-1][1], want[-1][2] = i, want[-1][2] + " " + w
    for one in (True, False):
        got = ops.build_spans(base, one).orderBy("span_id").collect()
        assert [[r.first_seg, r.last_seg, r.text] for r in got] == want


@pytest.mark.parametrize("block,one", [(4, False), (100000, False), (100000, True)])
def test_spans_of_starts_in_any_order(spark, monkeypatch, block, one):
    """Long chapters without a pause, starts that stand still, go back or meet 30 s exactly, chapters that come again."""
    monkeypatch.setattr(ops, "BLOCK_ROWS", block)
    rng = random.Random(11)
    rows, want = [], []
    for source in (1, 2, 3):
        t, chapter, opened = 470.3, 0, None
        for i in range(120 if source == 1 else 40):
            t = round(t + rng.choice([0.0, 5.0, 10.0, 10.0, 0.1, -4.0] + [31.0, 95.0] * (source == 3)), 1)
            chapter = rng.choice([0, 1]) if source == 2 and i % 9 == 0 else chapter
            rows.append((source, i, t, t + 1, f"w{i}", chapter))
            if opened is None or chapter != opened[0] or t - opened[1] >= 30.0:
                opened = (chapter, t)
                want.append((source, i))
    schema = "source_id long, seg_idx int, start_s double, end_s double, text string, chapter_id int"
    table = spark.createDataFrame(rows, schema)
    got = ops.build_spans(table, one)
    assert sorted((r.source_id, r.first_seg) for r in got.collect()) == want
    assert got.selectExpr("sum(last_seg - first_seg + 1) n").first().n == len(rows)
    assert ops.build_spans(table.limit(0), one).count() == 0


def test_ranges_are_inclusive(spark):
    got = ops.filter_range(segments(spark), 13, 61).orderBy("seg_idx").collect()
    assert [r.start_s for r in got] == [9.0, 17.0, 61.0]
    assert ops.filter_range(segments(spark), None, None).count() == len(CUES)
