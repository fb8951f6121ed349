"""Vector codes against plain Lloyd rounds over all pairs of parts and entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from timesift.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, v string, __label int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def plain(rows, rounds=6):
    """vec_id, code, error, label_error and the digest by the contract, one number at a time."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))
    w = len(ints[0]) // 8
    cut = [[tuple(v[j * w:(j + 1) * w]) for j in range(8)] for v in ints]
    books = [[cut[i][j] for i in order[:16]] for j in range(8)]

    def nearest(j, p):
        return min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), n) for n, e in enumerate(books[j]))
    for _ in range(rounds):
        for j in range(8):
            own = [[] for _ in books[j]]
            for c in cut:
                own[nearest(j, c[j])[1]].append(c[j])
            books[j] = [tuple(sum(x) // len(x) for x in zip(*o, strict=True)) if o else e for o, e in zip(own, books[j], strict=True)]
    best = [[nearest(j, c[j]) for j in range(8)] for c in cut]
    errors = [sum(b[0] for b in bs) for bs in best]
    by_label = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{b[1]:02x}" for b in bs), e, by_label[r[2]]) for r, bs, e in zip(kept, best, errors, strict=True)], digest


def clustered(rng, n, width=16, spread=0.05):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    return [(i + 1, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.choice([0, 1, 2, None])) for i in range(n)]


@pytest.mark.parametrize("kind", ["clustered", "spread", "grid"])
def test_codes_equal_plain_rounds(spark, kind):
    rng = random.Random(7)
    if kind == "grid":  # many equal distances and equal entries
        rows = [(i, [rng.randrange(3) / 2048 for _ in range(8)], i % 2) for i in range(300)]
    else:
        rows = clustered(rng, 400, spread=0.05 if kind == "clustered" else 1.0)
    odd = [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("inf")] + [0.0] * 15, None), (3, rows[2][1], 1),
           (None, rows[5][1], None), (904, [0.0] * len(rows[0][1]), 2)]
    rows = rows + odd
    want, digest = plain(rows)
    coded, books = codes.compress(table(spark, rows), block_rows=64, leaf_rows=4)
    got = codes.label_errors(coded).select("vec_id", "code", "error", "label_error").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert codes.codebooks_digest(books) == digest


def test_bounds_settle_whole_nodes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-8000, 8000, (16, 4))
    points = (centres[rng.integers(0, 16, 2000)] + rng.integers(-40, 40, (2000, 4))).astype(np.int64)
    tree = codes.part_tree(points)
    met = []
    plain_leaves, codes._uncertain = codes._uncertain, lambda *a: met.append(a[3]) or plain_leaves(*a)
    try:
        sums, numbers, _ = codes.assign_block(tree, points, centres, True)
    finally:
        codes._uncertain = plain_leaves
    nearest = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (numbers == np.bincount(nearest, minlength=16)).all()
    assert (sums == np.stack([points[nearest == e].sum(axis=0) for e in range(16)])).all()
    assert sum(len(m) for m in met) < (len(tree.count) + 1) // 4  # most leaves are never opened


def test_few_rows_and_none(spark):
    rows = [(5, [0.25] * 8, None), (2, [0.5] * 8, 1), (9, [0.3] * 8, 1)]
    coded, books = codes.compress(table(spark, rows))
    want, digest = plain(rows)
    assert sorted(tuple(r) for r in codes.label_errors(coded).select("vec_id", "code", "error", "label_error").collect()) == sorted(want)
    assert codes.codebooks_digest(books) == digest
    for none in (table(spark, rows).limit(0), table(spark, [(1, None, 1), (2, [], 1)])):
        coded, books = codes.compress(none)
        assert codes.label_errors(coded).count() == 0 and books.size == 0


def test_odd_lengths_and_huge_components(spark):
    rows = [(i, [0.1 * i] * 10, 0) for i in range(20)] + [(50, [0.1] * 9, 0), (51, [3e30] * 10, 0)]
    coded, books = codes.compress(table(spark, rows))
    assert {r.vec_id for r in coded.collect()} == set(range(20)) and books.shape == (8, 16, 2)
