"""The classifier: its parts, held-out accuracy and edge cases."""

import os

import numpy as np
import pytest

from helpers import docs
from timesift.llm import quality
from timesift.llm.common import table

SF = "/root/testdata/sf0.01"


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    y, w = np.linspace(0, 1, 50) + rng.normal(0, 0.3, 50), rng.integers(1, 9, 50).astype(float)
    level = quality.isotonic(np.arange(50), y, w)
    assert (np.diff(level) >= 0).all() and abs((level * w).sum() - (y * w).sum()) < 1e-9


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    model = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), np.zeros(1), 5, None, None)
    x = rng.normal(size=(40, quality.N_STATS))
    z = quality.lift(x, model.mean, model.scale, *model.maps())[:, :-1]
    near = z @ z.T * 2 / quality.FEATURES
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.BANDWIDTH ** 2))
    assert np.abs(near - true).max() < 0.35 and np.abs(near - true).mean() < 0.06


def test_partition_sums_are_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, quality.N_STATS)), rng.integers(0, 2, 60).astype(float)
    measured = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, stats array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(measured, labels)
    import zlib
    own = [i for i in range(60) if zlib.crc32(str(i).encode()) % 10 % 5 != 1]
    z = quality.lift(x[own], model.mean, model.scale, *model.maps())
    want = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ y[own])
    assert np.allclose(model.weights, want, atol=1e-5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_accuracy_and_folds(spark):
    import zlib
    got = quality.score_quality(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 30 and sum(p == y for p, y in held) >= 0.93 * len(held)


def test_edges(spark):
    good = [(i, f"The cat number {i} sat on the mat. It was glad of it.") for i in range(40)]
    bad = [(100 + i, "### $$$ %%% " * 9) for i in range(40)]
    rows = good + bad + [(900, None), (901, ""), (902, "x" * 500_000), (None, "plain text."), (3, good[3][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(1, None, 0), (None, 1, 0), (2, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    table_ = docs(spark, rows, extra=True)
    got = quality.score_quality(table_, labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == (r.doc_id < 100) for r in got if r.doc_id is not None and r.doc_id < 200)
    kept = quality.keep_good(table_, labels)
    assert kept.columns == table_.columns and {r.doc_id for r in kept.collect()} >= {i for i, _ in good}
    none = quality.score_quality(table_, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(rows)
    assert quality.score_quality(table_.limit(0), labels).count() == 0


def test_keep_good_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(
        [(i, "A calm river runs past the old mill." if i % 2 else "#### %%%% $$$$", "en", None, 1) for i in range(40)]
        + [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "text", "en", "s", 4), (1, "A calm river runs past the old mill.", "en", "s", 1)], schema)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None and i < 40} == set(range(1, 40, 2)) and ids.count(1) == 2
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_keep_good_fits_as_scoring_does(spark):
    rows = [(i, ("word " * (3 + i % 9)) + ("#" * (i % 5) * 6)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 < 2), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = sorted(r.doc_id for r in quality.keep_good(docs, labels).collect())
    assert kept == sorted(r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect())
