"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timesift.llm.common import crc_fold, cut_lineage

FIT_ROWS = 100_000
"""Labelled rows that a fit reads at most, picked by a hash of doc_id."""
FEATURES, RIDGE, BANDWIDTH, BINS, CUT = 256, 1.0, 4.0, 400, 0.3

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 small letter, 2 capital, 3 digit, 4 blank, 5 line end, 6 stop, 7 symbol, 8 lead byte, 9 trail byte
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 6
_CLASS[[ord(c) for c in "#$%&*|!<>{}[]=+_~^@\\/`"]] = 7
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 8, 9
N_STATS = 20


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text; all 0 for null and empty texts."""
    out = np.zeros(N_STATS)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    c = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=10).astype(float)
    chars = len(raw) - c[9]
    letters = max(1.0, c[1] + c[2] + c[8])
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, distinct = max(1, len(words)), set(words)
    lengths = np.fromiter(map(len, words), dtype=float, count=len(words)) if words else np.zeros(1)
    line_words = len(words) / max(1, len(lines))
    stops = sum(1 for x in lines if x.rstrip()[-1:] in b".?!")
    out[:] = (
        np.log1p(len(words)), np.log1p(len(lines)), c[2] / letters, c[3] / chars, c[4] / chars, c[6] / chars, c[7] / chars,
        c[8] / chars, c[0] / chars, len(distinct) / n, len(distinct) / n ** 0.7, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(line_words), lengths.mean() / 10, lengths.std() / 10,
        lengths.max() ** 0.25, stops / max(1, len(lines)), raw.count(b" | ") / n, (n - len(set(map(bytes.lower, words)))) / n)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    seed: int
    knots: np.ndarray
    levels: np.ndarray

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(0, 1 / BANDWIDTH, (N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def raw(self, stats: np.ndarray, maps) -> np.ndarray:
        return lift(stats, self.mean, self.scale, *maps) @ self.weights

    def score(self, stats: np.ndarray, maps) -> np.ndarray:
        return np.interp(self.raw(stats, maps), self.knots, self.levels) if len(stats) else np.zeros(0)


def lift(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features with a constant, whose products approximate a Gaussian kernel."""
    z = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.cos(z @ w + phase), np.ones((len(z), 1))])


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of each row of ``docs(doc_id, text)``."""
    def measure(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            flat = np.concatenate([statistics(t) for t in texts]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATS), pa.int32()),
                                                                  pa.array(flat))], names=["doc_id", "stats"])
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(measure, "doc_id long, stats array<double>")


def _matrix(batch, name: str = "stats") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _normal_equations(mean, scale, maps):
    """Each partition's sum of x x' and x y, one row a cell, in fixed point so that their order of addition is nothing to it."""
    def sums(batches):
        gram = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = lift(_matrix(batch), mean, scale, *maps)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            gram += x.T @ np.hstack([x, y[:, None]])
        cells = np.rint(gram * 2.0 ** 30).astype(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)], names=["cell", "value"])
    return sums


def _binned(model: Model):
    maps = model.maps()

    def binned(batches):
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch), maps) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])
    return binned


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest rising levels to ``y`` with weights ``w``."""
    blocks: list[list[float]] = []
    for level, weight in zip(y, w, strict=True):
        blocks.append([level, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), level) for level, _, n in blocks]) if blocks else np.zeros(0)


def pick_labels(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, y)`` of about ``fit_rows`` labelled documents at most, written; drawn by a hash of the id.

    Several labels of a document are averaged and null ones skipped.
    """
    by_doc = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.avg("quality").cast("double").alias("y"))
    n = by_doc.count()
    share = int(min(1.0, fit_rows / max(1, n)) * 1_000_000)
    return cut_lineage(by_doc.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share), min(n, fit_rows))


def fit(measured: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5) -> Model:
    """A model from ``measured(doc_id, stats)`` and ``labels(doc_id, quality)``, of which callers pass only those
    that may be learnt from."""
    return fit_picked(measured, pick_labels(labels, fit_rows), seed)


def fit_picked(measured: DataFrame, picked: DataFrame, seed: int = 5) -> Model:
    """A model from ``measured(doc_id, stats)`` and ``picked(doc_id, y)`` of ``pick_labels``.

    Rows with crc32(doc_id) mod 10 in 1, 6 fit the calibration, all others the
    ridge scores. With no labelled rows every score is 0.5.
    """
    rows = cut_lineage(measured.join(picked, "doc_id").withColumn("fold", crc_fold(F.col("doc_id"), 10) % F.lit(5)))
    flat = [F.element_at("stats", i + 1) for i in range(N_STATS)]
    moments = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in flat], *[F.stddev_pop(c) for c in flat]).first()
    if not moments[0]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(FEATURES + 1), seed, np.array([0.0]), np.array([0.5]))
    mean, scale = np.array(moments[1:N_STATS + 1]), np.array(moments[N_STATS + 1:])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), seed, np.array([0.0]), np.array([0.5]))
    train = rows.filter("fold != 1") if not rows.filter("fold != 1").isEmpty() else rows
    cells = train.select("stats", "y").mapInArrow(_normal_equations(model.mean, model.scale, model.maps()), "cell int, value long")
    summed = cells.groupBy("cell").agg(F.sum("value").alias("value"))
    gram = np.zeros((FEATURES + 1) * (FEATURES + 2))
    for r in summed.toLocalIterator():  # (FEATURES + 1) * (FEATURES + 2) numbers, whatever the input
        gram[r["cell"]] = r["value"] / 2.0 ** 30
    gram = gram.reshape(FEATURES + 1, FEATURES + 2)
    model.weights = np.linalg.solve(gram[:, :-1] + RIDGE * np.eye(FEATURES + 1), gram[:, -1])
    held = rows.filter("fold = 1") if not rows.filter("fold = 1").isEmpty() else rows
    bins = held.select("stats", "y").mapInArrow(_binned(model), "bin int, y double").groupBy("bin").agg(
        F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    found = sorted((r["bin"], r["s"], r["n"]) for r in bins.collect())  # BINS rows at most
    at, s, n = (np.array(v, dtype=float) for v in zip(*found, strict=True))
    model.knots = (at + 0.5) / BINS * 2 - 0.5
    model.levels = np.clip(isotonic(model.knots, s / n, n), 0.0, 1.0)
    return model


def scored(measured: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``doc_id, score, predicted`` of each row of ``measured(doc_id, stats)``."""
    maps = model.maps()

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch), maps)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                names=["doc_id", "score", "predicted"])
    return measured.mapInArrow(run, "doc_id long, score double, predicted int")


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: crc32(doc_id as text) mod 5 is not 0."""
    return labels.filter(crc_fold(F.col("doc_id"), 5) != 0)


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs(doc_id, text)``.

    The score sees the text alone. Null and empty texts have the statistics 0 and are scored like any
    other; a null doc_id counts as empty text in its fold; repeated rows each return a row.
    """
    measured = cut_lineage(with_statistics(docs))
    model = fit(measured, learnable(labels))
    return scored(measured, model, cut).select(
        "doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows scored under ``cut``; texts are judged where they lie and columns stay.

    Only the labelled documents picked for the fit are measured before all are judged. Null and empty texts are
    judged like any other, repeated rows each; without labels every score is 0.5 and every row stays.
    """
    picked = pick_labels(learnable(labels))
    chosen = docs.select("doc_id", "text").join(picked.select("doc_id"), "doc_id", "left_semi")
    model = fit_picked(with_statistics(chosen), picked)
    maps, at = model.maps(), docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]

    def keep(batches):
        for batch in batches:
            texts = batch.column(names[at]).to_pylist()
            stats = np.array([statistics(t) for t in texts]).reshape(-1, N_STATS)
            yield batch.filter(pa.array(model.score(stats, maps) >= cut))
    plain = docs.toDF(*names)
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
