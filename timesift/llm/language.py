"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timesift.llm.common import crc_fold

FIT_ROWS = 6_000
"""Labelled rows that the training reads at most, picked by a hash of doc_id; their whole texts are read."""
BUCKETS, DIM, EPOCHS, BATCH, RATE, ERROR = 4096, 16, 12, 32, 2.0, 0.01

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD[:48] = _FOLD[58:65] = _FOLD[91:97] = _FOLD[123:128] = 32  # all but digits, letters and non-ASCII bytes bound a word


def subwords(text: str | None) -> np.ndarray:
    """Relative frequency of the hashed 2-, 3- and 4-byte pieces within words, word bounds included."""
    raw = np.frombuffer((" " + (text or "") + " ").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    b = _FOLD[raw]
    out = np.zeros(BUCKETS)
    for n in (2, 3, 4):
        if len(b) < n:
            break
        h = np.full(len(b) - n + 1, n, dtype=np.uint64)
        inner = np.zeros(len(h), dtype=bool)
        for j in range(n):
            piece = b[j:len(b) - n + 1 + j]
            h = h * np.uint64(0x100000001B3) + piece
            if 0 < j < n - 1 or n == 2:
                inner |= piece == 32
        h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
        out += np.bincount((h[~inner] >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    total = out.sum()
    return out / total if total else out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    head: np.ndarray
    bias: np.ndarray
    heat: float
    accept: float

    def probabilities(self, bags: np.ndarray) -> np.ndarray:
        z = ((bags @ self.table) @ self.head + self.bias) / self.heat
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(bags: np.ndarray, wanted: np.ndarray, languages: list[str], seed: int = 3) -> Model:
    """Stochastic gradient descent on nine tenths of the rows; heat and rejection on the rest."""
    rng = np.random.default_rng(seed)
    model = Model(languages, rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(languages))), np.zeros(len(languages)), 1.0, 0.0)
    order = rng.permutation(len(bags))
    held = order[:max(1, len(order) // 10)]
    own = order[len(held):] if len(order) > len(held) else order
    scale = 1.0 / max(1e-9, float(np.sqrt((bags.astype(np.float64) ** 2).sum(axis=1)).mean()))  # bags of about unit length
    hot = np.eye(len(languages))[wanted]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            x = bags[at] * scale
            hidden = x @ model.table
            z = hidden @ model.head + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            miss = (p - hot[at]) / len(at)
            back = x.T @ (miss @ model.head.T)
            model.head -= rate * hidden.T @ miss
            model.bias -= rate * miss.sum(axis=0)
            model.table -= rate * back
    model.table *= scale
    losses = []
    for heat in np.geomspace(0.25, 8, 31):
        model.heat = float(heat)
        p = model.probabilities(bags[held])[np.arange(len(held)), wanted[held]]
        losses.append((-np.log(np.maximum(p, 1e-12)).mean(), model.heat))
    model.heat = min(losses)[1]
    p = model.probabilities(bags[held])
    sure, right = p.max(axis=1), p.argmax(axis=1) == wanted[held]
    down = np.argsort(-sure, kind="stable")
    error = np.cumsum(~right[down]) / np.arange(1, len(down) + 1)
    fine = np.flatnonzero(error <= ERROR)
    model.accept = float(sure[down][fine[-1]]) if len(fine) else 1.0
    return model


def _bags(languages: list[str]):
    def run(batches):
        for batch in batches:
            bags = [subwords(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            label = [languages.index(x) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bags, pa.binary()), pa.array(label, pa.int32())],
                                             names=["doc_id", "bag", "label"])
    return run


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model from ``docs(doc_id, text, lang)``; callers pass only rows that may be learnt from. None without rows."""
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    each = max(1, fit_rows // len(languages))
    # A share of each language by a hash in [0, 2^63); texts become bags where they lie, and at most ``fit_rows`` bags are fetched.
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(2 ** 63 - 1, int(each / n * 2 ** 63)))])
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(23)), 1)
    picked = usable.filter(place <= F.element_at(shares, F.col("lang")))
    rows = picked.mapInArrow(_bags(languages), "doc_id long, bag binary, label int").orderBy("doc_id", "label", "bag")
    got = [(r["bag"], r["label"]) for r in islice(rows.toLocalIterator(), fit_rows)]
    bags = np.frombuffer(b"".join(bytes(b) for b, _ in got), dtype=np.float32).reshape(-1, BUCKETS)
    return train(bags, np.array([y for _, y in got]), languages)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` of each row of ``docs(doc_id, text)``."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            some = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            names, scores, accepted = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            for part in range(0, len(some), 256):
                at = some[part:part + 256]
                p = model.probabilities(np.array([subwords(texts[i]) for i in at]))
                for i, row in zip(at, p, strict=True):
                    names[i] = model.languages[int(row.argmax())]
                scores[at], accepted[at] = p.max(axis=1), p.max(axis=1) >= model.accept
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(scores), pa.array(accepted)],
                                             names=["doc_id", "lang_pred", "score", "accepted"])
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of each row of ``docs(doc_id, text, lang)``.

    Learns from rows with a language whose crc32(doc_id as text) mod 4 is not 2, and predicts from the
    whole text alone. Null texts and texts without a letter (a character of a letter category) are ``und`` with score 0, as is all when
    nothing could be learnt. ``accepted`` is false where the calibrated confidence is too low for
    the accepted error. A null doc_id counts as empty text in its fold; repeated rows each return a row.
    Very long texts are read whole; extra columns are not read; an empty table returns none.
    """
    model = fit(docs.filter(crc_fold(F.col("doc_id"), 4) != 2))
    return predict(docs, model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
