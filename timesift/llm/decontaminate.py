"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training windows and verified."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timesift.llm.common import cut_lineage

WINDOW = 13
ENTRIES_PER_PASS = 2_000_000
"""Windows times items that one broadcast set may hold; a larger benchmark is scanned in several passes."""

# Bytes that are no word characters become blanks; capital letters become small ones. Bytes over 0x7F belong to
# characters over U+007F, all of which are word characters.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE, _MASK = 1_000_003, (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def item_windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of ``width`` words; a shorter item is one window, an empty one has none."""
    if len(words) < width:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]


class WindowSet:
    """The broadcast side: word numbers, and for each window length its hashes and exact windows with their items."""

    def __init__(self, items: list[tuple[int | None, str]], width: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, text in items:
            for window in item_windows(words_of(text), width):
                key = tuple(self.ids.setdefault(w, len(self.ids)) for w in window)
                windows.setdefault(key, set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, dict]] = {}
        for n in sorted({len(k) for k in windows}):
            own = {k: v for k, v in windows.items() if len(k) == n}
            self.by_length[n] = np.unique(self._hash(np.array(list(own), dtype=np.uint64))), own

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.uint64)
        for j in range(rows.shape[1]):
            out = out * np.uint64(_BASE) + rows[:, j] + np.uint64(1)
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        get = self.ids.get
        numbers = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        hit, items = np.zeros(len(words), dtype=bool), set()
        known = np.concatenate(([0], np.cumsum(numbers >= 0)))
        for n, (hashes, exact) in self.by_length.items():
            if len(words) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)  # windows of known words only
            if not len(starts):
                continue
            got = numbers[starts[:, None] + np.arange(n)[None]].astype(np.uint64) if len(starts) < 4096 else None
            if got is None:
                value = np.zeros(len(starts), dtype=np.uint64)
                for j in range(n):
                    value = value * np.uint64(_BASE) + numbers[starts + j].astype(np.uint64) + np.uint64(1)
            else:
                value = self._hash(got)
            at = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            for s in starts[hashes[at] == value]:
                found = exact.get(tuple(numbers[s:s + n].tolist()))  # verified word by word
                if found is not None:
                    hit[s:s + n] = True
                    items |= found
        return hit, items


def _broadcast(spark: SparkSession, block: list[tuple[int | None, str]], width: int):
    """By value, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(WindowSet(block, width)))


def _runs(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _scanner(shared):
    def scan(batches):
        windows = pickle.loads(shared.value)
        run = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            n_words, runs, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                hit, found = windows.hits(words)
                n_words.append(len(words))
                runs.append(_runs(hit))
                items.append(sorted(i for i in found if i is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, run),
                 pa.array(items, pa.list_(pa.int64()))], names=["rid", "doc_id", "n_words", "runs", "items"])
    return scan


FOUND = "rid long, doc_id long, n_words long, runs array<struct<start: int, end: int>>, items array<long>"


def _passes(benchmark: DataFrame, per_pass: int) -> tuple[int, Callable[[int], list[tuple[int | None, str]]]]:
    """The number of blocks of items, each small enough to broadcast, and how to fetch one; sizes are known before any text is fetched."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), "text").filter("text IS NOT NULL")
    sized = items.withColumn("n", F.greatest(F.lit(1), F.floor(F.octet_length("text") / 2)))
    passes = max(1, math.ceil((sized.agg(F.sum("n")).first()[0] or 0) / per_pass))
    if passes == 1:
        return 1, lambda _: [(r[0], r[1]) for r in items.collect()]
    part = F.pmod(F.xxhash64("item", "text"), F.lit(passes * 2))
    return passes * 2, lambda p: [(r[0], r[1]) for r in items.filter(part == p).collect()]


def find_overlap(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, per_pass: int = ENTRIES_PER_PASS, rid: str | None = None) -> DataFrame:
    """Runs of hit words of each row of ``docs(doc_id, text)`` and the items they come from.

    One pass over the texts for a benchmark that fits the bound; of a larger one, one block at a time is fetched,
    broadcast, scanned and written, and the passes are merged by row. Null texts have no words; null items ids
    still hit words but are listed nowhere; repeated rows each return a row; an empty benchmark hits nothing. Very long texts
    are scanned whole; extra columns are not read. ``rid`` names a column that numbers the rows, where there is one.
    Returns ``rid, doc_id, n_words, runs, items`` (runs of word positions, end exclusive).
    """
    spark = docs.sparkSession
    number = F.col(rid) if rid else F.monotonically_increasing_id()
    rows = docs.select(number.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    passes, fetch = _passes(benchmark, per_pass)
    if passes == 1:
        return rows.mapInArrow(_scanner(_broadcast(spark, fetch(0), width)), FOUND)
    if not rid:
        rows = cut_lineage(rows)  # row numbers must be the same in every pass
    merged = None
    for p in range(passes):
        shared = _broadcast(spark, fetch(p), width)
        scan = cut_lineage(rows.mapInArrow(_scanner(shared), FOUND).filter((F.size("runs") > 0) | F.lit(merged is None)))
        shared.unpersist()
        if merged is None:
            merged = scan
            continue
        more = scan.select("rid", F.col("runs").alias("r"), F.col("items").alias("i"))
        none_r, none_i = F.array().cast("array<struct<start: int, end: int>>"), F.array().cast("array<bigint>")
        merged = cut_lineage(merged.join(more, "rid", "left").select(
            "rid", "doc_id", "n_words", F.concat("runs", F.coalesce("r", none_r)).alias("runs"),
            F.array_union("items", F.coalesce("i", none_i)).alias("items")))
    flat = F.array_sort("runs")
    joined = F.aggregate(flat, F.array().cast("array<struct<start: int, end: int>>"), lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"),
            F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x))))
    return merged.withColumn("runs", joined)


def overlap_digest(found: DataFrame, share: int = 20) -> DataFrame:
    """Counts and the contamination rule: hit words are at least one in ``share`` of the words."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]).cast("long"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"))


def _cleaner(shared, share: int, spans: bool):
    def clean(batches):
        windows = pickle.loads(shared.value)
        for batch in batches:
            texts, keep = [], []
            for text in batch.column("__text").to_pylist():
                words = words_of(text)
                hit, _ = windows.hits(words)
                dirty = bool(hit.any()) and share * int(hit.sum()) >= len(words)
                texts.append(_without(text, hit) if spans and dirty else text)
                keep.append(spans or not dirty)
            kept = pa.RecordBatch.from_arrays(
                [batch.column(c) if c != "__text" else pa.array(texts, pa.string()) for c in batch.schema.names],
                names=batch.schema.names)
            yield kept.filter(pa.array(keep))
    return clean


def _without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words; what stands between two hit words of a run goes with them."""
    raw = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(raw.translate(_KEEP), dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    starts, ends, out, at = edges[::2], edges[1::2], [], 0
    for run in _runs(hit):
        out.append(raw[at:starts[run["start"]]])
        at = ends[run["end"] - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _cutter(batches):
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column("__text").to_pylist(), batch.column("__runs").to_pylist(), strict=True):
            if runs:
                hit = np.zeros(runs[-1]["end"], dtype=bool)
                for run in runs:
                    hit[run["start"]:run["end"]] = True
                text = _without(text, hit)
            texts.append(text)
        names = [n for n in batch.schema.names if n != "__runs"]
        yield pa.RecordBatch.from_arrays([batch.column(n) if n != "__text" else pa.array(texts, pa.string()) for n in names], names=names)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20,
                        spans: bool = False, per_pass: int = ENTRIES_PER_PASS) -> DataFrame:
    """``docs`` without the contaminated documents, or with ``spans`` without their hit spans; other columns stay, whatever they are called.

    Rows are judged where they lie, so no text is shuffled. With a benchmark of several passes the
    verdict needs all of them: rows are numbered, and the merged runs of the dirty ones are joined back to filter or to cut them. Null and empty
    texts have no words and stay.
    """
    spark = docs.sparkSession
    names = [f"__c{i}" for i in range(len(docs.columns))]
    names[docs.columns.index("text")] = "__text"
    plain = docs.toDF(*names)
    passes, fetch = _passes(benchmark, per_pass)
    if passes == 1:
        kept = plain.mapInArrow(_cleaner(_broadcast(spark, fetch(0), width), share, spans), plain.schema)
        return kept.toDF(*docs.columns)
    keyed = cut_lineage(plain.withColumn("__rid", F.monotonically_increasing_id()))
    read = keyed.select("__rid", F.lit(None).cast("long").alias("doc_id"), F.col("__text").alias("text"))
    found = find_overlap(read, benchmark, width, per_pass, "__rid")
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + (r["end"] - r["start"]).cast("long"))
    dirty = cut_lineage(found.filter((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).select(
        F.col("rid").alias("__rid"), F.col("runs").alias("__runs")))
    if not spans:
        return keyed.join(dirty, "__rid", "left_anti").drop("__rid").toDF(*docs.columns)
    return keyed.join(dirty, "__rid", "left").drop("__rid").mapInArrow(_cutter, plain.schema).toDF(*docs.columns)
