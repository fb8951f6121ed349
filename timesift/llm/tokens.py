"""Token counts of whole texts, encoded in byte-balanced batches inside Arrow functions that return lengths only.

A text is cut at safe boundaries: a space after any other character that is no white space, before a word character. No tokenizer of the
kinds read here joins anything across it, so the pieces' counts add up to the count of the whole text.
Pieces met before are looked up; the others are encoded in batches of about equal bytes, so neither a very long text
nor a batch of many decides how much a task holds. Text without such a boundary is one piece.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 262_144
"""Bytes of pieces that are encoded in one call."""
KNOWN_PIECES, KNOWN_LENGTH = 400_000, 64
"""Pieces whose counts a task remembers, twice, and the longest that is remembered: when the newer half is full, the older is forgotten."""
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \w)")
_AT_SPACE = re.compile(r"(?<=\S) (?=\w)")

Encode = Callable[[list[str]], Iterable[int]]


def load_encoder(kind: str, model: bytes) -> tuple[Encode, re.Pattern]:
    """The batch encoder of a tokenizer file, as lengths, and the boundary that is safe for it.

    ``json`` files are read by the library ``tokenizers``; a piece keeps the space before it. ``model`` files
    are read by ``sentencepiece``, which puts a space before every text; there the space itself is left out.
    Special strings inside a text count as the libraries take them by default.
    """
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_str(model.decode("utf-8"))
        loaded.no_truncation()
        loaded.no_padding()
        return lambda pieces: map(len, loaded.encode_batch_fast(pieces, add_special_tokens=False)), _BEFORE_SPACE
    if kind == "model":
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_proto=model)
        return lambda pieces: map(len, processor.encode(pieces, num_threads=1)), _AT_SPACE
    raise ValueError(f"no tokenizer library for files that end in .{kind}")


class PieceCounter:
    """Counts of pieces: looked up where met before, else encoded in batches of about ``batch_bytes``."""

    def __init__(self, encode: Encode, boundary: re.Pattern, batch_bytes: int = BATCH_BYTES, known_pieces: int = KNOWN_PIECES):
        self.encode, self.boundary = encode, boundary
        self.batch_bytes, self.known_pieces = batch_bytes, known_pieces
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        totals = [0] * len(texts)
        waiting: dict[str, list[int]] = {}
        size = 0
        known = self.known
        for at, text in enumerate(texts):
            total = 0
            for piece in self.boundary.split(text):
                n = known.get(piece)
                if n is None:
                    n = self.older.get(piece)
                    if n is not None:
                        known[piece] = n
                if n is not None:
                    total += n
                elif piece in waiting:
                    waiting[piece].append(at)
                elif piece:
                    waiting[piece] = [at]
                    size += len(piece) * 4
                    if size >= self.batch_bytes:
                        self._settle(waiting, totals)
                        known, size = self.known, 0
            totals[at] += total
        self._settle(waiting, totals)
        return totals

    def _settle(self, waiting: dict[str, list[int]], totals: list[int]) -> None:
        if len(self.known) >= self.known_pieces:
            self.known, self.older = {}, self.known
        pieces = list(waiting)
        for piece, n in zip(pieces, self.encode(pieces), strict=True):
            for at in waiting[piece]:
                totals[at] += n
            if len(piece) <= KNOWN_LENGTH:
                self.known[piece] = n
        waiting.clear()


def read_model(path: str) -> tuple[str, bytes]:
    """Kind and content of a tokenizer file on the driver: a few MB, sent to the tasks with the function that uses it."""
    with open(path, "rb") as f:
        return path.rsplit(".", 1)[-1], f.read()


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``id_column, n_bytes, n_tokens`` of each row: UTF-8 bytes of its text and tokens of the tokenizer file at ``path``.

    No begin, end or added special tokens, no truncation, no padding. A null text is empty and has no bytes
    and no tokens; repeated rows each return a row, null ids too; an empty table returns none. Very long texts are counted whole, piece by
    piece. Only the two named columns are read, whatever other columns are called. One pass over the table without a shuffle;
    a task that is lost is simply run again.
    """
    kind, model = read_model(path)
    id_type = docs.schema[id_column].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(*load_encoder(kind, model), batch_bytes)
        for batch in batches:
            counts = counter.counts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             names=["__id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("__text"),
                       F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"__id {id_type.simpleString()}, n_bytes long, n_tokens long").withColumnRenamed("__id", id_column)


def flag_over_limit(counts: DataFrame, limit: int) -> DataFrame:
    """Adds ``over_limit``: more tokens than ``limit``."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
