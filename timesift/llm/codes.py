"""Vector code compression: codebooks for the parts of vectors, by dual-tree Lloyd rounds in integers.

Vectors lie in blocks of a bounded number of rows. A block holds, for each part position, a balanced tree
over its parts with the bounding box, the number and the sum of the parts below every node. A codebook has a tree over its entries.
Both trees are walked together, level by level: where the least distance between two nodes exceeds the greatest of another pair, the
combination is pruned; an entry that loses to another everywhere in a box is pruned too. A node left with one entry gives its cached sum
and is not opened; leaves that stay uncertain compare their parts with the entries left, in integers. All bounds are exact
integers and pruning is strict, so ties reach the comparison and go to the lower index.

A round returns one sum for each codebook component from each task; the driver holds codebooks only.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from timesift.llm.common import cut_lineage

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
BLOCK_ROWS, LEAF_ROWS = 4_096, 32


class PartTree(NamedTuple):
    """A balanced tree over rows of ``points``; node k has the children 2k + 1 and 2k + 2, all leaves lie on the last level."""

    order: np.ndarray  # rows, each node's next to each other
    start: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray


def part_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> PartTree:
    """The tree of one part position of a block: nodes are halved along their widest side."""
    n, width = points.shape
    depth = 0
    while n >> depth > leaf_rows:
        depth += 1
    nodes = 2 ** (depth + 1) - 1
    order = np.arange(n, dtype=np.int32)
    start, count = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    low, high, total = (np.zeros((nodes, width), dtype=np.int64) for _ in range(3))
    count[0] = n
    for node in range(nodes):
        rows = order[start[node]:start[node] + count[node]]
        inside = points[rows]
        low[node], high[node], total[node] = inside.min(axis=0), inside.max(axis=0), inside.sum(axis=0)
        if 2 * node + 2 < nodes:
            half = len(rows) // 2
            side = int((high[node] - low[node]).argmax())
            order[start[node]:start[node] + count[node]] = rows[np.argpartition(inside[:, side], half)]
            start[2 * node + 1], count[2 * node + 1] = start[node], half
            start[2 * node + 2], count[2 * node + 2] = start[node] + half, len(rows) - half
    return PartTree(order, start, count, low, high, total)


def entry_levels(entries: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels ``(parent, low, high)`` of the tree over the entries of a codebook; the last level has entry i as node i."""
    groups, levels, parent = [np.arange(len(entries))], [], [0]
    while True:
        single = all(len(g) == 1 for g in groups)
        if single:
            back = np.argsort([g[0] for g in groups])
            groups, parent = [groups[i] for i in back], [parent[i] for i in back]
        levels.append((np.array(parent), np.array([entries[g].min(axis=0) for g in groups]),
                       np.array([entries[g].max(axis=0) for g in groups])))
        if single:
            return levels
        halves, parent = [], []
        for at, group in enumerate(groups):
            side = int((levels[-1][2][at] - levels[-1][1][at]).argmax())
            ordered = group[np.argsort(entries[group, side], kind="stable")]
            for part in (ordered[:len(group) // 2], ordered[len(group) // 2:]):
                if len(part):
                    halves.append(part)
                    parent.append(at)
        groups = halves


def _prune(alive: np.ndarray, low: np.ndarray, high: np.ndarray, entry_low: np.ndarray, entry_high: np.ndarray) -> np.ndarray:
    """Drops combinations of nodes whose least distance exceeds the greatest distance of another one of the same part node."""
    above, below = low[:, None] - entry_high[None], entry_low[None] - high[:, None]
    least = (np.maximum(np.maximum(above, below), 0) ** 2).sum(axis=2)
    most = (np.maximum(high[:, None] - entry_low[None], entry_high[None] - low[:, None]) ** 2).sum(axis=2)
    bound = np.where(alive, most, np.iinfo(np.int64).max).min(axis=1)
    return alive & (least <= bound[:, None])


def _dominated(alive: np.ndarray, low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Drops entries that are further than one chosen entry everywhere in the box."""
    middle = (low + high) // 2
    distance = ((middle[:, None] - entries[None]) ** 2).sum(axis=2)
    best = np.where(alive, distance, np.iinfo(np.int64).max).argmin(axis=1)
    apart = entries[best][:, None] - entries[None]
    square = (entries ** 2).sum(axis=1)
    # distance to the chosen entry less that to the other one is linear: its greatest value lies in a corner
    worst = square[best][:, None] - square[None] + 2 * np.maximum(-apart * low[:, None], -apart * high[:, None]).sum(axis=2)
    return alive & (worst >= 0)


def assign_block(tree: PartTree, points: np.ndarray, entries: np.ndarray,
                 totals: bool) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    """Nearest entries of a block's parts: sums and numbers of each entry with ``totals``, else the entry of each row."""
    k, width = entries.shape
    levels = entry_levels(entries)
    sums, numbers = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
    chosen = None if totals else np.zeros(len(points), dtype=np.int64)
    nodes, alive, level = np.array([0]), np.ones((1, 1), dtype=bool), 0
    while len(nodes):
        while True:
            low, high = tree.low[nodes], tree.high[nodes]
            alive = _prune(alive, low, high, levels[level][1], levels[level][2])
            at_leaf = 2 * int(nodes[0]) + 2 >= len(tree.count)
            if level + 1 == len(levels) or not at_leaf:
                break
            level += 1  # a part leaf meets single entries
            alive = alive[:, levels[level][0]]
        if level + 1 == len(levels):
            alive = _dominated(alive, low, high, entries)
            sure = alive.sum(axis=1) == 1
            entry = alive[sure].argmax(axis=1)
            if totals:
                np.add.at(sums, entry, tree.total[nodes[sure]])
                np.add.at(numbers, entry, tree.count[nodes[sure]])
            else:
                for node, e in zip(nodes[sure].tolist(), entry.tolist(), strict=True):
                    chosen[tree.order[tree.start[node]:tree.start[node] + tree.count[node]]] = e
            nodes, alive = nodes[~sure], alive[~sure]
        if at_leaf:
            if len(nodes):
                _uncertain(tree, points, entries, nodes, alive, sums, numbers, chosen)
            break
        nodes = np.concatenate((2 * nodes + 1, 2 * nodes + 2))
        alive = np.concatenate((alive, alive))
        if level + 1 < len(levels):
            level += 1
            alive = alive[:, levels[level][0]]
    return (sums, numbers, None) if totals else (None, None, chosen)


def _uncertain(tree: PartTree, points: np.ndarray, entries: np.ndarray, nodes: np.ndarray, alive: np.ndarray, sums: np.ndarray,
               numbers: np.ndarray, chosen: np.ndarray | None) -> None:
    """Compare the parts of leaves with the entries left to each, lower indexes first."""
    rows = np.concatenate([tree.order[tree.start[n]:tree.start[n] + tree.count[n]] for n in nodes])
    leaf = np.repeat(np.arange(len(nodes)), tree.count[nodes])
    best, entry = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), dtype=np.int64)
    for e in range(len(entries)):
        at = np.flatnonzero(alive[leaf, e])
        distance = ((points[rows[at]] - entries[e]) ** 2).sum(axis=1)
        nearer = distance < best[at]
        best[at[nearer]], entry[at[nearer]] = distance[nearer], e
    if chosen is None:
        np.add.at(sums, entry, points[rows])
        np.add.at(numbers, entry, 1)
    else:
        chosen[rows] = entry


def usable(vectors: DataFrame, id_column: str, vector_column: str, label_column: str | None) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part; ``v`` holds integers, padded with zeros to whole parts.

    Left out: null vectors, null or non-finite components; lengths other than the most frequent (ties: the smallest), empty ones
    among them; and components so large (beyond 2^26 for parts of up to 256) that squared distances would not fit a long.
    """
    label = F.col(label_column) if label_column else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_column).alias("e"))
    rows = rows.filter(F.col("e").isNotNull() & (F.size("e") > 0))
    limit = float(2 ** 26) / SCALE
    fine = rows.filter(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(limit))))
    lengths = fine.groupBy(F.size("e").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    n = lengths[0]["n"] if lengths else 0
    v = F.transform("e", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    if n % PARTS:
        v = F.concat(v, F.array_repeat(F.lit(0).cast("long"), PARTS - n % PARTS))
    return fine.filter(F.size("e") == n).select("vec_id", "label", v.alias("v"))


def _pack(block_rows: int, leaf_rows: int, label_type: pa.DataType):
    def close(ids: list, labels: list, v: list) -> pa.RecordBatch:
        points = np.concatenate(v)
        width = points.shape[1] // PARTS
        trees = [part_tree(points[:, j * width:(j + 1) * width], leaf_rows) for j in range(PARTS)]
        small = points.astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(label_type)),
             pa.array([pickle.dumps((small, [tuple(t) for t in trees]))], pa.binary())], names=["ids", "labels", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, v = [], [], []
        for batch in batches:
            flat = batch.column(2)
            points = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else None
            at = 0
            while at < len(flat):
                more = min(len(flat) - at, block_rows - len(ids))
                ids += batch.column(0)[at:at + more].to_pylist()
                labels += batch.column(1)[at:at + more].to_pylist()
                v.append(points[at:at + more])
                at += more
                if len(ids) == block_rows:
                    yield close(ids, labels, v)
                    ids, labels, v = [], [], []
        if ids:
            yield close(ids, labels, v)
    return pack


def build_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``ids, labels, packed``: the rows in blocks with their trees, written once, without a shuffle; every round reads them."""
    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)),
                           T.StructField("packed", T.BinaryType())])
    return cut_lineage(rows.mapInArrow(_pack(block_rows, leaf_rows, to_arrow_type(label)), schema))


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the smallest ids, ascending (equal ids by vector, null ids last), by part, entry and place."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()  # 16 rows
    v = np.array([r["v"] for r in first], dtype=np.int64)
    return v.reshape(len(first), PARTS, v.size // max(1, PARTS * len(first))).transpose(1, 0, 2)


def lloyd_round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment: each entry the floor of its parts' mean; unused entries stay."""
    _, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, numbers = np.zeros(books.shape, dtype=np.int64), np.zeros((PARTS, k), dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0):
                points, trees = pickle.loads(packed.as_py())
                for j, tree in enumerate(trees):
                    s, c, _ = assign_block(PartTree(*tree), points[:, j * width:(j + 1) * width].astype(np.int64), books[j], True)
                    sums[j] += s
                    numbers[j] += c
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(books.size)), pa.array(sums.ravel()), pa.array(np.repeat(numbers.ravel(), width))],
            names=["cell", "total", "n"])

    parts = blocks.select("packed").mapInArrow(run, "cell long, total long, n long")
    new = books.copy().ravel()
    for r in parts.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        if r["n"]:  # as many rows as the codebooks have components
            new[r["cell"]] = int(r["total"]) // r["n"]
    return new.reshape(books.shape)


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every row of the blocks."""
    width = books.shape[2]
    label = blocks.schema["labels"].dataType.elementType
    arrow_label = to_arrow_type(label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, packed in zip(*[batch.column(i) for i in range(3)], strict=True):
                points, trees = pickle.loads(packed.as_py())
                code, error = np.zeros((len(points), PARTS), dtype=np.uint8), np.zeros(len(points), dtype=np.int64)
                for j, tree in enumerate(trees):
                    own = points[:, j * width:(j + 1) * width].astype(np.int64)
                    chosen = assign_block(PartTree(*tree), own, books[j], False)[2]
                    code[:, j] = chosen
                    error += ((own - books[j][chosen]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.as_py(), pa.int64()), pa.array(labels.as_py(), arrow_label),
                     pa.array([bytes(c).hex() for c in code], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return blocks.mapInArrow(run, schema)


def codebooks_digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal integers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label",
             rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors that ``usable`` keeps, as ``vec_id, label, code, error``, and the codebooks.

    ``code`` holds the indexes of the nearest entries, two hex digits a part. Fewer kept rows than entries give as many entries as
    rows. Equal rows each return a row and share a code; null ids are coded, too. No kept row: an empty table and empty
    codebooks. Only the named columns are read, whatever other columns are called; vectors have no texts, and very
    long vectors are parts of more components.
    """
    rows = usable(vectors, id_column, vector_column, label_column)
    books = first_codebooks(rows)
    blocks = build_blocks(rows, block_rows, leaf_rows)
    if books.size == 0:
        return encode(blocks, books), books
    for _ in range(rounds):
        books = lloyd_round(blocks, books)
    return cut_lineage(encode(blocks, books)), books


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the errors summed over equal labels, null labels together.

    Errors are summed within tasks first, so a label that a third of all rows hold is one row a task; the sums are one row a label.
    """
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
