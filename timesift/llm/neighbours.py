"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Vectors lie in blocks of a bounded number of
rows; each block posts its vectors, with the pivot's place in their order, in one inverted file a
pivot. A query adds up place differences over the files of its own pivots (the footrule distance), and the best
share of each block is ranked again by the exact distance.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timesift.llm.common import cut_lineage

PIVOTS = 128
PREFIX = 96
"""Nearest pivots under which a vector is posted; a pivot not among them counts as place ``PREFIX``."""
SAMPLE_ROWS = 4_096
"""Vectors that pivots are picked from, by a hash of vec_id."""
BLOCK_ROWS, QUERY_ROWS = 2_048, 512
MEET_BLOCKS, MEET_QUERIES = 8, 64
"""Blocks of vectors and of queries that meet in a task at most."""
MEETINGS = 48
"""Tasks that blocks of vectors are dealt to before one takes several."""
SHARE, LEAST = 0.15, 400
"""Part of a block, and least number of its vectors, that is ranked again for a query."""


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, one row a vec_id.

    Left out: null ids, null or zero vectors, null or non-finite components, and lengths other than
    the most frequent. Of several vectors with one id the smallest in array order stays.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").filter(
        F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    lengths = fine.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not lengths:
        return fine.limit(0)
    return fine.filter(F.size("v") == lengths[0]["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))


def pick_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Up to ``pivots`` distinct vectors of a bounded sample, in hash order."""
    n = vectors.count()
    share = int(min(1.0, sample_rows / max(1, n)) * 1_000_000) + 1
    rows = (vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).select("v").distinct()
            .orderBy(F.xxhash64("v"), "v").limit(pivots))
    got = [r["v"] for r in rows.collect()]  # ``pivots`` rows
    return np.array(got, dtype=np.float64).reshape(len(got), -1 if got else 0)


def places(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Place of each pivot in the order of each vector's nearest pivots; ``prefix`` where it is further."""
    near = ((x ** 2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots ** 2).sum(1)[None]).argsort(axis=1, kind="stable")[:, :prefix]
    out = np.full((len(x), len(pivots)), prefix, dtype=np.int16)
    np.put_along_axis(out, near, np.arange(near.shape[1], dtype=np.int16)[None], axis=1)
    return out


def inverted_files(ranks: np.ndarray, prefix: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot, the vectors posted under it and the gain over a pivot that both miss, for each place of the query."""
    files = []
    for p in range(ranks.shape[1]):
        rows = np.flatnonzero(ranks[:, p] < prefix)
        files.append((rows, ranks[rows, p].astype(np.int32)))
    return files


def nearest(block: dict, ids: np.ndarray, queries: np.ndarray, query_ranks: np.ndarray, k: int, prefix: int, share: float,
            least: int) -> list[tuple[int, int, float]]:
    """(query, vector, distance) of the ``k`` nearest in the block to each query, among the best by footrule."""
    found, n = [], len(block["ids"])
    files = inverted_files(block["ranks"], prefix)
    take = min(n, max(least, math.ceil(share * n)))
    for qid, q, ranks in zip(ids, queries, query_ranks, strict=True):
        if take < n:
            footrule = np.zeros(n, dtype=np.int32)  # less the constant of two orders that share no pivot
            for p in np.flatnonzero(ranks < prefix):
                rows, at = files[p]
                footrule[rows] += np.abs(at - ranks[p]) - (prefix - at) - (prefix - int(ranks[p]))
            cut = np.partition(footrule, take - 1)[take - 1]
            rows = np.flatnonzero(footrule <= cut)
        else:
            rows = np.arange(n)
        rows = rows[block["ids"][rows] != qid]
        distance = np.sqrt(((block["v"][rows] - q) ** 2).sum(axis=1))
        best = np.lexsort((block["ids"][rows], distance))[:k]
        found += [(int(qid), int(block["ids"][rows[i]]), float(distance[i])) for i in best]
    return found


def _packed(pivots: np.ndarray, prefix: int):
    def pack(data: pa.Table) -> pa.Table:
        ids = data.column("vec_id").to_numpy()
        order = np.argsort(ids)
        v = np.array(data.column("v").to_pylist(), dtype=np.float64)[order]
        block = {"ids": ids[order], "v": v, "ranks": places(v, pivots, prefix)}
        return pa.table({"block": data.column("block")[:1], "packed": pa.array([pickle.dumps(block)], pa.binary())})
    return pack


def build_index(vectors: DataFrame, pivots: np.ndarray, block_rows: int = BLOCK_ROWS, prefix: int = PREFIX) -> DataFrame:
    """``block, packed``: all vectors, dealt evenly over blocks by a hash of their distinct ids."""
    blocks = max(1, math.ceil(vectors.count() / block_rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(blocks)))
    return cut_lineage(dealt.groupBy("block").applyInArrow(_packed(pivots, prefix), "block long, packed binary"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of ``queries``, itself such an index, among ``index``.

    A task holds up to ``MEET_BLOCKS`` blocks of vectors and ``MEET_QUERIES`` of queries, sent there by number; ``k`` rows a query leave it at most.
    """
    schema = "query_id long, vec_id long, score double"
    blocks, asked = (x.select("block").agg(F.max("block")).first()[0] for x in (index, queries))
    if blocks is None or asked is None:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = min(MEET_BLOCKS, max(1, (blocks + 1) // MEETINGS))
    parts, turns = blocks // each + 1, asked // MEET_QUERIES + 1
    met = index.select(F.floor(F.col("block") / each).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "packed")
    sent = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
                          F.floor(F.col("block") / MEET_QUERIES).cast("int").alias("turn"), "packed")

    def run(held: pa.Table, sought: pa.Table) -> pa.Table:
        ids, scores = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0)]
        blocks = [pickle.loads(x.as_py()) for x in held.column("packed")]
        for x in sought.column("packed"):
            q = pickle.loads(x.as_py())
            got = [n for block in blocks for n in nearest(block, q["ids"], q["v"], q["ranks"], k, prefix, share, least)]
            pair, score = np.array([n[:2] for n in got], dtype=np.int64).reshape(-1, 2), np.array([n[2] for n in got], dtype=np.float64)
            order = np.lexsort((pair[:, 1], score, pair[:, 0]))
            pair, score = pair[order], score[order]
            first = np.flatnonzero(np.diff(pair[:, 0], prepend=pair[:1, 0] - 1))
            stay = np.arange(len(pair)) - np.repeat(first, np.diff(first, append=len(pair))) < k
            ids.append(pair[stay])
            scores.append(score[stay])
        pair = np.concatenate(ids)
        return pa.table({"query_id": pair[:, 0], "vec_id": pair[:, 1], "score": np.concatenate(scores)})

    pairs = met.groupBy("part", "turn").cogroup(sent.groupBy("part", "turn")).applyInArrow(run, schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest found of each vector whose vec_id is divisible by ``every``, among all others.

    Distances are Euclidean in double precision on the original vectors; ties go to the smaller vec_id,
    and vectors that tie at the footrule limit all are ranked again, so equal vectors are found or
    missed together. Rows that ``usable`` leaves out are neither asked nor found. Fewer others than ``k``: all.
    """
    table = cut_lineage(usable(vectors))
    pivots = pick_pivots(table)
    index = build_index(table, pivots)
    queries = build_index(table.filter(F.pmod("vec_id", F.lit(every)) == 0), pivots, QUERY_ROWS)
    return search(index, queries, k)
