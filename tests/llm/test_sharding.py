"""Shards: gapless slots, even sizes, few cut links."""

import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from helpers import docs, words
from timesift.llm import sharding
from timesift.llm.common import table

SF = "/root/testdata/sf0.1"


def check(rows, got, shards=40):
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got) == want
    return [sum(r["size"] for r in got if r.shard == s) for s in range(shards)]


def spread(rows, got):
    at, texts = {}, {}
    for d, t in rows:
        texts[d] = t
    for r in got:
        at.setdefault(texts[r.doc_id], []).append(r.shard)
    return [len(set(v)) for t, v in at.items() if t is not None and len(v) > 1]


def test_groups_stay_whole_and_sizes_even(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for size in [1] * 1500 + [2] * 120 + [5] * 30 + [40] * 4:
        text = " ".join(words(rng, rng.randrange(5, 120)))
        for _ in range(size):
            rows.append((n, text))
            n += 1
    got = sharding.assign(docs(spark, rows, extra=True)).collect()
    loads = check(rows, got)
    assert max(loads) - min(loads) <= 0.08 * sum(loads) / 40
    parts = spread(rows, got)
    assert sum(p == 1 for p in parts) >= 0.9 * len(parts)


def test_a_group_larger_than_a_shard_is_cut_in_few_parts(spark):
    rng = random.Random(6)
    rows = [(i, "the same text everywhere " * 4) for i in range(800)] + [(1000 + i, " ".join(words(rng, 25))) for i in range(1600)]
    got = sharding.assign(docs(spark, rows)).collect()
    loads = check(rows, got)
    assert max(loads) - min(loads) <= 0.1 * sum(loads) / 40


def test_edges(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, "x"), (5, "y"), (5, "y"), (6, "é" * 100_000), (7, "z")]
    check(rows, sharding.assign(docs(spark, rows, extra=True)).collect())
    assert sharding.assign(docs(spark, rows).limit(0)).count() == 0
    again = [sorted(map(tuple, sharding.assign(docs(spark, rows)).collect()), key=repr) for _ in range(2)]
    assert again[0] == again[1]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = sharding.assign(table(spark, SF, "documents")).collect()
    loads = check(rows, got)
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 40
    parts = spread(rows, got)
    assert sum(p == 1 for p in parts) >= 0.95 * len(parts)


def test_a_table_made_only_of_pairs(spark):
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.randrange(5, 60))) + f" n{i}" for i in range(1500)]
    rows = [(i, texts[i % len(texts)]) for i in range(2 * len(texts))]
    got = sharding.assign(docs(spark, rows)).collect()
    loads = check(rows, got)
    assert spread(rows, got) == [1] * len(texts)
    assert max(loads) - min(loads) <= 0.1 * sum(loads) / 40


def test_groups_that_no_shard_holds_are_cut_in_few_parts(spark):
    rows = [(i, f"group {i % 60:02d} of text") for i in range(60 * 200)]  # two thirds of a shard each
    got = sharding.assign(docs(spark, rows)).collect()
    loads = check(rows, got)
    parts = spread(rows, got)
    assert sum(p == 1 for p in parts) >= 40 and max(parts) <= 3
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 40
    giant = [(i, "the same text everywhere") for i in range(1000)] + [(5000 + i, f"another text no. {i // 2:06d}") for i in range(3000)]
    got = sharding.assign(docs(spark, giant)).collect()  # 10 shards of one group, the others of pairs
    check(giant, got)
    parts = spread(giant, got)
    assert sorted(parts)[:-1] == [1] * 1500 and parts[0] <= 11


def test_documents_move_to_their_neighbours(spark):
    """The rounds bring groups together that the hash had cut, within the quota, and they carry the result."""
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.randrange(5, 60)))) for i in range(300)]
    rows += [(1000 + 50 * g + k, f"group {g} " + "copied text " * (g % 7 + 1)) for g in range(40) for k in range(rng.randrange(2, 9))]
    table = docs(spark, rows)
    linked = sharding.measured(table)
    groups = linked.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1")
    started = linked.join(groups.select("g"), "g", "left_semi").withColumn("shard", sharding._bucket(8).cast("int"))
    names = spark.range(8).select(F.col("id").cast("int").alias("shard"))
    mean = linked.agg(F.sum("size")).first()[0] / 8
    moved = sharding.propagate(started, sharding._loads(names), 8, mean, 6)
    before = sharding.cut_links(started, table).first()
    after = sharding.cut_links(moved, table).first()
    changed = started.join(moved.select("doc_id", F.col("shard").alias("now")), "doc_id").filter("shard != now").count()
    assert changed > 20 and before.whole < 0.3 * before.groups and after.whole >= 0.9 * after.groups == 0.9 * before.groups
    assert max(r[0] for r in moved.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()) <= mean
    homes = {r.g: r.shard for r in sharding.settled_groups(moved, names, mean, 16).collect()}
    final = {r.doc_id: r.shard for r in sharding.assign(table, 8).collect()}
    kept = sum(all(final[r.doc_id] == homes[r.g] for r in rs) for rs in [[r for r in moved.collect() if r.g == g] for g in homes])
    assert kept >= 0.9 * len(homes) > 20
