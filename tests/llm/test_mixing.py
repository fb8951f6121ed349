"""The mix against a plain water-filling and a plain walk."""

import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from helpers import docs, words
from timesift.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def plain_mix(rows, seed=17):
    found = []
    for doc, text, source in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        head = f"{seed}|{'' if doc is None else doc}|{hashlib.md5((text or '').encode()).hexdigest()}"
        u = (int(hashlib.md5(head.encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        share = len([c for c in text if c not in "#$%&*|!"]) / len(text) if text else 0.05
        found.append((source, -math.log(u) / max(0.05, min(1.0, share)), doc, size))
    sizes = {}
    for s, _, _, n in found:
        sizes[s] = sizes.get(s, 0) + n
    target, out = plain_targets(sizes), []
    for s in sizes:
        epochs = int(target[s] // sizes[s]) if sizes[s] else 0
        rest, before = target[s] - epochs * sizes[s], 0
        for _, _, doc, n in sorted((f for f in found if f[0] == s), key=lambda f: (f[1], f[2] is not None, f[2])):
            extra = n > 0 and 2 * before + n < 2 * rest
            out.append((doc, n, sizes[s], round(target[s], 6), (epochs + extra) * n))
            before += n
    return out


def rows_of(seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 60))) + rng.choice(["", "###", " | ||"]), rng.choice(["a", "b", "c", "d", "é", "z", None, "a", "a"]))
            for i in range(400)]
    return rows + [(900, None, "a"), (901, "", "b"), (902, "x", "tiny"), (5, *rows[5][1:]), (5, *rows[5][1:])]


def test_equals_a_plain_walk_and_itself(spark):
    rows, columns = rows_of(), ["doc_id", "size", "source_size", "target", "taken"]
    df = mixing.mix(docs(spark, rows, extra=True))
    got = [tuple(r) for r in df.select(*columns[:3], F.round("target", 6), "taken").collect()]
    assert sorted(got) == sorted(plain_mix(rows))
    assert sorted(got) == sorted(tuple(r) for r in mixing.mix(docs(spark, rows[::-1])).select(*columns[:3], F.round("target", 6), "taken").collect())


def test_taken_is_near_the_target_and_under_the_cap(spark):
    got = mixing.mix(docs(spark, rows_of())).collect()
    by = {}
    for r in got:
        assert r.taken <= 3 * r["size"]
        key = (r.target, r.source_size)
        by.setdefault(key, []).append(r)
    for (target, _), rows in by.items():
        assert abs(sum(r.taken for r in rows) - target) <= max(r["size"] for r in rows) / 2 + 1e-6


def test_documents_come_as_often_as_taken(spark):
    rows = rows_of()
    table = docs(spark, rows, extra=True)
    kept = mixing.mixed_documents(table)
    assert kept.columns == table.columns
    counts = {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    want = {}
    for r in mixing.mix(docs(spark, rows)).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert counts == {k: v for k, v in want.items() if v}


def test_empty_and_all_empty_texts(spark):
    assert mixing.mix(docs(spark, [(1, "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in mixing.mix(docs(spark, [(1, None), (2, "")])).select("size", "taken").collect()] == [(0, 0), (0, 0)]


def test_weighted_documents_come_first(spark):
    rows = [(i, "word " * 10 + ("#" * 400 if i % 2 else "")) for i in range(600)]
    table = docs(spark, [(i, t, "a") for i, t in rows] + [(10_000 + i, "word " * 10, "b") for i in range(3000)])
    taken = [r.doc_id for r in mixing.mix(table).filter("copies > 0 AND doc_id >= 10000").collect()]
    assert 0 < len(taken) < 3000
    keyed = mixing.keyed_sizes(table, mixing.text_weight(F.col("text")), 17).filter("doc_id < 600")
    mean = {r.odd: r.k for r in keyed.groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("mix_key").alias("k")).collect()}
    assert mean[1] > 3 * mean[0]


def test_a_source_of_mostly_one_repeated_row_ends_at_its_target(spark):
    rows = [(None, "the same words each time", "a")] * 300 + [(7, "one row that came often", "b")] * 500 + [(i, "some other words", "b") for i in range(100, 140)]
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    table = docs(spark, rows, extra=True)
    got = [tuple(r) for r in mixing.mix(table).select(*columns[:3], F.round("target", 6), "taken").collect()]
    assert sorted(got, key=repr) == sorted(plain_mix(rows), key=repr)
    want = sum(r[4] // r[1] for r in got)
    assert mixing.mixed_documents(table).count() == want
    for size, target in {(r[2], r[3]) for r in got}:
        mine = [r for r in got if r[2] == size]
        assert abs(sum(r[4] for r in mine) - target) <= max(r[1] for r in mine) / 2 + 1e-6


def test_key_buckets_rise_with_the_key_and_are_even(spark):
    rows = spark.range(20_000).select((-F.log((F.col("id") + 0.5) / 20_000) / F.when(F.col("id") % 3 == 0, 0.05).otherwise(1.0)).alias("key"))
    bounds = rows.agg(F.percentile_approx("key", mixing.SHARES, 10_000).alias("bounds"))
    placed = rows.crossJoin(bounds).select("key", mixing.key_bucket(F.col("key"), F.col("bounds"), 50).alias("bucket"))
    got = sorted((r.key, r.bucket) for r in placed.collect())
    assert [b for _, b in got] == sorted(b for _, b in got) and got[0][1] >= 0 and got[-1][1] == 49
    sizes = [sum(b == i for _, b in got) for i in range(50)]
    assert max(sizes) < 3 * 400
    few = spark.createDataFrame([(1.0, [1.0] * len(mixing.SHARES)), (1.0, None)], "key double, bounds array<double>")
    assert all(0 <= r[0] < 50 for r in few.select(mixing.key_bucket(F.col("key"), F.col("bounds"), 50)).collect())
