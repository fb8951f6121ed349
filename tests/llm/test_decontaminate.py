"""Hits against a brute-force window search."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import docs, words
from timesift.llm import decontaminate as d


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    own, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        n = min(13, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(own), len(hit), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(own)


def tables(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 30))) for i in range(6)] + [(6, "Tiny Item"), (7, None), (8, ""), (9, "!!"), (0, "again 0"), (None, "no number here")]
    texts = [(i, " ".join(words(rng, 60))) for i in range(12)]
    texts += [(20, "É x, " + items[0][1].upper() + " tail"), (21, " ".join(items[1][1].split()[5:19]) + " z" * 400), (22, "a tiny-item b"), (23, None), (24, ""),
              (25, " ".join(words(rng, 3000)) + " " + items[2][1]), (26, "we say no number here"), (20, "É x, " + items[0][1].upper() + " tail")]
    return texts, items, docs(spark, texts, extra=True), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("per_pass", [2_000_000, 60])
def test_equals_brute_force_in_one_pass_and_in_several(spark, per_pass):
    texts, items, table, benchmark = tables(spark)
    got = d.overlap_digest(d.find_overlap(table, benchmark, per_pass=per_pass)).collect()
    want = []
    for doc, text in texts:
        n, hit, found, dirty = brute(text, items)
        want.append((doc, n, hit, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), dirty))
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("per_pass", [2_000_000, 60])
def test_removal_keeps_clean_rows_and_columns(spark, per_pass):
    texts, items, table, benchmark = tables(spark)
    kept = d.remove_contaminated(table, benchmark, per_pass=per_pass)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in texts if not brute(t, items)[3])


def test_spans_go_and_the_rest_stays(spark):
    item = " ".join(f"q{i}" for i in range(13))
    table = docs(spark, [(1, f"Before it, {item}. After it!"), (2, "clean text")])
    got = {r.doc_id: r.text for r in d.remove_contaminated(table, spark.createDataFrame([(1, item)], "item_id long, text string"), spans=True).collect()}
    assert got == {1: "Before it, . After it!", 2: "clean text"}


def test_empty_tables(spark):
    texts, _, table, benchmark = tables(spark)
    assert d.find_overlap(table.limit(0), benchmark).count() == 0
    assert {r.n_hit for r in d.overlap_digest(d.find_overlap(table, benchmark.limit(0))).collect()} == {0}


def test_spans_go_in_several_passes_as_in_one(spark):
    texts, _, table, benchmark = tables(spark)
    odd = table.withColumn("__rid", F.lit("mine")).withColumn("__text", F.lit("other"))
    one = sorted(map(tuple, d.remove_contaminated(odd, benchmark, spans=True).collect()), key=repr)
    several = d.remove_contaminated(odd, benchmark, spans=True, per_pass=60)
    assert several.columns == odd.columns and sorted(map(tuple, several.collect()), key=repr) == one
    assert [r[1] for r in one] != [t for _, t in texts] and {r[-2:] for r in one} == {("mine", "other")}
    assert sorted(map(tuple, d.remove_contaminated(odd, benchmark, per_pass=60).collect()), key=repr) == sorted(
        map(tuple, d.remove_contaminated(odd, benchmark).collect()), key=repr)
    assert d.find_overlap(odd, benchmark).count() == odd.count()


def test_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(13))
    text = "word " * 200_000 + item + " word" * 200_000
    got = d.overlap_digest(d.find_overlap(docs(spark, [(1, text)]), spark.createDataFrame([(1, item)], "item_id long, text string"))).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (400_013, 13, False)
