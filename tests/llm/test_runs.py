"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from helpers import docs
from pyspark.sql import functions as F
from timesift.llm import runs


def every_period(words, least=6):
    """All runs: maximal stretches of every period, the smallest period of a stretch first."""
    n, seen, out = len(words), set(), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= 4 * p and (i, j + p) not in seen:
                seen.add((i, j + p))
                if j + p - i >= least:
                    out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = [w for w in (text or "").translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = every_period(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def looping(rng):
    kinds = rng.choice([1, 2, 3, 60])
    out = [rng.randrange(kinds) for _ in range(rng.randrange(300))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(kinds) for _ in range(rng.randrange(1, 60))]
        if len(unit) > 8 and rng.random() < 0.5:
            unit = (unit[:2] * 40)[:len(unit) - 1] + [77]  # periodic inside: omitted by its own scale
        at = rng.randrange(len(out) + 1)
        out[at:at] = (unit * rng.randrange(2, 9))[:-rng.randrange(1, len(unit) + 1)]
    return [f"w{x}".encode() for x in out]


def test_runs_equal_a_search_of_every_period():
    rng = random.Random(11)
    for _ in range(25):
        texts = [looping(rng) for _ in range(40)]
        for words, (found, kept) in zip(texts, runs.runs_of_texts(texts, 6), strict=True):
            want = every_period(words)
            assert found == want
            gone = {i for s, length, p in want for i in range(s + p, s + length)}
            assert kept == b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_large_periods_and_long_texts():
    rng = random.Random(4)
    unit = [rng.randrange(500) for _ in range(7000)]
    text = np.array([rng.randrange(500) for _ in range(999)] + unit * 4 + unit[:55] + [501] + [7] * 3000 + [502])
    got = set(zip(*[x.tolist() for x in runs.find_runs(text)], strict=True))
    assert {(999, 28055, 7000), (29055, 3000, 1)} <= {(s, n, p) for s, n, p in got}
    assert runs.runs_of_texts([[b"a", b"b"] * 100_000], 6)[0] == ([(0, 200_000, 2)], b"a b")


def test_thue_morse_words_have_no_run():
    text = np.array([bin(i).count("1") % 2 for i in range(1 << 15)])
    assert len(runs.find_runs(text)[0]) == 0


def test_a_hash_that_misleads_changes_nothing(monkeypatch):
    """With a hash under which many stretches look equal, every run that is returned is still true."""
    monkeypatch.setattr(runs, "_PRIMES", (np.uint64(5), np.uint64(7)))
    rng = random.Random(8)
    for _ in range(30):
        words = looping(rng)
        codes = np.unique(np.array(words or [b""]), return_inverse=True)[1].astype(np.int64)
        for s, n, p in zip(*runs.find_runs(codes), strict=True):
            assert (codes[s:s + n - p] == codes[s + p:s + n]).all() and n >= 4 * p


def test_query_equals_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, b" ".join(looping(rng)).decode()) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "one"), (203, "one"), (None, "x " * 9), (204, "a b a b a b a b a b a b"),
             (205, "so " * 5), (206, "so " * 6), (207, "é ß " * 4), (30, "loop\x0bloop\x0cloop\rloop\nloop loop")]
    table = docs(spark, rows, extra=True)
    asked = table.withColumn("text", runs.looped_text(F.col("doc_id"), F.col("text")))
    got = runs.run_digest(runs.periodic_runs(asked, sequence_words=2000)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain(*r[:2]) for r in rows), key=repr)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_empty_table(spark):
    assert runs.run_digest(runs.periodic_runs(docs(spark, [(1, "x")]).limit(0))).count() == 0
