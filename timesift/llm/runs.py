"""Periodic runs of words, found with string synchronising sets.

At each scale t = 4, 8, 16, ... a set of positions is selected by hashes of the next t words, so that equal
surroundings select equal positions (local consistency) and every stretch of 3 t - 1 words that has no period of
t / 4 or less holds a selected position among its first t. A run of period p in [t, 2 t) that repeats four times or more therefore
holds two selected positions p apart with the same next 2 t words, and nothing equal between them: neighbours of equal context propose the
period, and the longest common extension to both sides gives the run. What a scale omits, the
highly periodic stretches, are the runs of smaller periods, already found; periods 1 to 3, which start them, are compared directly.
Every run is compared word by word before it counts, so hashes decide where to look and never what is found.

Many texts are searched as one sequence, parted by symbols that occur once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES = 4
"""Least number of periods in a run; the argument above needs four."""
DIRECT_PERIODS = 3
SEQUENCE_WORDS = 262_144
"""Words that are searched as one sequence; a longer text is a sequence of its own."""
_PRIMES = (np.uint64(2_147_483_647), np.uint64(2_147_483_629))
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprints:
    """Equality of stretches of one sequence by two polynomial hashes below 2^31."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        mixed = _scramble(symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.powers, self.sums = [], []
        for at, prime in enumerate(_PRIMES):
            power = np.ones(n + 1, dtype=np.uint64)
            have, step = 1, np.uint64(1_000_003 + 2 * at)
            while have <= n:  # powers double: the known ones times the next power
                more = min(have, n + 1 - have)
                power[have:have + more] = power[:more] * step % prime
                have, step = have + more, step * step % prime
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(mixed % prime * power[:n] % prime, out=sums[1:])
            self.powers.append(power)
            self.sums.append(sums % prime)

    def windows(self, length: int) -> np.ndarray:
        """One number for each stretch of ``length`` words, by its start."""
        n = len(self.sums[0]) - 1
        out = np.zeros(n - length + 1, dtype=np.uint64)
        for prime, power, sums in zip(_PRIMES, self.powers, self.sums, strict=True):
            part = (sums[length:] + prime - sums[:n - length + 1]) % prime
            out = (out << np.uint64(31)) | (part * power[n - length::-1][:n - length + 1] % prime)
        return out

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether the stretches at ``a`` and at the later ``b`` are equal."""
        equal = np.ones(len(a), dtype=bool)
        for prime, power, sums in zip(_PRIMES, self.powers, self.sums, strict=True):
            left = (sums[a + length] + prime - sums[a]) % prime * power[b - a] % prime
            equal &= left == (sums[b + length] + prime - sums[b]) % prime
        return equal

    def extend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the sequence agrees before, and from, each pair of positions ``a < b``."""
        n = len(self.sums[0]) - 1
        left, right = np.zeros_like(a), np.zeros_like(a)
        step = 1 << max(0, n.bit_length() - 1)
        while step:
            fits = np.flatnonzero(b + right + step <= n)
            good = fits[self.same(a[fits] + right[fits], b[fits] + right[fits], step)]
            right[good] += step
            fits = np.flatnonzero(a - left - step >= 0)
            good = fits[self.same(a[fits] - left[fits] - step, b[fits] - left[fits] - step, step)]
            left[good] += step
            step >>= 1
        return left, right


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: running minima from both ends of blocks of that width."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _NEVER, dtype=np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def synchronising_set(prints: Fingerprints, n: int, scale: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Selected positions at ``scale``; the runs given are those found so far, which tell the highly periodic windows."""
    windows = _scramble(prints.windows(scale)) >> np.uint64(1)  # below _NEVER
    omit = (periods * TIMES <= scale) & (lengths >= scale)
    if omit.any():
        edges = np.zeros(len(windows) + 1, dtype=np.int64)
        np.add.at(edges, starts[omit], 1)
        np.add.at(edges, starts[omit] + lengths[omit] - scale + 1, -1)
        windows[np.cumsum(edges[:-1]) > 0] = _NEVER
    least = _window_minimum(windows, scale + 1)
    at_edge = (windows[:n - 2 * scale + 1] == least) | (windows[scale:] == least)
    return np.flatnonzero(at_edge & (least != _NEVER))


def _islands(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2] - edges[::2]


def _checked(symbols: np.ndarray, start: int, end: int, period: int, inside: int) -> tuple[int, int]:
    """The stretch around ``inside`` that keeps ``period``, word by word; as given unless a hash misled."""
    n = len(symbols)
    fine = (symbols[start:end - period] == symbols[start + period:end]).all()
    fine = fine and (start == 0 or symbols[start - 1] != symbols[start - 1 + period])
    if fine and (end == n or symbols[end] != symbols[end - period]):
        return start, end
    for at, size in zip(*_islands(symbols[:-period] == symbols[period:]), strict=True):
        if at <= inside < at + size:
            return int(at), int(at + size + period)
    return inside, inside


def find_runs(symbols: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all maximal runs with at least ``TIMES`` periods, by start, then period.

    ``longest`` bounds the length of a run, where known (the longest text of the sequence).
    """
    n = len(symbols)
    longest = min(n, longest or n)
    found: dict[tuple[int, int], int] = {}  # a longer period of the same stretch is a multiple

    def keep(start: int, end: int, period: int) -> None:
        if end - start >= TIMES * period:
            found.setdefault((start, end), period)

    for period in range(1, min(DIRECT_PERIODS, longest // TIMES) + 1):
        at, size = _islands(symbols[:-period] == symbols[period:])
        for i in np.flatnonzero(size >= (TIMES - 1) * period):
            keep(int(at[i]), int(at[i] + size[i]) + period, period)
    prints = Fingerprints(symbols) if longest >= TIMES * (DIRECT_PERIODS + 1) else None
    scale = DIRECT_PERIODS + 1
    while prints is not None and TIMES * scale <= longest:
        known = np.array([(s, e - s, p) for (s, e), p in found.items()], dtype=np.int64).reshape(-1, 3)
        chosen = synchronising_set(prints, n, scale, *known.T)
        context = prints.windows(2 * scale)[chosen]
        order = np.argsort(context, kind="stable")  # positions stay in order within a context
        a, b = chosen[order[:-1]], chosen[order[1:]]
        near = (context[order[:-1]] == context[order[1:]]) & (b - a >= scale) & (b - a < 2 * scale)
        a, b = a[near], b[near]
        if len(a):
            left, right = prints.extend(a, b)
            stretches = np.stack([a - left, b + right, b - a, a], axis=1)
            stretches = stretches[stretches[:, 1] - stretches[:, 0] >= TIMES * stretches[:, 2]]
            _, first = np.unique(stretches[:, :3], axis=0, return_index=True)
            for start, end, period, inside in stretches[first].tolist():
                keep(*_checked(symbols, start, end, period, inside), period)
        scale *= 2
    runs = np.array(sorted((s, p, e - s) for (s, e), p in found.items()), dtype=np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def runs_of_texts(texts: list[list[bytes]], least: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs ``(start, length, period)`` of each list of words, and its words without the repeats, joined by one space."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    total = int(sizes.sum())
    if total == 0:
        return [([], b"")] * len(texts)
    codes = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    at = np.concatenate(([0], np.cumsum(sizes + 1)))  # first place of each text; a symbol of its own ends it
    symbols = np.empty(total + len(texts), dtype=np.int64)
    ends = at[1:] - 1
    symbols[ends] = codes.max() + 1 + np.arange(len(texts))
    inner = np.ones(len(symbols), dtype=bool)
    inner[ends] = False
    symbols[inner] = codes
    starts, lengths, periods = find_runs(symbols, int(sizes.max()))
    enough = lengths >= least
    starts, lengths, periods = starts[enough], lengths[enough], periods[enough]
    repeats = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(repeats, starts + periods, 1)
    np.add.at(repeats, starts + lengths, -1)
    dropped = np.cumsum(repeats)[:-1] > 0
    owner = np.searchsorted(at, starts, side="right") - 1
    runs: list[list] = [[] for _ in texts]
    for who, start, length, period in zip(owner.tolist(), starts.tolist(), lengths.tolist(), periods.tolist(), strict=True):
        runs[who].append((start - int(at[who]), length, period))
    out = []
    for i, words in enumerate(texts):
        kept = [w for w, gone in zip(words, dropped[at[i]:at[i + 1]].tolist(), strict=False) if not gone] if runs[i] else words
        out.append((runs[i], b" ".join(kept)))
    return out


def _search(least: int, sequence_words: int, id_type: pa.DataType):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        got = runs_of_texts(texts, least)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([[{"start": s, "length": n, "period": p} for s, n, p in g[0]] for g in got], pa.list_(run)),
             pa.array([g[1].decode("utf-8") for g in got], pa.string())], names=["__id", "n_words", "runs", "collapsed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for who, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # blank, tab, line feed, vertical tab, form feed, carriage return
                if texts and size + len(words) > sequence_words:
                    yield answer(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(who.as_py())
                texts.append(words)
                size += len(words)
            if texts:
                yield answer(ids, texts)
    return search


def periodic_runs(docs: DataFrame, least: int = 6, id_column: str = "doc_id", text_column: str = "text",
                  sequence_words: int = SEQUENCE_WORDS) -> DataFrame:
    """``id_column, n_words, runs, collapsed`` of each row.

    ``runs`` lists ``(start, length, period)`` of every maximal stretch of words with smallest period ``period`` and at
    least ``least`` words and ``TIMES`` periods, by start, then period; ``collapsed`` is the text without
    the words that a run repeats after its first period, joined by one space. Words are parted by ASCII white space.

    A null or empty text has no words and no runs; repeated rows each return a row, null ids too; an empty table returns none.
    A very long text is searched whole, in memory in proportion to its words. Only the two named columns are
    read, whatever other columns are called. One pass without a shuffle: a lost task is simply run again.
    """
    id_field = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").cast("binary").alias("__text"))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = (f"__id {id_field.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, "
              "collapsed string")
    return rows.mapInArrow(_search(least, sequence_words, to_arrow_type(id_field)), schema).withColumnRenamed("__id", id_column)


def looped_text(doc_id: Column, text: Column) -> Column:
    """The text that the query searches: of one id in ten, all words from one on repeat a stretch of words.

    With h the crc32 of the id in decimal (a null id: of nothing) and g = h div 10, the ids are those with h mod 10 = 0; word i from
    a = g mod n on becomes word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def looped(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, source(i).cast("int"))), " "))

    # One-element array: the words are cut once and then named.
    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), looped), 0)).otherwise(text)


def run_digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``n_runs``, the run of greatest exponent (ties: smallest start, then period), and digests of ``periodic_runs``.

    Exponents are compared by cross products, not by quotients. Without a run the four values are null.
    """
    def stronger(a: Column, b: Column) -> Column:
        more = a["length"] * b["period"] - b["length"] * a["period"]
        first = F.when(more != 0, more > 0).when(a["start"] != b["start"], a["start"] < b["start"]).otherwise(a["period"] <= b["period"])
        return F.when(first, a).otherwise(b)

    runs = F.col("runs")
    best = F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, 0), stronger))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("__best", best).select(
        id_column, F.size(runs).cast("long").alias("n_runs"),
        F.col("__best.start").alias("start"), F.col("__best.length").alias("length"), F.col("__best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("__best.length") / F.col("__best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
