"""Secret scan with corpus-wide ownership frequency.

Candidate values are found in every whole text, their hashes are counted over distinct repositories
and owners, and the counts tell examples that many owners copy from credentials one owner holds.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timesift.llm.common import cut_lineage

# The patterns of the contract; letters of the key words stand in either case.
KINDS = ("assign", "access", "hex", "bare")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
DUMMY = re.compile(r"example|sample|changeme|placeholder|x{4,}|1234567|abcdef", re.IGNORECASE)

SCAN = ("rid long, doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "found array<struct<start: int, kind: int, end: int, value: string, live: boolean>>")


def looks_live(value: str) -> bool:
    """Random enough to be a credential: at least 2.8 bits a character, and no dummy word."""
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return entropy >= 2.8 and not DUMMY.search(value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret value) of the three base kinds, leftmost and non-overlapping in each."""
    found = []
    plain = text.encode("utf-8", "surrogatepass").lower()
    if any(word in plain for word in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def bare_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Runs of 20 or more key characters in mixed case with digits, outside all base spans."""
    return [(m.start(), 3, m.end(), m[0]) for m in BARE.finditer(text)
            if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])
            and not any(s < m.end() and m.start() < e for s, _, e, _ in taken)]


def _scan(batches):
    for batch in batches:
        cols = {k: batch.column(k).to_pylist() for k in ("rid", "doc_id", "owner", "repo", "text")}
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
        for text in cols.pop("text"):
            base = base_spans(text or "")
            for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(b[1] == kind for b in base))
            listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
            out["base_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
            out["found"].append([
                {"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).hexdigest(), "live": looks_live(v)}
                for s, k, e, v in base + bare_spans(text or "", base)])
        span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
                          ("live", pa.bool_())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols["rid"], pa.int64()), pa.array(cols["doc_id"], pa.int64()), pa.array(cols["owner"], pa.string()),
             pa.array(cols["repo"], pa.string()), *[pa.array(out[n], pa.int64()) for n in ("n_assign", "n_access", "n_hex")],
             pa.array(out["base_sha256"], pa.string()), pa.array(out["found"], pa.list_(span))],
            names=["rid", "doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan_texts(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """Candidate spans of each row of ``docs(doc_id, text, ...)``, written once without the texts."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                       F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"), F.col("text").alias("text"))
    return cut_lineage(rows.mapInArrow(_scan, SCAN))


def ownership(candidates: DataFrame) -> DataFrame:
    """``(value, n_owners, n_repos)`` of ``candidates(value, owner, repo)``.

    Distinct triples and per-owner counts come first, so a value that a third of all rows holds
    reaches no task as more than one row for each task before it.
    """
    triples = candidates.select("value", "owner", "repo").distinct()
    per_owner = triples.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repos"))


def copied_widely(owners: int, least: int = 3, repos_an_owner: int = 10) -> tuple[int, int]:
    """(owners, repositories) from which a value is a copied example, in a corpus of ``owners`` owners.

    Both grow with the logarithm of the corpus's owners: what three of ten owners share is common, three of a million is not.
    """
    enough = max(least, math.ceil(math.log2(1 + owners)))
    return enough, repos_an_owner * enough


def find_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", example_owners: int = 3, repos_an_owner: int = 10) -> DataFrame:
    """All spans of each document with the verdict of their owners and repositories.

    A value is a copied example when ``copied_widely`` owners hold it, or so many repositories of two owners
    or more. Else it belongs to its few owners and is live when it looks random, in however many of one owner's repositories.
    Base spans always stay; a bare span is added only when its value is
    live. Null texts are empty; a null owner is one owner of its own, a null repository likewise;
    repeated rows each return a row. An empty table returns none. Very long texts are searched whole. Only the named columns are read.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repos``; the
    last two are the greatest counts among the document's values, 0 without a value.
    """
    scanned = scan_texts(docs, owner, repo)
    owners_needed, repos_needed = copied_widely(scanned.select("owner").distinct().count(), example_owners, repos_an_owner)
    head = ["rid", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    some = scanned.filter(F.size("found") > 0)
    each = some.select("rid", "owner", "repo", F.explode("found").alias("f")).select("rid", "owner", "repo", "f.*")
    counts = cut_lineage(ownership(each))  # a written side: Spark can split a hot value of the other
    judged = (
        each.join(counts, "value")
        .withColumn("example", (F.col("n_owners") >= owners_needed) | ((F.col("n_owners") >= 2) & (F.col("n_repos") >= repos_needed)))
        .withColumn("is_live", F.col("live") & ~F.col("example"))
        .filter((F.col("kind") < 3) | F.col("is_live"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    by_doc = judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"),
        F.sum(F.col("is_live").cast("long")).alias("n_live"), F.sum(F.col("example").cast("long")).alias("n_example"),
        F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    counted = ["n_live", "n_example", "most_owners", "most_repos"]
    by_doc = by_doc.select("rid", *counted, F.array_join(F.transform(
        "s", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"),
                                   x["end"].cast("string"))), ",").alias("spans"))
    out = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *counted]
    zero = F.lit(0).cast("long")
    with_some = some.select(*head).join(by_doc, "rid", "left").fillna({"spans": "", **dict.fromkeys(counted, 0)})
    none = scanned.filter(F.size("found") == 0).select(
        *head, *[zero.alias(c) for c in counted], F.lit("").alias("spans"))
    return with_some.select(*out).unionByName(none.select(*out))
