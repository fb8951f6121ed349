"""Append-only access logs: building the hash chain and checking it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timesift.functions import identity
from timesift.operators.keyed import ordered_fold, running_totals, with_previous

GENESIS = "0" * 64
LOG = ["log_id"]


def record_hash(previous: Column) -> Column:
    """Hash of a record without its own hash; the fields are strings and integers, keys sorted."""
    return identity.canonical_sha(action=F.col("action"), item_id=F.col("item_id"), previous_hash=previous, sequence=F.col("sequence"))


def append_records(events: DataFrame) -> DataFrame:
    """Chain ``(log_id, idx, item_id, action)`` in order: adds ``sequence``, ``previous_hash``, ``record_hash``."""

    def step(last, idx: int, item: int, action: str):
        before = last or GENESIS
        body = {"action": action, "item_id": int(item), "previous_hash": before, "sequence": int(idx) + 1}
        mine = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        return (int(idx) + 1, before, mine), mine

    return ordered_fold(events, LOG, "idx", ["idx", "item_id", "action"], step,
                        "sequence long, previous_hash string, record_hash string")


def seal_hash() -> Column:
    """Hash of a seal without its own hash."""
    return identity.canonical_sha(exposures=F.col("exposures"), last_hash=F.col("last_hash"), log_id=F.col("log_id"), rows=F.col("rows"))


def seals(log: DataFrame) -> DataFrame:
    """(log_id, rows, last_hash, exposures, seal_sha256): what a checked log comes to. Its last hash stands for all before it."""
    spent = F.sum(F.when(F.col("action") == "exposure", 1).otherwise(0))
    return log.groupBy(*LOG).agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("record_hash", "idx").alias("last_hash"),
        spent.alias("exposures")).withColumn("seal_sha256", seal_hash())


def log_violations(log: DataFrame) -> DataFrame:
    """(log_id, idx, rule) of ``(log_id, idx, item_id, action, sequence, previous_hash, record_hash)``."""
    return _violations(log.withColumns({"__last": F.lit(GENESIS), "__exposed": F.lit(0)}), [])


def tail_violations(sealed: DataFrame, appended: DataFrame) -> DataFrame:
    """(log_id, idx, rule) of the rows appended since ``sealed``, one seal a log, without the rows that it covers.

    A log without a seal starts anew. A seal that was changed is reported at its number of rows, whether or not rows follow.
    """
    known = sealed.select("log_id", F.col("rows").alias("__rows"), F.col("last_hash").alias("__last"), F.col("exposures").alias("__exposed"))
    joined = appended.join(known, "log_id", "left").withColumns({
        "__rows": F.coalesce("__rows", F.lit(0)), "__last": F.coalesce("__last", F.lit(GENESIS)),
        "__exposed": F.coalesce("__exposed", F.lit(0))})
    gap = F.when(F.col("__before").isNull() & (F.col("idx") != F.col("__rows")), "does not follow the seal")
    stale = sealed.where(~F.col("seal_sha256").eqNullSafe(seal_hash())).select(
        "log_id", F.col("rows").alias("idx"), F.lit("seal does not verify").alias("rule"))
    return _violations(joined, [gap]).unionByName(stale)


def _violations(log: DataFrame, more: list[Column]) -> DataFrame:
    seen = with_previous(log, LOG, "idx", {"__before": "record_hash"})
    spent = running_totals(seen, LOG, "idx", {"__spent": F.when(F.col("action") == "exposure", 1).otherwise(0)})
    earlier = F.col("__spent") - F.when(F.col("action") == "exposure", 1).otherwise(0)
    rules = F.array_compact(F.array(
        F.when(F.col("sequence") != F.col("idx") + 1, "non-append-only sequence"),
        F.when(F.col("previous_hash") != F.coalesce("__before", "__last"), "previous_hash does not chain"),
        F.when(F.col("record_hash") != record_hash(F.col("previous_hash")), "record_hash does not verify"),
        F.when(~F.col("action").isin("authorized_open", "exposure"), "unknown action"),
        F.when(earlier + F.col("__exposed") > 0, "reuses a spent cohort"), *more))
    return spent.select("log_id", "idx", F.explode(rules).alias("rule"))
