"""Sinks: nested manifests, printed reports, verified restore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timesift.operators.quality import inventory_violations


def write_manifests(manifests: DataFrame, path: str, buckets: int = 256) -> None:
    """One JSON document per (question, source), spread over source buckets."""
    manifests.withColumn("bucket", F.pmod(F.xxhash64("source_id"), F.lit(buckets))).write.mode("errorifexists").partitionBy("bucket").json(path)


def write_reports(lines: DataFrame, path: str) -> None:
    """Report lines in reading order, each report contiguous, split over as many files as needed."""
    order = ["question_id", "source_id", "section", "ord", "sub"]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("line").write.mode("errorifexists").text(path)


def portable_frames(evidence: DataFrame, include_media: bool) -> DataFrame:
    """Frame paths relative to the bundle; without media each reference says so."""
    name = F.concat(F.lit("frames/"), F.regexp_extract("frame", r"([^/\\]+)$", 1))
    return evidence.withColumn("frame", F.when(F.col("frame").isNotNull(), name)).withColumn(
        "portable_media_omitted", F.col("frame").isNotNull() & F.lit(not include_media))


def restore(declared: DataFrame, contents: DataFrame, path: str) -> None:
    """Write ``(path, content)`` only when every declared file verifies and nothing is undeclared."""
    from timesift.sources.readers import inventory

    broken = inventory_violations(declared, inventory(contents))
    if not broken.isEmpty():
        raise ValueError("restore refused: contents do not match their manifest")
    contents.write.mode("errorifexists").parquet(path)
