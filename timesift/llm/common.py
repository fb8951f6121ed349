"""Helpers of the corpus operators: bucketed running sums, document keys, empty tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timesift import session

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


ROWS_PER_FILE = 250_000


def cut_lineage(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``rows``, a bound on its rows, keeps small tables in few files."""
    if rows is not None:
        df = df.coalesce(max(8, rows // ROWS_PER_FILE + 1))
    return session.cut_lineage(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the seed and the parts: the same in every run and engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    head = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (head + F.lit(0.5)) / F.lit(float(16 ** 13))


def bucket_count(rows: int, per_bucket: int = 20_000) -> int:
    """Buckets for ``running_sum``, so that a bucket's rows fit one task; the result does not depend on it."""
    return max(16, math.ceil(rows / per_bucket))


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column],
                values: dict[str, Column]) -> DataFrame:
    """Sums over the rows before each row of its key, without one task for a whole key.

    ``bucket`` never decreases along ``order``. Rows are summed within (key, bucket); the sums of
    earlier buckets, one row each, are added. Equal rows may take each other's place.
    """
    tagged = df.withColumn("__bucket", bucket)
    for i, v in enumerate(values.values()):
        tagged = tagged.withColumn(f"__v{i}", v)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    by = [*keys, "__bucket"]
    offsets = tagged.groupBy(*by).agg(*[F.sum(f"__v{i}").alias(f"__s{i}") for i in range(len(values))])
    offsets = offsets.select(*by, *[F.coalesce(F.sum(f"__s{i}").over(before), F.lit(0)).alias(f"__o{i}")
                                    for i in range(len(values))])
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = tagged
    for i in range(len(values)):
        summed = summed.withColumn(f"__w{i}", F.coalesce(F.sum(f"__v{i}").over(within), F.lit(0)))
    joined = summed.join(offsets, by) if not _may_be_null(df, keys) else summed.join(
        offsets.withColumnsRenamed({k: f"__k_{k}" for k in by}),
        [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in by]).drop(*[f"__k_{k}" for k in by])
    for i, name in enumerate(values):
        joined = joined.withColumn(name, F.col(f"__w{i}") + F.col(f"__o{i}"))
    return joined.drop("__bucket", *[f"__{c}{i}" for c in "vwo" for i in range(len(values))])


def _may_be_null(df: DataFrame, keys: Sequence[str]) -> bool:
    return any(df.schema[k].nullable for k in keys)

