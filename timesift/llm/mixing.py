"""Mixing sources to target weights by weighted sampling without replacement (exponential keys)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timesift.llm.common import bucket_count, cut_lineage, running_sum, uniform

WEIGHTS = (5, 2, 1)
CAP = 3
LEAST_WEIGHT = 0.05
FILLER = "#$%&*|!"
# Shares of a source's keys at which ``mix_plan`` takes bounds: even ones, and finer ones where the keys thin out.
SHARES = [i / 64 for i in range(64)] + [1 - 2.0 ** -k / 64 for k in range(1, 8)] + [1.0]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks and the controls 09 to 0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` of ``sources(source, source_size)``, any number of sources.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a
    target stops at ``cap`` times its source's size, and the excess is shared again by weight until no
    target is above. Positions come from range partitions and their counts, and each sharing is one
    aggregate, so no task holds all sources.
    """
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    n = ranged.count()
    placed = running_sum(ranged.withColumn("one", F.lit(1)), ["one"], F.col("part"), [F.col("source").asc_nulls_last()],
                         {"position": F.lit(1).cast("long")})
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = cut_lineage(placed.select(
        "source", "source_size", F.get(turn, F.pmod("position", F.lit(len(weights))).cast("int")).alias("weight"),
        (F.lit(float(cap)) * F.col("source_size")).alias("most")), n)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.lit(level) * F.col("weight")
        held, open_, n = weighed.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.sum(F.when(full, 1).otherwise(0))).first()
        if not open_:
            return weighed.select("source", "source_size", F.col("most").alias("target"))
        following = (total - held) / open_
        if level is not None and n == before:
            break
        level, before = following, n
    return weighed.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def text_weight(text: Column) -> Column:
    """A quality weight from the text alone: the share of characters that are no filler symbols; null for no text."""
    return F.length(F.translate(text, FILLER, "")) / F.nullif(F.length(text), F.lit(0))


def keyed_sizes(docs: DataFrame, weight: Column, seed: int) -> DataFrame:
    """``docs`` with ``size`` and the exponential key ``mix_key`` = -ln(u) / weight.

    u comes from the md5 of the seed, doc_id and text, so that reruns agree.
    """
    w = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(1.0), F.coalesce(weight, F.lit(LEAST_WEIGHT))))
    u = uniform(seed, F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("mix_key", -F.log(u) / w)


def key_bucket(key: Column, bounds: Column, n: int) -> Column:
    """One of ``n`` buckets that never decreases with the key and holds about as many keys as any other.

    ``bounds`` are the keys at ``SHARES`` of a source; between two of them the share grows evenly. Bounds
    need not be exact: they change the sizes of the buckets, never the order.
    """
    under = F.size(F.filter(bounds, lambda b: b <= key))
    at = F.least(F.greatest(under - 1, F.lit(0)), F.lit(len(SHARES) - 2))
    shares = F.array(*[F.lit(s) for s in SHARES])
    low, high = F.get(bounds, at), F.get(bounds, at + 1)
    inside = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (key - low) / F.nullif(high - low, F.lit(0.0)))), F.lit(1.0))
    share = F.get(shares, at) + (F.get(shares, at + 1) - F.get(shares, at)) * inside
    return F.least(F.lit(n - 1), F.floor(share * F.lit(n)))


def mix_plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source ``source, source_size, target, epochs, last, part``, from ``rows(doc_id, source, size, mix_key)``.

    A target of several times its source takes whole ``epochs`` first. The rest is filled in rising key
    order: a document is taken when the middle of its words lies before the end of the budget, which
    leaves a source within half a document of its target. ``last`` is the (key, doc_id, size) of the
    last document taken, ``part`` how many of the rows equal to it are taken, null for all. Equal rows are
    counted first and keys summed in buckets within a source, so one source or row may hold any share of all rows.
    """
    n_rows = rows.count()
    n = bucket_count(n_rows)
    bounds = F.percentile_approx(F.when(F.col("size") > 0, F.col("mix_key")), SHARES, 10_000)
    sources = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size"), bounds.alias("bounds")), n_rows)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = cut_lineage(source_targets(sources.drop("bounds"), weights, cap).withColumn("epochs", epochs), n_rows)
    order = ["mix_key", "doc_id", "size"]
    counted = rows.filter("size > 0").groupBy("source", *order).agg(F.count(F.lit(1)).alias("n"))
    placed = with_source(counted, sources.select("source", "bounds")).withColumn(
        "bucket", key_bucket(F.col("mix_key"), F.col("bounds"), n)).drop("bounds")
    summed = running_sum(with_source(placed, targets), ["source"], F.col("bucket"), [F.col(c) for c in order], {"before": F.col("size") * F.col("n")})
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    taken = summed.filter(F.lit(2.0) * F.col("before") + F.col("size") < F.lit(2.0) * rest)
    fit = F.ceil((F.lit(2.0) * rest - F.col("size") - F.lit(2.0) * F.col("before")) / (F.lit(2.0) * F.col("size")))
    last = taken.groupBy("source").agg(F.max(F.struct(*order, F.when(fit < F.col("n"), fit).cast("long").alias("part"))).alias("l"))
    last = last.select(F.col("source").alias("s"), F.struct(*[F.col(f"l.{c}").alias(c) for c in order]).alias("last"), F.col("l.part").alias("part"))
    both = targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return cut_lineage(both, n_rows)


def settle(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with ``until``: the highest ``rid`` taken of the rows equal to ``last``, where only a part of them is.

    ``rows(rid, doc_id, source, size, mix_key)`` are a written table, whose numbers rise by partition.
    """
    mine = F.struct("mix_key", "doc_id", "size")
    edge = with_source(rows, plan.filter("part IS NOT NULL")).filter(mine.eqNullSafe(F.col("last"))).select("source", "rid", "part")
    placed = running_sum(edge, ["source"], F.shiftright("rid", 33), [F.col("rid")], {"before": F.lit(1).cast("long")})
    until = placed.filter("before < part").groupBy(F.col("source").alias("s")).agg(F.max("rid").alias("until"))
    return cut_lineage(plan.join(until, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join by source, null to null. ``plan`` is a written table: broadcast when its size allows, else Spark splits hot sources."""
    return rows.join(plan.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def copies() -> Column:
    """How often a row of ``keyed_sizes`` with its ``rid``, joined with its settled plan, is taken."""
    mine = F.struct("mix_key", "doc_id", "size")
    there = (mine < F.col("last")) | (mine.eqNullSafe(F.col("last")) & (F.col("part").isNull() | (F.col("rid") <= F.col("until"))))
    return F.col("epochs") + F.when((F.col("size") > 0) & F.coalesce(there, F.lit(False)), 1).otherwise(0)


def mix(docs: DataFrame, seed: int = 17, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of each row of ``docs(doc_id, text, source)``.

    Null texts have size 0 and are taken only in whole epochs; a null source is a source of its own, last
    in order; repeated rows are sampled each; an empty table returns none. Only the named columns
    are read. Sources may be any number and one may hold any share of the rows.
    """
    rows = cut_lineage(keyed_sizes(docs.select("doc_id", "text", "source"), text_weight(F.col("text")), seed)
                       .select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", "size", "mix_key"))
    return with_source(rows, settle(rows, mix_plan(rows, weights, cap))).select(
        "doc_id", "size", "source_size", "target", copies().cast("long").alias("copies"),
        (copies() * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken. Texts stay where they lie; they are
    written once, numbered, only where a source's budget ends between equal rows.

    Columns of ``docs`` stay as they are, whatever their names; the rules are those of ``mix``.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    narrow = docs.select("doc_id", "text", "source", kept)
    keyed = keyed_sizes(narrow, text_weight(F.col("text")), seed)
    rows = cut_lineage(keyed.select("doc_id", "source", "size", "mix_key"))
    plan = mix_plan(rows, weights, cap)
    if plan.filter("part IS NOT NULL").isEmpty():
        keyed, plan = keyed.withColumn("rid", F.lit(0)), plan.withColumn("until", F.lit(0))
    else:
        keyed = cut_lineage(keyed.drop("text").withColumn("rid", F.monotonically_increasing_id()))
        plan = settle(keyed.select("rid", "doc_id", "source", "size", "mix_key"), plan)
    joined = with_source(keyed, plan)
    repeated = F.explode(F.array_repeat(F.lit(1), copies().cast("int")))
    return joined.select("kept", repeated.alias("n")).select("kept.*")
