"""Order-dependent building blocks that do not put a whole key into one task.

A key (a source, a run, a user) may hold a large share of all rows, so nothing here
sorts or buffers a key as one group. Rows are cut into blocks by a dense position or by
a coarse order bucket, work runs per block, and only one small row per block is carried
across blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timesift.session import cut_lineage

BLOCK_ROWS = 65_536


def _block(idx: str, block_rows: int) -> Column:
    return F.floor(F.col(idx) / F.lit(block_rows))


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], coarse: Column | None,
              name: str = "idx") -> DataFrame:
    """Dense position from 0 of each row within ``keys``.

    ``coarse`` is a bucket that never decreases along ``order`` (an hour, an id range).
    Rows are ranked per bucket; bucket counts give the offset. ``None`` is for keys cut out
    of one input record.
    """
    if coarse is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    tagged = df.withColumn("__bucket", coarse)
    by_key = Window.partitionBy(*keys).orderBy("__bucket")
    offsets = (
        tagged.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(
            F.sum("__n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return (
        tagged.join(offsets, [*keys, "__bucket"])
        .withColumn(name, (F.col("__offset") + F.row_number().over(within) - 1).cast("long"))
        .drop("__bucket", "__offset")
    )


def with_previous(df: DataFrame, keys: Sequence[str], idx: str, columns: dict[str, str],
                  block_rows: int | None = BLOCK_ROWS, ahead: bool = False) -> DataFrame:
    """``lag`` (or ``lead``) over a dense index, one block at a time.

    The row at a block edge is also sent to the neighbouring block, used there and dropped.
    ``block_rows=None`` is for keys cut out of one input record: a plain window.
    """
    shift = F.lead if ahead else F.lag
    if block_rows is None:
        window = Window.partitionBy(*keys).orderBy(idx)
        return df.withColumns({new: shift(old).over(window) for new, old in columns.items()})
    block = _block(idx, block_rows)
    if ahead:
        edge, other = F.col(idx) % block_rows == 0, block - 1
    else:
        edge, other = F.col(idx) % block_rows == block_rows - 1, block + 1
    spread = df.withColumn("__block", F.explode(
        F.when(edge, F.array(block, other)).otherwise(F.array(block))))
    window = Window.partitionBy(*keys, "__block").orderBy(idx)
    for new, old in columns.items():
        spread = spread.withColumn(new, shift(old).over(window))
    return spread.where(F.col("__block") == block).drop("__block")


def running_totals(df: DataFrame, keys: Sequence[str], idx: str, totals: dict[str, Column],
                   how: Callable[[Column], Column] = F.sum,
                   block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Running sum (or max) up to and including each row, in dense-index order.

    ``block_rows=None`` is for keys cut out of one input record: a plain window.
    """
    if block_rows is None:
        window = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: how(expr).over(window) for name, expr in totals.items()})
    staged = df.withColumn("__block", _block(idx, block_rows))
    for name, expr in totals.items():
        staged = staged.withColumn(f"__v_{name}", expr)
    by_key = Window.partitionBy(*keys).orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = staged.groupBy(*keys, "__block").agg(
        *[how(F.col(f"__v_{n}")).alias(f"__t_{n}") for n in totals])
    for name in totals:
        carried = carried.withColumn(f"__c_{name}", how(F.col(f"__t_{name}")).over(by_key))
    carried = carried.select(*keys, "__block", *[f"__c_{n}" for n in totals])
    inside = Window.partitionBy(*keys, "__block").orderBy(idx).rowsBetween(
        Window.unboundedPreceding, 0)
    out = staged.join(carried, [*keys, "__block"])
    for name in totals:
        own = how(F.col(f"__v_{name}")).over(inside)
        carry = F.col(f"__c_{name}")
        merged = (own + F.coalesce(carry, F.lit(0)) if how is F.sum
                  else F.greatest(own, carry))
        out = out.withColumn(name, merged)
    return out.drop("__block", *[f"__v_{n}" for n in totals], *[f"__c_{n}" for n in totals])


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     wanted: dict[str, float | str], width: float = 1.0) -> DataFrame:
    """Exact order statistics per key: a nearest-rank share such as 0.95, or ``"median"``.

    Counts per value bucket locate the bucket that holds each wanted rank; only the rows of
    those buckets are ranked. No key is sorted as a whole. Adds ``n`` (rows per key).
    Equal values are counted once and written, so ``df`` is evaluated once; the buckets that are hit are
    written too, so that their known size decides how they meet the values.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    rows = cut_lineage(rows.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__m"))).withColumn(
        "__bucket", F.floor(F.col("__v") / width))
    by_key = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, 0)
    hist = (
        rows.groupBy(*keys, "__bucket").agg(F.sum("__m").alias("__n"))
        .withColumn("__upto", F.sum("__n").over(by_key))
        .withColumn("n", F.sum("__n").over(Window.partitionBy(*keys)))
    )
    n = F.col("n")
    ranks = []
    for name, share in wanted.items():
        if share == "median":
            ranks += [(f"{name}.lo", F.floor((n + 1) / 2)), (f"{name}.hi", F.floor(n / 2) + 1)]
        else:
            ranks.append((name, F.greatest(F.lit(1), F.ceil(F.lit(float(share)) * n))))
    hits = cut_lineage(
        hist.withColumn("__r", F.explode(F.array(*[
            F.struct(F.lit(name).alias("name"), rank.cast("long").alias("k"))
            for name, rank in ranks])))
        .where((F.col("__r.k") <= F.col("__upto")) & (F.col("__r.k") > F.col("__upto") - F.col("__n")))
        .select(*keys, "n", "__bucket", F.col("__r.name").alias("__name"),
                (F.col("__r.k") - F.col("__upto") + F.col("__n")).alias("__k"))
    )
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, 0)
    ranked = (
        rows.join(hits.select(*keys, "__bucket").distinct(), [*keys, "__bucket"], "left_semi")
        .withColumn("__cum", F.sum("__m").over(inside))
    )
    picked = ranked.join(hits, [*keys, "__bucket"]).where(
        (F.col("__k") <= F.col("__cum")) & (F.col("__k") > F.col("__cum") - F.col("__m")))

    def one(label: str) -> Column:
        return F.max(F.when(F.col("__name") == label, F.col("__v")))

    return picked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[((one(f"{name}.lo") + one(f"{name}.hi")) / 2 if share == "median" else one(name)).alias(name)
          for name, share in wanted.items()])


# step(state, *used values) -> (added values, or None to drop the row; state for the next row)
Step = Callable[..., tuple[tuple | None, object]]


def ordered_fold(df: DataFrame, keys: Sequence[str], idx: str, uses: Sequence[str], step: Step,
                 adds: str = "", *, block_rows: int | None = None,
                 one_record_per_key: bool = False) -> DataFrame:
    """Left-to-right pass per key where each row's fate depends on what was kept before.

    ``step`` sees the ``uses`` columns of one row and a small JSON-like state, ``None`` at the
    start of a key. Rows stream through each task in ``idx`` order, so a task holds one batch.
    ``idx`` must be dense from 0: a key spans several blocks exactly when it has a row at
    position ``block_rows``.

    Blocks of such keys run in parallel on the state their left neighbour last produced; the
    blocks whose incoming state changed run again until none does. Greedy passes forget their
    past quickly, so two or three rounds are usual; the result is exact in any case.

    ``one_record_per_key`` is for keys cut out of one input record (the lines of a document),
    which one task has already held.
    """
    keys, uses, block_rows = list(keys), list(uses), block_rows or BLOCK_ROWS
    if not one_record_per_key:
        df = cut_lineage(df)
        if not df.where(F.col(idx) == block_rows).isEmpty():
            blocked = df.withColumn("__block", _block(idx, block_rows))
            entries = _settle_blocks(blocked, keys, idx, uses, step, block_rows)
            group = [*keys, "__block"]
            return _stream(blocked.join(entries, group, "left"), group, idx, uses, step, adds, "__in").drop(
                "__block", "__in")
    return _stream(df, keys, idx, uses, step, adds, None)


def _stream(df: DataFrame, group: list[str], idx: str, uses: list[str], step: Step, adds: str,
            entry: str | None) -> DataFrame:
    """Run ``step`` over the rows of each group; groups never share a state."""
    added = T._parse_datatype_string(adds).fields if adds else []
    schema = T.StructType([*df.schema.fields, *added])
    names = [f.name for f in added]

    def run(batches):
        current, state = None, None
        for batch in batches:
            ids = list(zip(*[batch[k] for k in group]))
            entries = list(batch[entry]) if entry else None
            keep, made = [], []
            for at, values in enumerate(zip(*[batch[c] for c in uses])):
                if ids[at] != current:
                    current = ids[at]
                    state = json.loads(entries[at]) if entries and entries[at] else None
                out, state = step(state, *values)
                keep.append(out is not None)
                if out is not None:
                    made.append(out)
            kept = batch[keep]
            if names:
                columns = list(zip(*made)) if made else [[] for _ in names]
                kept = kept.assign(**{n: pd.Series(list(c), index=kept.index, dtype=object)
                                      for n, c in zip(names, columns)})
            yield kept

    return df.repartition(*group).sortWithinPartitions(*group, idx).mapInPandas(run, schema)


def _settle_blocks(blocked: DataFrame, keys: list[str], idx: str, uses: list[str], step: Step,
                   block_rows: int) -> DataFrame:
    """The incoming state of every block of the long keys, as (keys, __block, __in)."""
    group = [*keys, "__block"]
    schema = T.StructType(
        [f for f in blocked.schema.fields if f.name in group]
        + [T.StructField("__in", T.StringType()), T.StructField("__out", T.StringType())])
    group = [f.name for f in schema.fields][:-2]
    long_keys = blocked.where(F.col(idx) == block_rows).select(*keys)
    rows = blocked.select(*dict.fromkeys([*group, idx, *uses])).join(long_keys, keys, "left_semi")

    def close(batches):
        current, given, state = None, None, None
        for batch in batches:
            ended = []
            ids = zip(*[batch[k] for k in group])
            for who, entry, values in zip(ids, batch["__in"], zip(*[batch[c] for c in uses])):
                if who != current:
                    if current is not None:
                        ended.append((*current, given, json.dumps(state, sort_keys=True)))
                    current, given = who, entry or "null"
                    state = json.loads(given)
                _, state = step(state, *values)
            yield pd.DataFrame(ended, columns=schema.names)
        if current is not None:
            yield pd.DataFrame([(*current, given, json.dumps(state, sort_keys=True))], columns=schema.names)

    def closed(part: DataFrame) -> DataFrame:
        return cut_lineage(part.repartition(*group).sortWithinPartitions(*group, idx).mapInPandas(close, schema))

    states = closed(rows.withColumn("__in", F.lit(None).cast("string")))
    while True:
        offered = states.select(*keys, (F.col("__block") + 1).alias("__block"), F.col("__out").alias("__offer"))
        stale = cut_lineage(states.join(offered, group).where("__in <> __offer").select(
            *group, F.col("__offer").alias("__in")))
        if stale.isEmpty():
            return states.select(*group, "__in")
        states = cut_lineage(states.join(stale, group, "left_anti").unionByName(closed(rows.join(stale, group))))
