"""Incremental jobs: ingest once, pause sessions, running a stream to the end of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timesift.session import shared_dir

END = "2262-01-01 00:00:00"  # near the last instant that pandas can hold


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything that is there now and return the sink as a table.

    Rows that a watermark dropped as late are lost results, so they are an error here.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/timesift/stream-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint")
    query = writer.trigger(availableNow=True).format("parquet").start(f"{base}/rows")
    query.awaitTermination()
    lost = late_rows(query)
    if lost:
        raise ValueError(f"stream {name}: {lost} rows came after the watermark had passed them; "
                         "take the input in one trigger, in time order, or with a longer delay")
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def with_end(stream: DataFrame, ts: str) -> DataFrame:
    """``stream`` with one end mark: a row of nulls at ``END``, so that all rows before it are released.

    The mark moves the watermark past every row of a finished input. It lies in the group of null keys, is
    itself never released, and comes in the same trigger as the rows, before which nothing is late.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/timesift/end-{uuid.uuid4().hex}"
    spark.range(1).select(*[
        (F.lit(END).cast("timestamp") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in stream.schema.fields]).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def late_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for step in query.recentProgress for op in step["stateOperators"])


def ingest_once(stream: DataFrame, key: str, table_path: str, checkpoint: str, parts: int = 64) -> DataFrame:
    """Append each key once to ``table_path``, however often and however late it arrives.

    Each batch keeps the first of its own repeats and drops, by an anti join, what earlier batches landed.
    The table is parted by a hash of the key: the join reads two columns of the parts the batch touches.
    A batch owns one folder of the table and replaces it when it is retried.
    """
    spark = stream.sparkSession
    schema = stream.schema.add("batch_id", "long").add("part", "integer")

    def land(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        if batch_id > 0:
            known = session.read.schema(schema).option("recursiveFileLookup", "false").parquet(table_path).where(
                F.col("batch_id") < batch_id).select("part", key)
            fresh = fresh.join(known, ["part", key], "left_anti")
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{table_path}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(table_path)


def pause_sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, delay: str) -> DataFrame:
    """(keys, start, end, items) of stretches without a pause longer than ``gap``; late rows past
    ``delay`` are dropped and counted in the query progress."""
    return stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap)).agg(
        F.count(F.lit(1)).alias("items")).select(
        *keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "items")


def fixed_blocks(stream: DataFrame, keys: list[str], ts: str, delay: str, width: str = "120 seconds") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, width)).agg(F.count(F.lit(1)).alias("items")).select(
        *keys, F.col("window.start").alias("start"), "items")


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its files: all of them in one trigger, or a few at a time for files in time order.

    Files in any other order must come in one trigger, or the watermark of one drops rows of the next.
    ``path`` may be a folder or a single file: the file source takes a single file only through a
    pattern, so the last letter becomes one.
    """
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(pattern)


def event_time(ts: str) -> Column:
    """A wall-clock column as an instant, read as UTC whatever the session time zone is."""
    return F.timestamp_micros(F.expr(
        f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))"))
