"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "timesift") -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster, leave ``master`` and ``shuffle_partitions`` unset: the submit
    command and AQE decide. Tests pass both.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    Only a session on one machine may go without a named one (tests): on a cluster, executors
    would write into folders of their own, and what is read back would be incomplete.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="spark-timesift-")
    return _LOCAL_DIRS[context.applicationId]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The table survives the loss of executors, keeps column pruning and filter pushdown, and
    its size is known to the planner. ``clear_tables`` deletes the tables of an application.
    """
    spark = df.sparkSession
    path = f"{_tables_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str = "source_id") -> DataFrame:
    """Deal rows by ``key`` into as many parts as the session shuffles into, also where rows are few.

    Small parts leave room for what a step makes of a source; steps grouped by keys that hold ``key`` shuffle no more.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/timesift/{spark.sparkContext.applicationId}"


def clear_tables(spark: SparkSession) -> None:
    """Delete what ``cut_lineage`` wrote in this application; call it when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
