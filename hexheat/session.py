"""Session settings, the shared work folder, and the one rule for broadcasting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# The pixel lookup of a continental 3 km grid is ~2M rows of two INTs and a BIGINT, ~32 MB.
# Above this estimate the hint is left off and the planner, with run-time sizes, picks a
# shuffled join.
BROADCAST_LIMIT = 64 << 20


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; `conf` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
        "spark.sql.streaming.stateStore.providerClass": STATE_PROVIDER,
        **conf,
    }
    builder = SparkSession.builder.appName("hexheat")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, or below the warehouse where that is unset.

    Every executor reaches both. `drop_work` removes all that a session has put there.
    """
    return f"{_work_root(spark)}/{name}-{uuid.uuid4().hex}"


def _work_root(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/_hexheat/{spark.sparkContext.applicationId}"


def drop_work(spark: SparkSession) -> None:
    """Remove the work folders of this session; frames read from them are gone with them."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_work_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def measured(df: DataFrame, name: str = "dimension") -> DataFrame:
    """A dimension computed once and written, so that its size is known and not estimated.

    For what is small by its nature but follows a large plan: hours, blocks, runs.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan. Joins and filters make it an over-estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only when the plan's own size estimate is under `limit`.

    Beyond it the frame is returned as it is: the join is then shuffled on its keys, and
    adaptive execution may still broadcast it or split a skewed partition by measured size.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by `keys` to all shuffle partitions: few are not gathered in big tasks because they pack well."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
