"""Results kept for reuse, and shards landed once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexheat.session import dealt


def table_key(parts: dict) -> str:
    """Stable name of a result from what it depends on."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def cached_table(spark: SparkSession, base: str, parts: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The result stored under its key, built and stored when it is not there.

    A marker is written after the data, and data without it is never read: a write that was cut
    off is done again.
    """
    path = f"{base.rstrip('/')}/{table_key(parts)}"
    marker = f"{path}.complete"
    if not _exists(spark, marker):
        build().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(marker)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is there, with the success file that ends a write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class FoldMemo:
    """The last answer, kept under its key; a new key lets the old answer go."""

    def __init__(self) -> None:
        self._key: str | None = None
        self._df: DataFrame | None = None

    def get(self, parts: dict, build: Callable[[], DataFrame]) -> DataFrame:
        key = table_key(parts)
        if key != self._key or self._df is None:
            self.release()
            self._key, self._df = key, build().persist()
        return self._df

    def release(self) -> None:
        if self._df is not None:
            self._df.unpersist()
        self._key = self._df = None


def split_landed(requested: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Each requested key once, marked hit or miss. One aggregate over both; a key with a NULL is never a hit."""
    asked = requested.select(*keys, F.lit(True).alias("asked"), F.lit(False).alias("hit"))
    held = landed.select(*keys, F.lit(False).alias("asked"), F.lit(True).alias("hit")).dropna(subset=keys)
    both = dealt(asked.union(held), *keys).groupBy(*keys).agg(F.max("asked").alias("asked"), F.max("hit").alias("hit"))
    return both.where("asked").select(*keys, "hit")


def to_fetch(requested: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(landed.select(*keys), keys, "left_anti")


def already_landed(requested: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(landed.select(*keys), keys, "left_semi")


def landed_table(spark: SparkSession, path: str, like: DataFrame, shard: str = "run") -> DataFrame:
    """What is landed so far; empty before the first landing. A landing of another schema is an error."""
    if not shard_numbers(spark, path, shard):
        return like.where(F.lit(False))
    return spark.read.parquet(path).select(*like.columns)


def shard_numbers(spark: SparkSession, path: str, shard: str) -> list[int]:
    """The shards that a folder has, from the names of its partitions: no file is read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{shard}="))


def land_closed(
    spark: SparkSession, source: DataFrame, path: str, shard: str = "run", cluster: tuple[str, ...] = ("yi", "xi"),
    newest: int | None = None,
) -> None:
    """Write the closed shards that are not landed yet, a few files a shard.

    Range partitioning on shard and pixel splits a big shard and gathers small ones.

    The newest shard may still grow, so it never lands. Its number is best given, from the list of runs or from
    `shard_numbers`; without it the source is searched for it. What has landed is known from the names of folders.
    Partitions are replaced whole: a run that was cut off and started again leaves no duplicates.
    """
    last = F.lit(newest) if newest is not None else source.agg(F.max(shard)).scalar()
    held = shard_numbers(spark, path, shard)
    closed = source.where((F.col(shard) < last) & ~F.col(shard).isin(held))
    (
        closed.repartitionByRange(shard, *cluster)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
    )


def mirrored(spark: SparkSession, source: DataFrame, path: str, shard: str = "run") -> DataFrame:
    """The source as a reader sees it: closed shards from the landing, the rest read again."""
    landed = landed_table(spark, path, source, shard)
    rest = to_fetch(source, landed.select(shard).distinct(), [shard])
    return landed.withColumn("from_landing", F.lit(True)).unionByName(
        rest.withColumn("from_landing", F.lit(False))
    )
