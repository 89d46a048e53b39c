"""Small helpers the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or one below the warehouse where that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    return given or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again, so a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """`df` written with a number in each row, and the name of that column: rows of one doc_id can be told apart."""
    row = free_name(df, "row")
    return stored(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row
