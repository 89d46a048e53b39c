"""Scans of the gridded archive and of division pieces."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from hexheat import schemas as S
from hexheat.functions import path_tail

KEYS = ("run", "init_ts", "lead_h", "yi", "xi")


def scan_cube(spark: SparkSession, path: str, variables: Iterable[str] = S.CUBE_VARIABLES) -> DataFrame:
    """The archive as one long table, with only the wanted variables read from the files."""
    return spark.read.schema(S.CUBE).parquet(path).select(*KEYS, *variables, *S.CUBE_PARTITIONS)


def write_cube(cube: DataFrame, path: str, mode: str = "append") -> None:
    """Store a cube so that a scan prunes days and pixel blocks.

    The range partitioning splits a crowded (day, block) over several files by pixel and run. The
    runs that were written are noted beside the cube, after it, from the days that were written.
    Where blocks have no folders, files and row groups hold near blocks of a day.
    """
    folders = cube_folders(cube, path)
    watch = Observation()
    cube = cube.withColumn("init_day", F.to_date("init_ts")).observe(watch, F.collect_set("init_day").alias("days"))
    (
        cube
        .repartitionByRange("init_day", "yb", "xb", "yi", "xi", "init_ts")
        .sortWithinPartitions(*S.CUBE_PARTITIONS, "yi", "xi", "init_ts", "lead_h")
        .write.mode(mode).option("parquet.block.row.count.limit", S.ROW_GROUP_ROWS).partitionBy(*folders).parquet(path)
    )
    days = watch.get["days"] or []  # a value a day
    written = scan_cube(cube.sparkSession, path, ()).where(F.col("init_day").isin(list(days)))
    written.select(*RUNS).distinct().coalesce(1).write.mode(mode).parquet(runs_path(path))


def cube_folders(cube: DataFrame, path: str) -> tuple[str, ...]:
    """The columns that a stored cube has folders for. A new one has them by day, and by block while it has few blocks."""
    days = sorted(n for n in _names(cube.sparkSession, path) if n.startswith("init_day="))
    if days:
        by_block = any(n.startswith("yb=") for n in _names(cube.sparkSession, f"{path}/{days[0]}"))
    else:
        by_block = cube.select("yb", "xb").distinct().limit(S.MOST_BLOCK_FOLDERS + 1).count() <= S.MOST_BLOCK_FOLDERS
    return S.CUBE_PARTITIONS if by_block else S.CUBE_PARTITIONS[:1]


def _names(spark: SparkSession, path: str) -> list[str]:
    """What a folder lists; nothing where there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


RUNS = ("run", "init_ts", "init_day")


def runs_path(path: str) -> str:
    return f"{path.rstrip('/')}.runs"


def stored_days(spark: SparkSession, path: str) -> set[date]:
    """The days that a stored cube has folders for, from one listing of its top folder."""
    return {date.fromisoformat(n.partition("=")[2]) for n in _names(spark, path) if n.startswith("init_day=")}


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """The init list of a stored cube, from the table kept beside it and not from the cube.

    Days that have folders but are not in that table, as after a write that was cut off, are read
    from the cube, and only those.
    """
    noted = spark.read.schema(S.RUN_NOTES).parquet(runs_path(path)).distinct()
    known = {r.init_day for r in noted.select("init_day").distinct().collect()}  # a row a day
    missed = sorted(stored_days(spark, path) - known)
    if missed:
        cube = scan_cube(spark, path, ()).where(F.col("init_day").isin(missed))
        noted = noted.unionByName(cube.select(*RUNS).distinct())
    return noted.select("run", "init_ts")


def scan_grid(spark: SparkSession, path: str) -> DataFrame:
    """Pixel coordinates."""
    return spark.read.schema(S.GRID).parquet(path)


def scan_runs(cube: DataFrame) -> DataFrame:
    """The init list of a cube that is not stored; `stored_runs` is the way for one that is."""
    return cube.select("run", "init_ts").distinct()


def run_extent(runs: DataFrame) -> DataFrame:
    """First and last day, and the newest init, of an init list."""
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.to_date(F.min("init_ts")).alias("first_day"),
        F.to_date(F.max("init_ts")).alias("last_day"),
        F.max("init_ts").alias("newest"),
    )


def last_days(runs: DataFrame, days: int) -> DataFrame:
    """Runs of the last `days` UTC days of the archive."""
    extent = run_extent(runs).select("last_day")
    near = extent.select(F.explode(F.sequence(F.date_sub("last_day", days - 1), F.col("last_day"))).alias("day"))
    return runs.withColumn("day", F.to_date("init_ts")).join(F.broadcast(near), "day", "left_semi").drop("day")


def register_table(df: DataFrame, name: str) -> DataFrame:
    """Give a frame a name for SQL."""
    df.createOrReplaceTempView(name)
    return df


def scan_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Division pieces with typed properties and nested rings."""
    return spark.read.schema(S.PIECES).parquet(path)


def properties(keys: Column, values: Column, tags: Column) -> Column:
    """Feature properties as a MAP, from key and value tables and alternating tag indexes."""
    pairs = F.sequence(F.lit(0), F.floor(F.size(tags) / 2).cast("int") - 1)

    def picked(table: Column, shift: int) -> Column:
        return F.transform(pairs, lambda i: F.get(table, F.get(tags, i * 2 + shift)))

    some = F.map_from_arrays(picked(keys, 0), picked(values, 1))
    return F.when(F.size(tags) >= 2, some)


def latest_release(listing: DataFrame, pin: str | None = None, fallback: str = S.FALLBACK_RELEASE) -> DataFrame:
    """Greatest release name among listed prefixes, unless pinned; the fallback for no listing."""
    found = F.coalesce(F.max(path_tail(F.col("prefix"))), F.lit(fallback))
    return listing.agg((F.lit(pin) if pin else found).alias("release"))
