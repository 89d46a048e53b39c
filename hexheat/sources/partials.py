"""What is kept of days already folded: sums and counts for means, and counts by bin for quantiles.

A window is answered from the days that are held, and only the days that are missing are folded. A day is noted after
its partials are written, so a day whose write was cut off counts as missing and is written again whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hexheat import schemas as S
from hexheat.functions import or_null, rain_mm, valid_time, wind_speed
from hexheat.operators import fold, windowing
from hexheat.session import broadcast_checked
from hexheat.sources.landing import _exists, table_key

BINS_PER_C = 64


def days_of(first: str | date, last: str | date) -> list[date]:
    first, last = (date.fromisoformat(d) if isinstance(d, str) else d for d in (first, last))
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


def held_days(spark: SparkSession, path: str) -> set[date]:
    """The days that are written whole."""
    noted = f"{path}.days"
    if not _exists(spark, noted):
        return set()
    return {r.day for r in spark.read.parquet(noted).distinct().collect()}  # a row a day


def _note(spark: SparkSession, path: str, days: Iterable[date]) -> None:
    spark.createDataFrame([(d,) for d in days], "day date").coalesce(1).write.mode("append").parquet(f"{path}.days")


def partial_means(cube: DataFrame, pixels: DataFrame) -> DataFrame:
    """Sums and counts by (init_day, init_ts, lead_h, cell), from which means of any coarser grouping follow."""
    lookup = broadcast_checked(pixels.select("yi", "xi", "cell"))
    readings = fold.drop_missing(cube.select("init_ts", "lead_h", "yi", "xi", "tc", "rh", "rain", "u", "v"))
    return readings.join(lookup, ["yi", "xi"]).groupBy(F.to_date("init_ts").alias("init_day"), "init_ts", "lead_h", "cell").agg(
        F.count("*").alias("n"), F.sum("tc").alias("tc"), F.sum("rh").alias("rh"), F.sum("rain").alias("rain"),
        F.sum(wind_speed(F.col("u"), F.col("v"))).alias("speed"),
    )


def means_of(partials: DataFrame) -> DataFrame:
    """The fold's means, as `fold.fold` gives them."""
    total = F.sum("n")

    def mean(column: str) -> Column:
        return F.sum(column) / total

    return partials.groupBy("init_ts", "lead_h", "cell").agg(
        mean("tc").cast("float").alias("tc"), or_null(mean("rh")).cast("float").alias("rh"),
        rain_mm(mean("rain")).cast("float").alias("mm"), mean("speed").cast("float").alias("ws"),
    ).withColumn("t", valid_time(F.col("init_ts"), F.col("lead_h")))


def partials_path(base: str, key: dict) -> str:
    """Where the partials of one set of pixels live: days of another resolution or mask are never mixed in."""
    return f"{base.rstrip('/')}/{table_key(key)}"


def fold_from_partials(
    cube: DataFrame, pixels: DataFrame, path: str, first: str, last: str, leads: int = S.LEADS_PER_RUN,
) -> DataFrame:
    """The fold of a window, from the days held at `path`; missing days are folded, written and noted first.

    All leads are kept, so a later question may ask for more of them. Days without runs are noted too.
    """
    spark = cube.sparkSession
    wanted = days_of(first, last)
    known = held_days(spark, path)
    missing = [d for d in wanted if d not in known]
    if missing:
        # A stretch of days at a time, so a stored cube is pruned to the days that are read.
        for lo, hi in _stretches(missing):
            fresh = partial_means(windowing.stitch(cube, lo, hi, leads=1 << 30), pixels)
            fresh.repartitionByRange("init_day", "cell").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("init_day").parquet(path)
            _note(spark, path, days_of(lo, hi))
    held = spark.read.schema(PARTIALS).parquet(path).where(
        F.col("init_day").between(F.lit(wanted[0]), F.lit(wanted[-1])) & (F.col("lead_h") < leads)
    )
    return means_of(held)


PARTIALS = (
    "init_ts timestamp_ntz, lead_h int, cell bigint, n bigint, tc double, rh double, rain double, speed double, init_day date"
)


def _stretches(days: list[date]) -> list[tuple[date, date]]:
    """Runs of neighbouring days as (first, last)."""
    out: list[list[date]] = []
    for d in days:
        if out and d - out[-1][1] == timedelta(days=1):
            out[-1][1] = d
        else:
            out.append([d, d])
    return [tuple(x) for x in out]


# ---- quantiles ------------------------------------------------------------------------------

def write_day_counts(film: DataFrame, path: str) -> None:
    """Heat index counts by day and bin of 1/64 °C: what the ramp of any window of days is read from."""
    counts = film.where(F.col("hi").isNotNull()).groupBy(
        F.to_date("t").alias("day"), F.floor(F.col("hi").cast("double") * BINS_PER_C).cast("int").alias("bin")
    ).agg(F.count("*").alias("n"))
    counts.repartitionByRange("day", "bin").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def quantiles_of_days(spark: SparkSession, path: str, first: str, last: str, shares: list[float]) -> DataFrame:
    """(share, quantile) of a window of days, no film row read: the middle of the bin that holds the rank.

    The exact quantile lies within half a bin, 1/128 °C, of the answer where the rank is a whole number, and within
    half a bin of both neighbours' span where it lies between two values.
    """
    bins = spark.read.schema("bin int, n bigint, day date").parquet(path).where(
        F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    ).groupBy("bin").agg(F.sum("n").alias("n"))
    # Some thousand bins at most: a heat index has so many degrees.
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = bins.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(Window.partitionBy())})
    asked = walked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = F.floor(F.col("share") * (F.col("total") - 1))
    reached = asked.where(F.col("upto") > rank)
    return reached.groupBy("share").agg(((F.min("bin") + 0.5) / BINS_PER_C).alias("quantile"))


def ramp_of_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The heat index ramp of a window of days, as `film.index_ramp` but for half a bin."""
    q = quantiles_of_days(spark, path, first, last, [0.02, 0.5, 0.98])
    p2, p50, p98 = (F.max(F.when(F.col("share") == s, F.col("quantile"))) for s in (0.02, 0.5, 0.98))
    ends = q.agg(p50.alias("mid"), F.greatest(p50 - p2, p98 - p50).alias("wide"))
    return ends.select((F.col("mid") - F.col("wide")).alias("lo"), "mid", (F.col("mid") + F.col("wide")).alias("hi"))
