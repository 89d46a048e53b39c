"""Film files, the config row, and stage statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, functions as F

from hexheat import schemas as S
from hexheat.functions import hour_label
from hexheat.operators.film import densify, frames, index_film, no_data_codes
from hexheat.sources.archive import run_extent


def write_film(film: DataFrame, path: str) -> None:
    """Frame-major film, a folder per UTC day, rows in (hour, cell) order.

    Range partitioning on (t, cell) splits every hour evenly, however many cells it has. The whole
    film is replaced, whatever the session says of partitions: no day of an older window stays.
    """
    (
        film.withColumn("day", F.to_date("t"))
        .repartitionByRange("day", "t", "cell").sortWithinPartitions("day", "t", "cell")
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(path)
    )


def write_dense_film(film: DataFrame, cells: DataFrame, path: str, t0: datetime, t1: datetime) -> None:
    """Every (frame, cell) with the no-data code, cells by position, for a binary reader."""
    dense = index_film(densify(film, cells, t0, t1), frames(film), cells)
    (
        no_data_codes(dense).select("frame", "pos", "hi_q", "wx_q")
        .repartitionByRange("frame", "pos").sortWithinPartitions("frame", "pos")
        .write.mode("overwrite").parquet(path)
    )


RANGE = 1 << 16


def packed_frames(dense: DataFrame, codes: tuple[str, ...] = ("hi_q", "wx_q"), width: int = RANGE) -> DataFrame:
    """One row an hour: `frame`, the number of cells, and for each code a BINARY value of a byte a cell, by position.

    `dense` has a row for every (frame, pos), as `write_dense_film` writes it. Bytes are made for ranges of `width`
    positions, each in its own group, and the ranges of a frame, some few values, are then joined in order.
    """
    ranged = dense.groupBy("frame", F.floor(F.col("pos") / width).alias("range")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *codes))).alias("cells")
    )

    def octets(code: str) -> Column:
        return F.array_join(F.transform("cells", lambda c: F.lpad(F.hex(c[code].cast("bigint")), 2, "0")), "")

    parts = ranged.select("frame", "range", "n", *[octets(c).alias(c) for c in codes])
    whole = parts.groupBy("frame").agg(
        F.sum("n").alias("n_cells"), F.array_sort(F.collect_list(F.struct("range", *codes))).alias("parts")
    )
    return whole.select("frame", "n_cells", *[F.unhex(F.array_join(F.col(f"parts.{c}"), "")).alias(c) for c in codes])


def window_block(costed: DataFrame, runs: DataFrame, leads: int = S.LEADS_PER_RUN) -> DataFrame:
    """One row for the config from one resolved and costed request: archive ends, window, limit, and the cost to read it."""
    ends = run_extent(runs).select("first_day", "last_day")
    first, last = (ends.select(c).scalar() for c in ("first_day", "last_day"))
    return costed.withColumns({"first_day": first, "last_day": last}).select(F.struct(
        *[F.date_format(d, "yyyy-MM-dd").alias(d) for d in ("first_day", "last_day", "d0", "d1")],
        F.lit(S.MAX_WINDOW_DAYS).alias("max_days"), "cost", "sec_per_day", F.lit(leads).alias("leads"),
    ).alias("window"))


def film_config(film: DataFrame, ramp: DataFrame, settings: dict, window: DataFrame | None = None) -> DataFrame:
    """One JSON row: hour labels in order, ramp ends, parameters, and the window block if there is one.

    A label per hour of the window is collected, some hundreds, and never a row per cell.
    """
    hours = film.select("t").distinct()
    labels = hours.agg(F.sort_array(F.collect_list(hour_label(F.col("t")))).alias("labels"))
    row = ramp.select(F.struct("lo", "mid", "hi")).scalar()
    ends = [row[end].alias(end) for end in ("lo", "mid", "hi")]
    fixed = {
        "index_stops": list(S.INDEX_STOPS), "load_stops": list(S.LOAD_STOPS),
        "threshold": S.THRESHOLD_C, "half_life": S.HALF_LIFE_H,
        "rain_flush": S.RAIN_FLUSH, "wind_vent": S.WIND_VENT, **settings,
    }
    block = []
    if window is not None:
        block = [window.select("window").scalar().alias("window")]
    body = F.struct("labels", *ends, *block, *[F.lit(value).alias(name) for name, value in fixed.items()])
    return labels.select(F.to_json(body).alias("config"))


def stage_stats(df: DataFrame, name: str, extents: list[str]) -> DataFrame:
    """Rows and the least and greatest of some columns, as one row."""
    ends = [f(F.col(c)).alias(f"{label}_{c}") for c in extents for f, label in ((F.min, "min"), (F.max, "max"))]
    return df.agg(F.lit(name).alias("stage"), F.count("*").alias("n_rows"), *ends)


def observed(df: DataFrame, name: str, extents: list[str]) -> tuple[DataFrame, Observation]:
    """The same numbers taken while the frame is computed for something else."""
    watch = Observation(name)
    ends = [f(F.col(c)).alias(f"{label}_{c}") for c in extents for f, label in ((F.min, "min"), (F.max, "max"))]
    return df.observe(watch, F.count(F.lit(1)).alias("n_rows"), *ends), watch
