"""Pixels to (run, lead, cell): the join to the pixel lookup and the average."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexheat import schemas as S
from hexheat.functions import (
    cell_area_km2, cell_at, is_finite, is_present, or_nan, or_null, rain_mm, valid_time, wind_speed,
)
from hexheat.session import broadcast_checked, measured


def guard_resolution(res: int, pixel_area_km2: float | None = None) -> None:
    """Refuse cells finer than the grid: most would hold no pixel centre."""
    if res > S.FINEST_RESOLUTION or (pixel_area_km2 and cell_area_km2(res) < pixel_area_km2):
        raise ValueError(
            f"resolution {res} is too fine: a cell would be smaller than a pixel and the map full of "
            f"holes; use {S.FINEST_RESOLUTION} or coarser"
        )


def drop_missing(df: DataFrame, column: str = "tc") -> DataFrame:
    return df.where(is_present(F.col(column)))


def label_pixels(grid: DataFrame, res: int) -> DataFrame:
    """The cell of every pixel that has coordinates.

    A pixel never moves, so it is labelled once and not per hour. The default is never taken;
    it tells the planner that a cell is not NULL, so a join on it repeats no formula.
    """
    lat, lon = F.col("lat"), F.col("lon")
    cell = F.coalesce(cell_at(or_nan(lat), or_nan(lon), res), F.lit(0).cast("bigint"))
    return grid.where(is_finite(lat) & is_finite(lon)).withColumn("cell", cell)


def land_pixels(pixels: DataFrame, land_cells: DataFrame) -> DataFrame:
    """Labelled pixels whose cell is land."""
    return pixels.join(land_cells.select("cell"), "cell", "left_semi")


def block_of(index: Column, width: int) -> Column:
    return F.floor(index / width).cast("int")


def land_blocks(pixels: DataFrame) -> DataFrame:
    """Storage blocks that hold a land pixel."""
    return pixels.select("yb", "xb").distinct()


def block_spans(blocks: DataFrame) -> DataFrame:
    """Islands: per block row, maximal runs of neighbouring block columns."""
    order = Window.partitionBy("yb").orderBy("xb")
    numbered = blocks.select("yb", "xb").distinct().withColumn(
        "island", F.col("xb") - F.row_number().over(order)
    )
    return numbered.groupBy("yb", "island").agg(
        F.min("xb").alias("xb0"), F.max("xb").alias("xb1")
    ).drop("island")


BANDS = 32


def near_blocks(blocks: DataFrame) -> Column:
    """A filter for the scan: the boxes around the blocks of each of at most BANDS bands of block rows."""
    lo, hi = (blocks.agg(end("yb")).scalar() for end in (F.min, F.max))
    band = F.floor((F.col("yb") - lo) * BANDS / (hi - lo + 1))
    ends = [end(c).alias(f"{c}{k}") for c in ("yb", "xb") for k, end in enumerate((F.min, F.max))]
    near = F.lit(False)
    for b in blocks.groupBy(band.alias("band")).agg(*ends).orderBy("band").collect():  # a row a band
        near = near | (F.col("yb").between(b.yb0, b.yb1) & F.col("xb").between(b.xb0, b.xb1))
    return near


def prune_blocks(cube: DataFrame, blocks: DataFrame) -> DataFrame:
    """Keep land blocks by a semi join on the partition columns: pruned while the job runs.

    The blocks are written first. Estimated from the pixels they come from, they would seem too
    large to broadcast on a fine grid, and nothing would be pruned. Boxes around them are a plain filter, which
    tells row groups apart where blocks have no folders.
    """
    # The planner prunes only by a side that is filtered; no block lies before the first.
    known = measured(blocks.select("yb", "xb").distinct(), "blocks").where("yb >= 0 AND xb >= 0")
    return cube.where(near_blocks(known)).join(broadcast_checked(known), ["yb", "xb"], "left_semi")


def in_spans(cube: DataFrame, spans: DataFrame) -> DataFrame:
    """The same from island spans, however many there are."""
    blocks = spans.select("yb", F.explode(F.sequence("xb0", "xb1")).alias("xb"))
    return prune_blocks(cube, blocks)


def averages(rain: bool = True, wind: bool = True) -> list[Column]:
    """Cell means: in double, stored as FLOAT. Wind is the mean of speeds."""
    columns = [
        F.avg(F.col("tc")).cast("float").alias("tc"),
        or_null(F.avg(F.col("rh"))).cast("float").alias("rh"),
    ]
    if rain:
        columns.append(rain_mm(F.avg(F.col("rain"))).cast("float").alias("mm"))
    if wind:
        columns.append(F.avg(wind_speed(F.col("u"), F.col("v"))).cast("float").alias("ws"))
    return columns


def fold(cube: DataFrame, pixels: DataFrame, rain: bool = True, wind: bool = True) -> DataFrame:
    """Mean of each variable per (run, lead, cell), with the valid hour `t`.

    The lookup carries the cell, so nothing is computed per pixel-hour but the join, and its
    two INT keys are hashed as one long. Each scan task averages the pixels it holds before
    the shuffle. Prune a stored cube's blocks first, by `prune_blocks`.
    """
    lookup = broadcast_checked(pixels.select("yi", "xi", "cell"))
    read = ["tc", "rh", *(["rain"] if rain else []), *(["u", "v"] if wind else [])]
    readings = drop_missing(cube.select("init_ts", "lead_h", "yi", "xi", *read))
    return (
        readings.join(lookup, ["yi", "xi"])
        .groupBy("init_ts", "lead_h", "cell").agg(*averages(rain, wind))
        .withColumn("t", valid_time(F.col("init_ts"), F.col("lead_h")))
    )


def cell_hours(folded: DataFrame, leads: int = S.LEADS_PER_RUN) -> DataFrame:
    """One row per (cell, valid hour). Abutting runs need no shuffle; overlapping ones do."""
    from hexheat.operators.windowing import newest_run

    values = [c for c in ("tc", "rh", "mm", "ws") if c in folded.columns]
    if leads > S.RUN_SPACING_HOURS:
        folded = newest_run(folded, values)
    return folded.select("cell", "t", *values)


def coverage(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """Pixels in each cell, 0 for a cell without one."""
    held = pixels.groupBy("cell").agg(F.count("*").alias("n"))
    return cells.select("cell").join(held, "cell", "left").select(
        "cell", F.coalesce("n", F.lit(0)).alias("n_pixels")
    )
