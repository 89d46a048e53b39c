"""The film: heat index and weather codes per (cell, hour), and the questions asked of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexheat import schemas as S
from hexheat.functions import (
    c_to_f, cell_hex, cell_of, dequantise_hi, dequantise_load, heat_index_of, is_finite, or_nan,
    pack_wx, quantise_hi,
)
from hexheat.operators.sequences import running_sum
from hexheat.session import broadcast_checked, measured


def heat_film(cell_hour: DataFrame) -> DataFrame:
    """Heat index, its code and the packed weather byte, a row wherever there is an index.

    A (cell, hour) without temperature or humidity has no row; `densify` shows it as NULL.
    Nothing here can be NULL, and the defaults say so to the planner: a later
    `hi_q IS NOT NULL` is then dropped, where else it would repeat the whole formula.
    """
    def optional(name: str) -> Column:
        return F.col(name) if name in cell_hour.columns else F.lit(0.0)

    # in steps: a column used many times is then computed once
    inputs = cell_hour.where(is_finite(F.col("tc")) & is_finite(F.col("rh"))).select(
        "cell", "t", or_nan(c_to_f(F.col("tc").cast("double"))).alias("f"), or_nan(F.col("rh")).alias("r"),
        pack_wx(optional("ws"), optional("mm")).alias("wx_q"),
    )
    index = or_nan(heat_index_of(F.col("f"), F.col("r"))).cast("float")
    code = F.coalesce(quantise_hi(F.col("hi")), F.lit(S.NO_DATA).cast("smallint"))
    return inputs.select("cell", "t", index.alias("hi"), "wx_q").select(
        "cell", "t", "hi", code.alias("hi_q"), "wx_q"
    )


def frames(film: DataFrame) -> DataFrame:
    """Hours of the film numbered in order, written once: a row per hour of the window."""
    hours = measured(film.select("t").distinct(), "hours")
    return hours.withColumn("frame", F.row_number().over(Window.orderBy("t")) - 1)


def positions(dimension: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Dense 0-based place of each row in the order of a unique key, without a task that sees them all.

    Rows are dealt by ranges of the key and written in order with their place inside the range;
    only the ranges' counts, a row a range, are added up.
    """
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = dimension.repartitionByRange(key).sortWithinPartitions(key)
    rows = measured(ranged.withColumns({"_range": F.spark_partition_id(), "_inside": inside}), "positions")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    placed = rows.join(F.broadcast(starts), "_range")  # a row a range
    return placed.select(*dimension.columns, (F.col("_start") + F.col("_inside")).cast("int").alias(name))


def index_film(film: DataFrame, hours: DataFrame, cells: DataFrame) -> DataFrame:
    """Add frame and cell positions by joins to the two dimensions."""
    return (
        film.join(broadcast_checked(hours.select("t", "frame")), "t")
        .join(broadcast_checked(cells.select("cell", "pos")), "cell")
    )


def densify(film: DataFrame, cells: DataFrame, t0: datetime, t1: datetime) -> DataFrame:
    """Every land cell at every hour that has a frame; gaps become NULL rows."""
    hours = F.sequence(
        F.lit(t0).cast("timestamp_ntz"), F.lit(t1).cast("timestamp_ntz"), F.expr("INTERVAL 1 HOUR")
    )
    scaffold = cells.select("cell", F.explode(hours).alias("t"))
    present = broadcast_checked(measured(film.select("t").distinct(), "hours"))
    return scaffold.join(present, "t", "left_semi").join(film, ["cell", "t"], "left")


HOURS_A_STRETCH = 1 << 12


def line_segments(dense: DataFrame, value: str) -> DataFrame:
    """Number the unbroken stretches of each cell's line, a row an hour; rows without a value are dropped.

    A long line is cut into stretches of hours, so no task orders a whole line.
    """
    hour = F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / 3600)
    marked = dense.withColumns({"_hour": hour, "_gap": F.col(value).isNull().cast("bigint")})
    counted = running_sum(marked, ["cell"], "_hour", {"segment": "_gap"}, HOURS_A_STRETCH)
    return counted.where(F.col(value).isNotNull()).drop("_hour", "_gap")


def day_breaks(hours: DataFrame) -> DataFrame:
    """Frames at which the UTC date changes."""
    before = F.lag(F.to_date("t")).over(Window.orderBy("t"))
    return hours.withColumn("before", before).where(F.to_date("t") != F.col("before")).drop("before")


def frame_snapshot(film: DataFrame, t: datetime) -> DataFrame:
    """All cells of one hour; the day filter prunes a stored film."""
    hour = film.where(F.col("t") == F.lit(t).cast("timestamp_ntz"))
    return hour.where(F.col("day") == F.lit(t.date())) if "day" in film.columns else hour


def of_cell(film: DataFrame, cell: int) -> DataFrame:
    """One cell's film. Taken before the recurrence, which then walks through this cell alone."""
    return film.where(F.col("cell") == cell)


def cell_series(pair: DataFrame) -> DataFrame:
    """Heat index and load over the window, in order."""
    return pair.orderBy("t")


def pair(load: DataFrame) -> DataFrame:
    """Both fields of the same (cell, hour) side by side. The recurrence carries the codes along, so nothing is joined."""
    return load.select("cell", "t", "hi_q", "load_q")


def pick(points: DataFrame, film: DataFrame, res: int) -> DataFrame:
    """Cell and value at each point's hour, NULL where the film has none.

    The film is unique per (cell, t), so a crowd of points on one cell can be split over
    tasks at run time without changing the answer.
    """
    placed = points.withColumn("cell", cell_of(F.col("lat"), F.col("lon"), res))
    return placed.join(film.select("cell", "t", "hi_q"), ["cell", "t"], "left")


def means() -> list[Column]:
    """Mean of the shown heat index, and the number of cells, for a group of rows with data."""
    return [F.avg(dequantise_hi(F.col("hi_q"))).alias("mean_hi"), F.count("*").alias("n_cells")]


def frame_means(film: DataFrame) -> DataFrame:
    """Mean of the shown heat index over the cells with data, hour by hour."""
    return film.where(F.col("hi_q").isNotNull()).groupBy("t").agg(*means())


def extent(df: DataFrame, value: str, by: list[str] | None = None, from_zero: bool = False) -> DataFrame:
    """Least and greatest value, drawn at least one degree apart.

    `from_zero` is the load's axis: it starts at 0 and grows upward only.
    """
    grouped = df.groupBy(*by) if by else df
    lo = F.lit(0.0) if from_zero else F.min(value).cast("double")
    ends = grouped.agg(lo.alias("lo"), F.max(value).cast("double").alias("hi"))
    ends = ends.where(F.col("hi").isNotNull())
    flat = F.col("hi") - F.col("lo") < 1.0
    low = F.col("lo") if from_zero else F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    high = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    return ends.select(*(by or []), low.alias("lo"), high.alias("hi"))


BINS_PER_C = 64.0


def exact_quantiles(film: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """Exact, linearly interpolated quantiles as rows (share, quantile), without one big sort.

    Counts per narrow bin find the few bins that hold the wanted ranks; only the values in
    those bins, counted per distinct value, are ordered. No task sees more than one bin.
    """
    values = film.where(F.col(value).isNotNull()).select(
        F.col(value).alias("value"), F.floor(F.col(value) * BINS_PER_C).alias("bin")
    )
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = values.groupBy("bin").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(upto) - F.col("n")
    )
    total = F.sum("n").over(Window.partitionBy())
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    at = F.col("share") * (F.col("total") - 1)
    ranked = bins.withColumn("total", total).select("bin", "n", "before", "total", share).select(
        "bin", "n", "before", "share", at.alias("at"),
        F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"),
    ).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    wanted = ranked.select("bin", "before").distinct()
    inside = Window.partitionBy("bin").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (
        values.join(F.broadcast(wanted), "bin")  # at most two bins a share
        .groupBy("bin", "before", "value").agg(F.count("*").alias("m"))
        .withColumn("last", F.col("before") + F.sum("m").over(inside) - 1)
        .withColumn("first", F.col("last") - F.col("m") + 1)
    )
    found = ordered.join(F.broadcast(ranked.select("bin", "share", "at", "rank")), "bin").where(
        F.col("rank").between(F.col("first"), F.col("last"))
    )
    # two neighbouring ranks weigh by distance; a whole rank weighs 1
    weight = 1.0 - F.abs(F.col("at") - F.col("rank"))
    return found.groupBy("share").agg(
        F.sum(F.col("value").cast("double") * weight).alias("quantile")
    )


def index_ramp(film: DataFrame, pivot: float | None = None, span: float | None = None) -> DataFrame:
    """Ends of the heat index ramp: the median, and the wider of its distances to p2 and p98."""
    q = exact_quantiles(film, "hi", [0.02, 0.5, 0.98]).agg(
        F.max(F.when(F.col("share") == 0.02, F.col("quantile"))).alias("p2"),
        F.max(F.when(F.col("share") == 0.5, F.col("quantile"))).alias("p50"),
        F.max(F.when(F.col("share") == 0.98, F.col("quantile"))).alias("p98"),
    )
    mid = F.col("p50") if pivot is None else F.lit(float(pivot))
    wide = F.greatest(mid - F.col("p2"), F.col("p98") - mid) if span is None else F.lit(float(span))
    return q.select((mid - wide).alias("lo"), mid.alias("mid"), (mid + wide).alias("hi"))


def cell_labels(cells: DataFrame, counties: DataFrame) -> DataFrame:
    """What a click reads out: the county, or the id of a cell outside all counties."""
    named = cells.join(broadcast_checked(counties.select("county_idx", "label")), "county_idx", "left")
    return named.withColumn(
        "readout",
        F.coalesce(F.concat(F.lit("cell in "), F.col("label")), F.concat(F.lit("cell "), cell_hex(F.col("cell")))),
    )


def shown(film: DataFrame) -> DataFrame:
    """Codes as the degrees they stand for."""
    out = film
    if "hi_q" in film.columns:
        out = out.withColumn("hi_shown", dequantise_hi(F.col("hi_q")))
    if "load_q" in film.columns:
        out = out.withColumn("load_shown", dequantise_load(F.col("load_q")))
    return out


def no_data_codes(film: DataFrame) -> DataFrame:
    """Codes as a binary reader wants them: 255 where there is no heat index, 0 weather."""
    return film.withColumns({
        "hi_q": F.coalesce("hi_q", F.lit(S.NO_DATA).cast("smallint")),
        "wx_q": F.coalesce("wx_q", F.lit(0).cast("smallint")),
    })
