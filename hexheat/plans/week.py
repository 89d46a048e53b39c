"""A window of the archive to a film, and a film to sustained heat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hexheat import schemas as S
from hexheat.operators import accumulate, film, fold, windowing
from hexheat.session import broadcast_checked, measured


def load_window(
    cube: DataFrame,
    pixels: DataFrame,
    first_day: str = S.DEFAULT_WINDOW[0],
    last_day: str = S.DEFAULT_WINDOW[1],
    leads: int = S.LEADS_PER_RUN,
    rain: bool = True,
    wind: bool = True,
) -> DataFrame:
    """The film of a window: heat index and weather codes per (cell, hour)."""
    stitched = windowing.stitch(cube, first_day, last_day, leads)
    folded = fold.fold(stitched, pixels, rain, wind)
    return film.heat_film(fold.cell_hours(folded, leads))


def films_of_requests(
    requests: DataFrame, runs: DataFrame, cube: DataFrame, pixels: DataFrame, leads: int = S.LEADS_PER_RUN,
) -> tuple[DataFrame, DataFrame]:
    """Window requests (`body`) to films, in one job: the resolved requests, and `d0, d1` with the film's columns.

    A window that many ask for is made once. The archive is read once, for the days of all windows
    together; each window then takes its days' hours up to its own last hour. A window has at most
    MAX_WINDOW_DAYS days, so an hour of the film is in a bounded number of windows. Refused
    requests stay in the first table with their status and have no film.
    """
    resolved = windowing.resolve_window(windowing.parse_window(requests), runs, leads=leads)
    fine = resolved.where(F.col("status") == windowing.OK)
    windows = measured(fine.groupBy("d0", "d1").agg(F.max("t1").alias("t1")), "windows")
    wanted = windows.select("d0", "d1", "t1", F.explode(F.sequence("d0", "d1")).alias("day"))
    days = measured(wanted.select(F.col("day").alias("init_day")).distinct(), "days")
    dated = cube if "init_day" in cube.columns else cube.withColumn("init_day", F.to_date("init_ts"))
    read = dated.join(broadcast_checked(days), "init_day", "left_semi").where(F.col("lead_h") < leads)
    film_rows = film.heat_film(fold.cell_hours(fold.fold(read, pixels), leads)).withColumn("day", F.to_date("t"))
    cut = film_rows.join(broadcast_checked(wanted), "day").where(F.col("t") <= F.col("t1"))
    return resolved, cut.select("d0", "d1", *[c for c in film_rows.columns if c != "day"])


def heat_and_load(heat: DataFrame, **params: float) -> DataFrame:
    """Both fields side by side: what the two panes of a viewer read."""
    return film.shown(film.pair(accumulate.sustained_heat(heat, **params)))
