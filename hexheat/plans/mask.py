"""The land mask: division pieces to land cells, and land cells to the pixel lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hexheat.operators import film, fold, regions


def land_cells(pieces: DataFrame, res: int) -> DataFrame:
    """Cells whose centre is in a division: `cell, id`, one row each."""
    filled = regions.polyfill_cells(regions.ring_edges(pieces), res)
    return regions.distinct_cells(filled)


def cell_table(pieces: DataFrame, res: int) -> DataFrame:
    """Land cells with their position, county and click label."""
    divisions = regions.division_table(pieces)
    cells = film.positions(land_cells(pieces, res), "cell")
    return film.cell_labels(regions.cell_county(cells, divisions), divisions)


def pixel_lookup(grid: DataFrame, cells: DataFrame, res: int) -> DataFrame:
    """Land pixels with their cell: the small side of the fold."""
    fold.guard_resolution(res)
    return fold.land_pixels(fold.label_pixels(grid, res), cells)
