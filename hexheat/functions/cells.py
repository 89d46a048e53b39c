"""Equal-area hexagons as plain arithmetic.

A cell id is our own: axial coordinates of a pointy-top hexagon lattice on a cylindrical
equal-area projection with standard parallel 37.5 degrees. It is not the id of any other
hexagon system. `register_cell_udf` lets such a system be plugged in where it is installed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

# ---- fixed values -----------------------------------------------------------------------
EARTH_KM = 6371.0088
STANDARD_LAT = 37.5
RES6_AREA_KM2 = 36.129
APERTURE = 7
AXIS_BITS = 21
# -----------------------------------------------------------------------------------------

HALF_AXIS = 1 << (AXIS_BITS - 1)
AXIS_MASK = (1 << AXIS_BITS) - 1
COS0 = math.cos(math.radians(STANDARD_LAT))
ROOT3 = math.sqrt(3.0)


def cell_area_km2(res: int) -> float:
    return RES6_AREA_KM2 * float(APERTURE) ** (6 - res)


def edge_km(res: int) -> float:
    return math.sqrt(2.0 * cell_area_km2(res) / (3.0 * ROOT3))


def id_of_axial(q: Column, r: Column) -> Column:
    high = F.shiftleft(q.cast("bigint") + HALF_AXIS, AXIS_BITS)
    return high + r.cast("bigint") + HALF_AXIS


def axial_of(cell: Column) -> tuple[Column, Column]:
    """(q, r) of a cell id, both INT."""
    q = F.shiftright(cell, AXIS_BITS) - HALF_AXIS
    r = cell.bitwiseAND(F.lit(AXIS_MASK)) - HALF_AXIS
    return q.cast("int"), r.cast("int")


def cell_of(lat: Column, lon: Column, res: int) -> Column:
    """Id of the hexagon that holds a point; NULL for a point without coordinates."""
    nan = F.lit(float("nan"))
    cell = cell_at(F.coalesce(lat, nan), F.coalesce(lon, nan), res)
    return F.when(lat.isNotNull() & lon.isNotNull(), cell)


def cell_at(lat: Column, lon: Column, res: int) -> Column:
    """The same for coordinates known to be numbers, without the test."""
    s = edge_km(res)
    # factors and no quotients: a quotient may be NULL in Spark's eyes, and is tested for it
    x = F.radians(lon) * (EARTH_KM * COS0 * ROOT3 / (3.0 * s))
    y = F.sin(F.radians(lat)) * (EARTH_KM / (COS0 * 3.0 * s))
    q, r = x - y, y * 2.0
    # Round both axes, then move one step along the axis with the larger rest if it reaches
    # past the edge: the nearest centre in two comparisons.
    rest_q, rest_r = q - F.rint(q), r - F.rint(r)
    along_q = F.abs(rest_q) >= F.abs(rest_r)
    return id_of_axial(
        F.rint(q) + F.when(along_q, F.rint(rest_q + rest_r * 0.5)).otherwise(0.0),
        F.rint(r) + F.when(along_q, 0.0).otherwise(F.rint(rest_r + rest_q * 0.5)),
    )


def centre_of_axial(q: Column, r: Column, res: int) -> tuple[Column, Column]:
    """(lat, lon) of the centre of hexagon (q, r)."""
    s = edge_km(res)
    x = (q + r / 2.0) * (s * ROOT3)
    y = r * (s * 1.5)
    lat = F.degrees(F.asin(y * (COS0 / EARTH_KM)))
    lon = F.degrees(x / (EARTH_KM * COS0))
    return lat, lon


def cell_centre(cell: Column, res: int) -> tuple[Column, Column]:
    return centre_of_axial(*axial_of(cell), res)


def cell_hex(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def cell_from_hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def register_cell_udf(spark: SparkSession, name: str, label: Callable) -> None:
    """Register `label(lat, lon, res) -> ids` over whole columns under `name` for SQL.

    `label` takes and returns pandas Series, for a hexagon library installed on the workers.
    """
    def vectorised(lat: pd.Series, lon: pd.Series, res: pd.Series) -> pd.Series:
        return pd.Series(label(lat, lon, res)).astype("int64")

    spark.udf.register(name, F.pandas_udf(vectorised, "bigint"))
