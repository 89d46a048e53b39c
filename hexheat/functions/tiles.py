"""Web Mercator tiles: cover, inverse, and the Hilbert order of tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

MERCATOR_LAT = 85.05  # fixed value: the latitude at which tiles are cut off


def _side(z: Column) -> Column:
    """Tiles along one axis at zoom z, as DOUBLE."""
    return F.pow(F.lit(2.0), z)


def lonlat_to_tile(lon: Column, lat: Column, z: Column) -> Column:
    """Struct (x, y) of the tile that holds a point, kept inside the grid."""
    n = _side(z)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MERCATOR_LAT)), F.lit(MERCATOR_LAT)))
    across = (lon + 180.0) / 360.0 * n
    down = (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n

    def kept(value: Column) -> Column:
        return F.least(F.greatest(F.floor(value).cast("double"), F.lit(0.0)), n - 1.0).cast("int")

    tile = F.struct(kept(across).alias("x"), kept(down).alias("y"))
    return F.when(lon.isNotNull() & lat.isNotNull(), tile)


def tile_to_lonlat(z: Column, x: Column, y: Column, px: Column, py: Column, extent: Column) -> Column:
    """Struct (lon, lat) of the point (px, py) inside a tile of `extent` units."""
    n = _side(z)
    lon = (x + px / extent) / n * 360.0 - 180.0
    lat = F.degrees(F.atan(F.sinh((1.0 - 2.0 * (y + py / extent) / n) * math.pi)))
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def hilbert_id(z: Column, x: Column, y: Column) -> Column:
    """Place of a tile in Hilbert order, all coarser levels first.

    One quadrant per level, from the top: the fold keeps (x, y, place) and turns the frame.
    """
    x, y, level0 = x.cast("bigint"), y.cast("bigint"), z.cast("int")

    def descend(acc: Column, level: Column) -> Column:
        half = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        east = (acc["x"].bitwiseAND(half) != 0).cast("bigint")
        south = (acc["y"].bitwiseAND(half) != 0).cast("bigint")
        quadrant = (east * 3).bitwiseXOR(south)
        mirrored = (south == 0) & (east == 1)
        mx = F.when(mirrored, half - 1 - acc["x"]).otherwise(acc["x"])
        my = F.when(mirrored, half - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(
            F.when(south == 0, my).otherwise(mx).alias("x"),
            F.when(south == 0, mx).otherwise(my).alias("y"),
            (acc["d"] + half * half * quadrant).alias("d"),
        )

    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("bigint").alias("d"))
    levels = F.sequence(level0 - 1, F.lit(0), F.lit(-1))
    within = F.when(level0 > 0, F.aggregate(levels, start, descend, lambda acc: acc["d"])).otherwise(0)
    above = (F.call_function("shiftleft", F.lit(1).cast("bigint"), level0 * 2) - 1) / 3
    return above.cast("bigint") + within


def zigzag(value: Column) -> Column:
    """Signed number from its zigzag code."""
    value = value.cast("bigint")
    return F.shiftright(value, 1).bitwiseXOR(-value.bitwiseAND(F.lit(1).cast("bigint")))
