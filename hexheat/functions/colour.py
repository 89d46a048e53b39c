"""Ramp positions and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from hexheat import schemas as S

STEPS = 256


def hex_rgb(text: Column) -> Column:
    """`#rrggbb` as a struct of three INTs."""
    def channel(start: int) -> Column:
        return F.conv(F.substring(text, start, 2), 16, 10).cast("int")

    return F.struct(channel(2).alias("r"), channel(4).alias("g"), channel(6).alias("b"))


def ramp_position(value: Column, lo: Column, hi: Column) -> Column:
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - lo) / (hi - lo)))
    return F.when(value.isNotNull(), place)


def ramp_rgb(value: Column, lo: Column, hi: Column, stops: Sequence[str], fade: bool = False) -> Column:
    """RGBA struct of a value on a ramp; NULL gets the no-data colour.

    `fade` makes low values translucent, as the load map does.
    """
    place = ramp_position(value, lo, hi)
    # The place in STEPS steps, then between two neighbouring stops.
    at = F.floor(place * (STEPS - 1) + 0.5) / (STEPS - 1) * (len(stops) - 1)
    left = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")

    def channel(k: int) -> Column:
        levels = F.array(*[F.lit(float(int(stop[1 + 2 * k:3 + 2 * k], 16))) for stop in stops])
        low, high = F.get(levels, left), F.get(levels, left + 1)
        mixed = F.floor(low * (1 - (at - left)) + high * (at - left) + 0.5).cast("int")
        return F.when(value.isNull(), F.lit(S.NO_DATA_RGBA[k])).otherwise(mixed)

    opaque = F.lit(S.INDEX_ALPHA)
    faded = (F.floor(place * S.LOAD_ALPHA_SPAN + 0.5) + S.LOAD_ALPHA_BASE).cast("int")
    alpha = F.when(value.isNull(), F.lit(S.NO_DATA_RGBA[3])).otherwise(faded if fade else opaque)
    return F.struct(channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"), alpha.alias("a"))
