"""Heat index, weather conversions, and the 8-bit codes they are stored in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hexheat import schemas as S

# ---- fixed values: the US National Weather Service heat index ----------------------------
# Rothfusz regression in T (deg F) and R (%): coefficient of T^i R^j at [i][j].
ROTHFUSZ = (
    (-42.379, 10.14333127, -0.05481717),
    (2.04901523, -0.22475541, 0.00085282),
    (-0.00683783, 0.00122874, -0.00000199),
)
REGRESSION_FROM_F = 80.0
DRY_BELOW_RH, DRY_T = 13.0, (80.0, 112.0)
HUMID_ABOVE_RH, HUMID_T = 85.0, (80.0, 87.0)
# -----------------------------------------------------------------------------------------


def is_present(value: Column) -> Column:
    """Neither NULL nor NaN. `x = x` does not say this: NaN equals itself in Spark."""
    return value.isNotNull() & ~F.isnan(value)


def is_finite(value: Column) -> Column:
    """A number that is neither NaN nor infinite. NaN sorts above infinity in Spark."""
    return (value > float("-inf")) & (value < float("inf"))


def or_null(value: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(value), value)


def or_zero(value: Column) -> Column:
    """NULL and NaN as 0, the rule for rain and wind."""
    return F.nanvl(F.coalesce(value, F.lit(0.0)), F.lit(0.0))


def c_to_f(celsius: Column) -> Column:
    return celsius * 9.0 / 5.0 + 32.0


def f_to_c(fahrenheit: Column) -> Column:
    return (fahrenheit - 32.0) * 5.0 / 9.0


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def rain_mm(rate: Column) -> Column:
    """kg m-2 s-1 to mm in the hour."""
    return rate * 3600.0


def or_nan(value: Column) -> Column:
    """NULL as NaN: a number that cannot be NULL needs no NULL checks in generated code."""
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def heat_index_c(tc: Column, rh: Column) -> Column:
    """NWS heat index in deg C. NULL when either input is missing."""
    return F.when(is_finite(tc) & is_finite(rh), heat_index_of(or_nan(c_to_f(tc.cast("double"))), or_nan(rh)))


def heat_index_of(t: Column, r: Column) -> Column:
    """The same from deg F and % that are known to be numbers.

    Kept short on purpose: it is generated into the loop that finishes the fold, and a loop
    body past 8,000 bytes of bytecode is never compiled to machine code.
    """
    steadman = 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + r * 0.094)

    def in_r(row: tuple[float, float, float]) -> Column:
        return F.lit(row[0]) + r * (row[1] + r * row[2])

    t0, t1, t2 = (in_r(row) for row in ROTHFUSZ)
    rothfusz = t0 + t * (t1 + t * t2)
    dry = (r - 13.0) * 0.25 * F.sqrt(1.0 - F.abs(t - 95.0) * (1.0 / 17.0))
    humid = (r - 85.0) * (87.0 - t) * 0.02
    adjustment = (
        F.when((r < DRY_BELOW_RH) & t.between(*DRY_T), dry)
        .when((r > HUMID_ABOVE_RH) & t.between(*HUMID_T), humid)
        .otherwise(0.0)
    )
    regression = (steadman + t) * 0.5 >= REGRESSION_FROM_F
    return f_to_c(F.when(regression, rothfusz + adjustment).otherwise(steadman))


def _clipped(value: Column, top: int) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(float(top)))


def quantise_hi(hi: Column) -> Column:
    """Half-degree steps from -40, half to even, saturating at 254. Single precision inside."""
    steps = (hi.cast("float") + F.lit(S.HI_OFFSET_C).cast("float")) * F.lit(S.HI_STEPS_PER_C).cast("float")
    # `least` and `greatest` skip NULL, so the input is tested
    return F.when(hi.isNotNull(), _clipped(F.rint(steps), S.TOP_CODE).cast("smallint"))


def dequantise_hi(code: Column) -> Column:
    return code / S.HI_STEPS_PER_C - S.HI_OFFSET_C


def pack_wx(ws: Column, mm: Column) -> Column:
    """Whole m/s in the high four bits, half mm/h in the low four; missing is 0."""
    wind = _clipped(F.rint(or_zero(ws)), 15).cast("int")
    rain = _clipped(F.rint(or_zero(mm) * 2.0), 15).cast("int")
    return F.shiftleft(wind, 4).bitwiseOR(rain).cast("smallint")


def unpack_wind(code: Column) -> Column:
    return F.shiftright(code.cast("int"), 4).cast("double")


def unpack_rain(code: Column) -> Column:
    return code.cast("int").bitwiseAND(15) / 2.0


def quantise_load(load: Column) -> Column:
    """Tenth-degree steps, half up, saturating at 254."""
    steps = F.floor(load * S.LOAD_STEPS_PER_C + 0.5).cast("double")
    return F.when(load.isNotNull(), _clipped(steps, S.TOP_CODE).cast("smallint"))


def dequantise_load(code: Column) -> Column:
    return code / S.LOAD_STEPS_PER_C


def decay(half_life: Column) -> Column:
    """Share of the load kept over one step."""
    return F.pow(F.lit(2.0), F.lit(-1.0) / half_life)


def vented_excess(hi: Column, threshold: Column, ws: Column, vent: Column) -> Column:
    """Degrees over the threshold, reduced by wind down to nothing. Inputs are not NULL."""
    return F.greatest(hi - threshold, F.lit(0.0)) * F.greatest(
        F.lit(1.0) - vent * ws / S.FULL_VENT_MS, F.lit(0.0)
    )


def flush_factor(mm: Column, flush: Column) -> Column:
    """Share of the load that rain leaves behind. Inputs are not NULL."""
    return F.lit(1.0) - flush * F.least(mm / S.FULL_FLUSH_MM, F.lit(1.0))
