"""Labels, keys and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def value_label(value: Column, signed: bool = False) -> Column:
    """`12.3°C`, `+1.0°C`, or `no data`."""
    text = F.format_string("%.1f°C", value)
    if signed:
        text = F.concat(F.lit("+"), text)
    return F.when(value.isNull() | F.isnan(value), F.lit("no data")).otherwise(text)


def county_label(name: Column, region: Column) -> Column:
    """`name, ST`. An empty region stays in the label; a NULL name has none."""
    return F.concat(name, F.lit(", "), F.coalesce(region, F.lit("")))


def region_suffix(region: Column) -> Column:
    """What follows the first dash: `US-TX` is `TX`; NULL is the empty string."""
    return F.element_at(F.split(F.coalesce(region, F.lit("")), "-", 2), -1)


def division_key(division_id: Column, own_id: Column) -> Column:
    """The division id unless it is NULL or empty."""
    return F.coalesce(F.nullif(division_id, F.lit("")), own_id)


def path_tail(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def shard_index(key: Column, variables: tuple[str, ...] | None = None) -> Column:
    """Leading chunk index of `variable/c/<index>/<y>/<x>`; NULL for any other key."""
    parts = F.split(key, "/")
    known = F.get(parts, F.lit(0)).isin(*variables) if variables else F.lit(True)
    shaped = (F.size(parts) == 5) & (F.get(parts, F.lit(1)) == "c") & known
    digits = F.get(parts, F.lit(2)).rlike("^[0-9]+$")
    return F.when(shaped & digits, F.get(parts, F.lit(2)).try_cast("int"))


def shard_name(key: Column, byte_range: Column) -> Column:
    """Flat file name of a landed shard; NULL range is the whole object."""
    whole = F.lit("all")
    tag = F.when(byte_range.isNull(), whole).otherwise(
        F.concat(F.lit("x"), F.substring(F.sha1(byte_range), 1, 12))
    )
    return F.concat(F.replace(key, F.lit("/"), F.lit("__")), F.lit("."), tag)
