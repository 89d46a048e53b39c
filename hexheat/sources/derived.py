"""Gridded inputs derived from the test tables, as FIXTURES.md defines them but for size and place of the grid.

A reading per line item, a pixel per part, a week of runs per so many orders, a region per
nation, a parcel per customer: all grow with the tables they come from. Some readings lack
temperature, some humidity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexheat import schemas as S

FIRST_INIT = "2026-06-29 00:00:00"
# A week of runs, and one more week for each further ORDERS_A_WEEK orders.
RUNS_A_WEEK, ORDERS_A_WEEK = 28, 150_000
# The grid reaches beyond all regions: what lies outside is sea.
SOUTH, HEIGHT, WEST_END, WIDTH = 20.4, 33.1, -133.0, 74.0
BLOCK_ROWS, BLOCK_COLS = 20, 10
SPREAD = 7919
RES = 3
NUDGE_LON, NUDGE_LAT = 0.0137, 0.0071

SEAM_N = 4.0 + 5.58 / 8.58 * 1.02
WHOLE = ((0.0, 0.0), (11.58, 1.0), (11.58, 4.0), (3.0, 5.02))
WEST = ((0.0, 0.0), (6.0, 6.0 / 11.58), (6.0, SEAM_N), (3.0, 5.02))
EAST = ((5.8, 5.8 / 11.58), (11.58, 1.0), (11.58, 4.0), (5.8, 4.0 + 5.78 / 8.58 * 1.02))


# Columns read from the test tables. Stated, so that no job runs to infer them.
COLUMNS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_discount double, l_tax double",
    "part": "p_partkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf}/{name}.parquet")


@dataclass(frozen=True)
class Shape:
    """The archive's size, from the tables': twice as many rows as columns, a pixel for each part."""

    cols: int
    runs: int

    @property
    def rows(self) -> int:
        return 2 * self.cols

    @property
    def block_rows(self) -> int:
        return max(1, min(BLOCK_ROWS, self.rows // 10))

    @property
    def block_cols(self) -> int:
        return max(1, min(BLOCK_COLS, self.cols // 10))


COUNTS: dict[tuple[str, str], tuple[int, int]] = {}


def shape(spark: SparkSession, sf: str) -> Shape:
    """The tables are counted once a session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in COUNTS:
        COUNTS[key] = (table(spark, sf, "part").count(), table(spark, sf, "orders").count())
    parts, orders = COUNTS[key]
    return Shape(max(4, math.isqrt(parts // 2)), RUNS_A_WEEK * max(1, orders // ORDERS_A_WEEK))


def _pixel(key: str, grid: Shape) -> list[str]:
    at = f"(({key} * {SPREAD}) % {grid.rows * grid.cols})"
    yi, xi = f"int({at} div {grid.cols})", f"int({at} % {grid.cols})"
    return [f"{yi} AS yi", f"{xi} AS xi", f"int({yi} div {grid.block_rows}) AS yb", f"int({xi} div {grid.block_cols}) AS xb"]


def pixel_hours(spark: SparkSession, sf: str) -> DataFrame:
    """One reading per line item: (run, lead, pixel) and five variables."""
    size = shape(spark, sf)
    run = f"int(l_orderkey % {size.runs})"
    init = f"timestampadd(HOUR, {S.RUN_SPACING_HOURS} * {run}, TIMESTAMP_NTZ'{FIRST_INIT}')"
    yi, xi, yb, xb = _pixel("l_partkey", size)
    return table(spark, sf, "lineitem").selectExpr(
        f"{run} AS run", f"{init} AS init_ts", "l_linenumber - 1 AS lead_h", yi, xi,
        "CASE WHEN l_orderkey % 97 = 0 THEN double('NaN') ELSE 10D + 0.6D * l_quantity END AS tc",
        "CASE WHEN l_orderkey % 89 = 0 THEN double('NaN') ELSE 10D + 900D * l_discount END AS rh",
        "greatest(l_tax - 0.04D, 0D) / 40D AS rain",
        "double(l_suppkey % 17 - 8) AS u", "double(l_orderkey % 13 - 6) AS v",
        f"to_date({init}) AS init_day", yb, xb,
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels and their coordinates, from the parts."""
    size = shape(spark, sf)
    return table(spark, sf, "part").selectExpr(*_pixel("p_partkey", size)).distinct().selectExpr(
        "yi", "xi", "yb", "xb", f"{SOUTH}D + {HEIGHT}D * yi / {size.rows} AS lat", f"{WEST_END}D + {WIDTH}D * xi / {size.cols} AS lon",
    )


def mask_points(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel centres nudged off polygon edges."""
    return grid(spark, sf).select(
        "yi", "xi", "yb", "xb", "lat", "lon",
        (F.col("lon") + NUDGE_LON).alias("px"), (F.col("lat") + NUDGE_LAT).alias("py"),
    )


def _ring(x0: Column, y0: Column, corners: list[tuple]) -> Column:
    """A closed ring through corners given relative to (x0, y0)."""
    points = [*corners, corners[0]]
    return F.array(*[F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in points])


def _nation_rings(spark: SparkSession, sf: str, corners: tuple) -> list[Column]:
    x0 = -124.8 + 11.58 * (F.col("n_nationkey") % 5)
    y0 = 24.4 + 5.02 * F.floor(F.col("n_nationkey") / 5)
    return F.array(_ring(x0, y0, list(corners)))


def divisions(spark: SparkSession, sf: str) -> DataFrame:
    """One whole region per nation: `id, name, region, part, rings`."""
    return _regions(spark, sf, "whole", WHOLE)


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The same regions cut at an overlapping seam, as tiles deliver them."""
    return _regions(spark, sf, "w", WEST).unionByName(_regions(spark, sf, "e", EAST))


def _regions(spark: SparkSession, sf: str, part: str, corners: tuple) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(
        F.concat(F.lit("div-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("US-"), F.upper(F.substring("r_name", 1, 2))).alias("region"),
        F.lit(part).alias("part"),
        _nation_rings(spark, sf, corners).alias("rings"),
    )


def features(spark: SparkSession, sf: str) -> DataFrame:
    """One polygon feature per customer, with the properties a division layer carries.

    A fifth fail one of the division filters, some lack a region or a division id, and every
    ninth has a hole.
    """
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey AS key", "c_name", "c_mktsegment",
        f"-124D + (c_custkey * {SPREAD} % 5500) / 100D AS x0", "25D + (c_custkey * 104729 % 2200) / 100D AS y0",
        "0.61D + (c_custkey % 7) * 0.15D AS w", "0.53D + (c_custkey % 5) * 0.17D AS h",
    )
    key, x0, y0, w, h = (F.col(c) for c in ("key", "x0", "y0", "w", "h"))

    def ring(corners: list[tuple[float, float, float, float]]) -> Column:
        """Closed ring of corners (a, b, c, d) at (x0 + a + b w, y0 + c + d h)."""
        points = F.array(*[F.array(*[F.lit(v) for v in corner]) for corner in [*corners, corners[0]]])
        return F.transform(points, lambda p: F.struct(
            (x0 + (p[0] + p[1] * w)).alias("x"), (y0 + (p[2] + p[3] * h)).alias("y")
        ))

    shell = ring([(0.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.13, 0.0), (0.0, 0.9, 0.0, 1.0), (0.1, 0.0, 0.0, 0.8)])
    hole = ring([(0.0, 0.3, 0.0, 0.3), (0.0, 0.3, 0.0, 0.6), (0.0, 0.6, 0.0, 0.6), (0.0, 0.6, 0.0, 0.3)])
    rings = (
        F.when(key % 31 == 0, F.array().cast(S.RINGS))
        .when(key % 9 == 0, F.array(shell, hole))
        .otherwise(F.array(shell))
    )
    own = F.concat(F.lit("area-"), key.cast("string"))
    return customers.select(
        F.when(key % 13 == 0, F.lit("")).when(key % 17 != 0, F.concat(F.lit("div-"), (key % 997).cast("string")))
        .alias("division_id"),
        own.alias("id"),
        F.col("c_name").alias("name"),
        F.when(key % 19 == 0, F.lit("region")).otherwise(F.lit("county")).alias("subtype"),
        F.when(key % 23 == 0, F.lit(None).cast("boolean")).otherwise(key % 29 != 0).alias("is_land"),
        F.when(key % 37 == 0, F.lit("CA")).otherwise(F.lit("US")).alias("country"),
        F.when(key % 41 == 0, F.lit("US-AK")).when(key % 43 != 0, F.concat(F.lit("US-"), F.col("c_mktsegment").substr(1, 2)))
        .alias("region"),
        F.concat(F.lit("p"), key.cast("string")).alias("part"),
        rings.alias("rings"),
    )


def raw_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Rings in the order a feature lists them: exterior, hole, and for odd keys once more.

    Exteriors have positive shoelace area in tile coordinates (y down).
    """
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", f"double(c_custkey * {SPREAD} % 4096) AS x0", "double(c_custkey * 104729 % 4096) AS y0",
        "20D + c_custkey % 30 AS side",
    )
    x0, y0, side = (F.col(c) for c in ("x0", "y0", "side"))

    def square(x: Column, y: Column, s: Column, hole: bool) -> Column:
        corners = [(F.lit(0.0), F.lit(0.0)), (s, F.lit(0.0)), (s, s), (F.lit(0.0), s)]
        return _ring(x, y, corners[::-1] if hole else corners)

    first = [square(x0, y0, side, False), square(x0 + 5.0, y0 + 5.0, side * 0.25, True)]
    second = [square(x0 + 100.0, y0, side * 0.5, False), square(x0 + 102.0, y0 + 2.0, side * 0.125, True)]
    rings = F.when(F.col("id") % 2 == 1, F.array(*first, *second)).otherwise(F.array(*first))
    return customers.select("id", F.posexplode(rings).alias("ord", "ring"))


def tile_points(spark: SparkSession, sf: str) -> DataFrame:
    """Every pixel at zooms 0 to 8, one in seven moved beyond the Mercator cut-off."""
    g = grid(spark, sf)
    beyond = (F.col("yi") * 100 + F.col("xi")) % 7 == 0
    lat = F.when(beyond, F.col("lat") + 61.5).otherwise(F.col("lat"))
    return g.select("yi", "xi", "lon", lat.alias("lat"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("z"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A lon/lat box per customer, two degrees and more wide, with a zoom of 4 to 8."""
    key = F.col("c_custkey")
    west = -124.8 + (key * SPREAD % 5500) / 100.0
    south = 24.4 + (key * 104729 % 2200) / 100.0
    return table(spark, sf, "customer").select(
        key.alias("box"), (key % 5 + 4).cast("int").alias("z"),
        west.alias("west"), south.alias("south"),
        (west + 2.0 + key % 3).alias("east"), (south + 1.5 + key % 2).alias("north"),
    )


def directory(spark: SparkSession, sf: str) -> DataFrame:
    """Delta-coded directory entries from the orders, a few hundred entries a directory."""
    key = F.col("o_custkey")
    return table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 50).cast("int").alias("dir"),
        F.col("o_orderkey").alias("ord"),
        (1 + key % 5).alias("delta"),
        (key % 4).cast("int").alias("run"),
        (100 + key % 50).alias("length"),
        F.when(key % 3 == 0, 1 + key * 10).otherwise(0).alias("offset_code"),
    )


def shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shard keys of every run, variable and pixel block with readings."""
    variables = F.explode(F.array(*[F.lit(v) for v in S.CUBE_VARIABLES]))
    keys = pixel_hours(spark, sf).select("run", "yb", "xb").distinct().select("run", "yb", "xb", variables.alias("variable"))
    return keys.select(
        "run", "variable",
        F.concat_ws("/", "variable", F.lit("c"), F.col("run"), F.col("yb"), F.col("xb")).alias("key"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """A window request per order: valid, reversed, half, unreadable, outside, long, empty."""
    key = F.col("o_orderkey")
    day = F.date_add(F.lit("2026-06-20").cast("date"), (key % 25).cast("int"))
    other = F.date_add(day, (key % 7).cast("int"))

    def request(d0: Column, d1: Column) -> Column:
        return F.concat(
            F.lit('{"d0":"'), F.date_format(d0, "yyyy-MM-dd"), F.lit('","d1":"'), F.date_format(d1, "yyyy-MM-dd"), F.lit('"}')
        )

    kind = F.floor(key / 4) % 8
    far = F.lit("2019-01-01").cast("date")
    body = (
        F.when(kind == 0, request(day, other))
        .when(kind == 1, request(other, day))
        .when(kind == 2, F.concat(F.lit('{"d0":"'), F.date_format(day, "yyyy-MM-dd"), F.lit('"}')))
        .when(kind == 3, F.lit("not json"))
        .when(kind == 4, request(far, other))
        .when(kind == 5, request(day, F.date_add(day, 13)))
        .when(kind == 6, request(F.date_sub(day, 40), F.date_add(day, 40)))
        .otherwise(F.lit("{}"))
    )
    return table(spark, sf, "orders").select(key.alias("req"), body.alias("body"))


def parameters() -> list[dict]:
    """The sweep: 4 half-lives x 3 thresholds x 3 flushes x 3 vents."""
    return [
        {"half_life": h, "threshold": thr, "flush": f, "vent": v}
        for h in (1.0, 12.0, 48.0, 72.0) for thr in (15.0, 27.0, 40.0)
        for f in (0.0, 0.5, 1.0) for v in (0.0, 0.3, 1.0)
    ]
