"""Every operator as a query over the test tables: name -> (spark, folder) -> DataFrame.

Values are rounded here, and only here, so that two engines can be compared.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hexheat import functions as H, schemas as S
from hexheat.functions.geometry import decode_rings, encode_rings
from hexheat.operators import accumulate, film, fold, outlines, regions, sequences, windowing
from hexheat.plans import mask, sql, week
from hexheat.session import broadcast_checked, dealt, measured, work_dir
from hexheat.sources import archive, curve, derived as D, landing, partials, sinks
from hexheat.streaming import streams, timed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUT = 0.4142
FILL_RES = 5
T0, T1 = datetime(2026, 6, 29), datetime(2026, 7, 5, 23)
MIDDLE = (-105.03, 31.02, -92.97, 39.98)
SHOWN_HOUR = datetime(2026, 7, 1, 21)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def r6(value: Column | str) -> Column:
    """Six decimals. The cut is off the middle: binary fractions end in a 5 at the seventh
    decimal, and the last bit of a sum must not decide their sixth."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value.cast("double") * 1e6 + CUT) / 1e6


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# ---- shared steps -------------------------------------------------------------------------

def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return fold.label_pixels(D.grid(spark, sf), D.RES)


EXTENTS: dict[tuple[str, str, int], tuple[str, str]] = {}


def extent(spark: SparkSession, sf: str) -> tuple[str, str]:
    """First and last day of the whole archive, found once a session and folder; the default window where it has no runs."""
    key = (spark.sparkContext.applicationId, sf, D.shape(spark, sf).runs)
    if key not in EXTENTS:
        EXTENTS[key] = _days(archive.run_extent(D.pixel_hours(spark, sf)))
    return EXTENTS[key]


def _days(found: DataFrame) -> tuple[str, str]:
    row = found.first()
    return (str(row.first_day), str(row.last_day)) if row.first_day else S.DEFAULT_WINDOW


def hour_span(spark: SparkSession, sf: str) -> tuple[datetime, datetime]:
    """First and last hour of the archive's days."""
    first, last = (datetime.fromisoformat(day) for day in extent(spark, sf))
    return first, last.replace(hour=23)


def folded(spark: SparkSession, sf: str, leads: int = S.LEADS_PER_RUN) -> DataFrame:
    cube = windowing.stitch(D.pixel_hours(spark, sf), *extent(spark, sf), leads)
    return fold.fold(cube, pixels(spark, sf))


def cell_hour(spark: SparkSession, sf: str) -> DataFrame:
    return fold.cell_hours(folded(spark, sf))


def heat(spark: SparkSession, sf: str) -> DataFrame:
    """The film of the whole archive."""
    return week.load_window(D.pixel_hours(spark, sf), pixels(spark, sf), *extent(spark, sf))


def load(spark: SparkSession, sf: str) -> DataFrame:
    return accumulate.sustained_heat(heat(spark, sf))


def parameters(spark: SparkSession) -> DataFrame:
    """The sweep's parameter table."""
    rows = [(i, *[float(p[c]) for c in accumulate.PARAMETERS]) for i, p in enumerate(D.parameters())]
    return spark.createDataFrame(rows, "param int, half_life double, threshold double, flush double, vent double")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that hold a pixel, in id order with their position."""
    return film.positions(pixels(spark, sf).select("cell").distinct(), "cell")


def counties(spark: SparkSession, sf: str) -> DataFrame:
    return regions.filter_divisions(D.features(spark, sf))


def land(spark: SparkSession, sf: str) -> DataFrame:
    """Land cells of all regions; the grid reaches out to sea, where blocks hold no land."""
    return mask.land_cells(D.divisions(spark, sf), D.RES)


def land_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return mask.pixel_lookup(D.grid(spark, sf), land(spark, sf), D.RES)


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    asked = windowing.parse_window(D.requests(spark, sf))
    return windowing.resolve_window(asked, runs(spark, sf))


CUBES: dict[tuple[str, str], str] = {}


def cube_path(spark: SparkSession, sf: str) -> str:
    """The readings written as an archive, once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in CUBES:
        path = work_dir(spark, "cube")
        archive.write_cube(D.pixel_hours(spark, sf), path)
        CUBES[key] = path
    return CUBES[key]


def stored_cube(spark: SparkSession, sf: str) -> DataFrame:
    return archive.scan_cube(spark, cube_path(spark, sf))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return archive.stored_runs(spark, cube_path(spark, sf))


# ---- fold and film ------------------------------------------------------------------------

@query
def fold_cell_hour(spark, sf):
    return rounded(cell_hour(spark, sf), "tc", "rh", "mm", "ws")


@query
def fold_two_fields(spark, sf):
    cube = windowing.stitch(D.pixel_hours(spark, sf), *extent(spark, sf))
    return rounded(fold.cell_hours(fold.fold(cube, pixels(spark, sf), rain=False, wind=False)), "tc", "rh")


@query
def fold_by_sql(spark, sf):
    sql.register_functions(spark)
    cube = windowing.stitch(D.pixel_hours(spark, sf), *extent(spark, sf))
    hours = sql.fold_sql(spark, cube, D.grid(spark, sf), D.RES).select(
        "cell", H.valid_time(F.col("init_ts"), F.col("lead_h")).alias("t"), "tc", "rh", "mm", "ws"
    )
    return rounded(hours, "tc", "rh", "mm", "ws")


@query
def heat_index_film(spark, sf):
    return rounded(heat(spark, sf).select("cell", "t", "hi"), "hi")


@query
def quantised_film(spark, sf):
    return heat(spark, sf).select("cell", "t", "hi_q")


@query
def packed_weather(spark, sf):
    code = F.col("wx_q")
    return heat(spark, sf).select(
        "cell", "t", "wx_q", H.unpack_wind(code).alias("ws"), H.unpack_rain(code).alias("mm")
    )


@query
def sustained_heat(spark, sf):
    return rounded(load(spark, sf).drop("hi_q", "wx_q"), "l")


@query
def sustained_heat_by_blocks(spark, sf):
    return rounded(accumulate.sweep_by_blocks(heat(spark, sf), [{}]).drop("param"), "l")


@query
def sustained_heat_raw(spark, sf):
    """From unquantised columns."""
    hours = cell_hour(spark, sf)
    raw = hours.withColumn("hi", H.heat_index_c(F.col("tc"), F.col("rh")).cast("float"))
    return rounded(accumulate.sustained_heat(raw, quantised=False), "l")


@query
def frame_means(spark, sf):
    """Both means from one pass: the recurrence carries the codes along."""
    means = load(spark, sf).groupBy("t").agg(*film.means(), *accumulate.means())
    return rounded(means, "mean_hi", "mean_load")


@query
def load_histogram(spark, sf):
    return accumulate.load_histogram(load(spark, sf))


@query
def load_ramp_top(spark, sf):
    return accumulate.load_ramp_top(load(spark, sf))


@query
def index_ramp(spark, sf):
    return rounded(film.index_ramp(heat(spark, sf)), "lo", "mid", "hi")


@query
def index_ramp_pinned(spark, sf):
    return rounded(film.index_ramp(heat(spark, sf), pivot=27.0), "lo", "mid", "hi")


@query
def film_extent(spark, sf):
    return rounded(film.extent(heat(spark, sf), "hi"), "lo", "hi")


@query
def cell_extents(spark, sf):
    shown = film.shown(load(spark, sf))
    return film.extent(shown, "load_shown", ["cell"], from_zero=True)


@query
def param_sweep(spark, sf):
    """Hourly means of the load for 108 parameter rows."""
    return rounded(accumulate.sweep_means(heat(spark, sf), parameters(spark)), "mean_load")


@query
def sweep_ramp_tops(spark, sf):
    return accumulate.ramp_top(accumulate.sweep_histogram(heat(spark, sf), parameters(spark)), ["param"])


@query
def film_pair(spark, sf):
    return week.heat_and_load(heat(spark, sf))


@query
def densified_film(spark, sf):
    return film.densify(heat(spark, sf).select("cell", "t", "hi_q"), cells(spark, sf), *hour_span(spark, sf))


@query
def indexed_film(spark, sf):
    f = heat(spark, sf)
    return film.index_film(f, film.frames(f), cells(spark, sf)).select("frame", "pos", "hi_q", "wx_q")


@query
def line_segments(spark, sf):
    dense = film.densify(heat(spark, sf).select("cell", "t", "hi_q"), cells(spark, sf), *hour_span(spark, sf))
    return film.line_segments(dense, "hi_q").groupBy("cell", "segment").agg(
        F.min("t").alias("t_first"), F.max("t").alias("t_last"), F.count("*").alias("n")
    )


@query
def day_breaks(spark, sf):
    return film.day_breaks(film.frames(heat(spark, sf)))


@query
def cell_series(spark, sf):
    """The first cell of the grid: its film alone goes through the recurrence."""
    labelled = pixels(spark, sf)
    first = labelled.agg(F.min("cell")).first()[0]
    one = week.load_window(D.pixel_hours(spark, sf), film.of_cell(labelled, first), *extent(spark, sf))
    return film.cell_series(film.pair(accumulate.sustained_heat(one)))


@query
def frame_snapshot(spark, sf):
    return film.frame_snapshot(heat(spark, sf), SHOWN_HOUR).select("cell", "t", "hi_q", "wx_q")


@query
def pick_points(spark, sf):
    key, (first, last) = F.col("o_orderkey"), hour_span(spark, sf)
    n_hours = int((last - first).total_seconds()) // 3600 + 1
    points = D.table(spark, sf, "orders").select(
        key,
        (24.4 + (F.col("o_custkey") * D.SPREAD % 2500) / 100.0).alias("lat"),
        (-124.8 + (key * 104729 % 5790) / 100.0).alias("lon"),
        F.timestamp_add("HOUR", key % n_hours, F.lit(str(first)).cast("timestamp_ntz")).alias("t"),
    )
    return film.pick(points, heat(spark, sf), D.RES).select("o_orderkey", "cell", "t", "hi_q")


@query
def ramp_rgb(spark, sf):
    both = film.shown(film.pair(load(spark, sf)))
    index = H.ramp_rgb(F.col("hi_shown"), F.lit(10.0), F.lit(76.5), S.INDEX_STOPS)
    sustained = H.ramp_rgb(F.col("load_shown"), F.lit(0.0), F.lit(3.8), S.LOAD_STOPS, fade=True)
    coloured = both.withColumns({"i": index, "l": sustained})
    return coloured.select("cell", "t", *[F.col(f"{f}.{c}").alias(f"{f}_{c}") for f in "il" for c in "rgba"])


@query
def value_labels(spark, sf):
    both = film.shown(film.pair(load(spark, sf)))
    return both.select(
        "cell", "t", H.hour_label(F.col("t")).alias("hour"),
        H.value_label(F.col("hi_shown")).alias("hi_label"),
        H.value_label(F.col("load_shown"), signed=True).alias("load_label"),
    )


@query
def code_round_trip(spark, sf):
    """Codes to degrees and back, over the film."""
    both = film.shown(film.pair(load(spark, sf)))
    return both.select(
        "cell", "t", H.quantise_hi(F.col("hi_shown")).alias("hi_again"),
        H.quantise_load(F.col("load_shown")).alias("load_again"),
        r6(H.f_to_c(H.c_to_f(F.col("hi_shown")))).alias("hi_back"),
    )


@query
def stage_stats(spark, sf):
    f = heat(spark, sf)
    return rounded(
        sinks.stage_stats(f, "film", ["hi", "t"]).unionByName(
            sinks.stage_stats(cell_hour(spark, sf).withColumn("hi", F.col("tc")), "cell_hour", ["hi", "t"])
        ), "min_hi", "max_hi",
    )


@query
def film_config(spark, sf):
    """The config row of a window's film, read back from its JSON: a row per hour label."""
    f = week.load_window(D.pixel_hours(spark, sf), pixels(spark, sf))
    request = spark.createDataFrame([(json.dumps(dict(zip(("d0", "d1"), S.DEFAULT_WINDOW))),)], "body string")
    asked = windowing.resolve_window(windowing.parse_window(request), runs(spark, sf))
    window = sinks.window_block(windowing.read_cost(asked, len(S.CUBE_VARIABLES)), runs(spark, sf))
    row = sinks.film_config(f, film.index_ramp(f), {"res": D.RES, "has_rain": True, "has_wind": True}, window)
    schema = (
        "labels array<string>, lo double, mid double, hi double, half_life double, res int, has_rain boolean, has_wind boolean, "
        "window struct<first_day string, last_day string, d0 string, d1 string, max_days int, cost string, sec_per_day double, leads int>"
    )
    read = row.select(F.from_json("config", schema).alias("c"))
    hours = read.select("c.*").select("*", "window.*", F.posexplode("labels").alias("frame", "label")).drop("labels", "window")
    return rounded(hours, "lo", "mid", "hi")


@query
def write_film(spark, sf):
    """The film as stored, read back for one hour."""
    path = work_dir(spark, "film")
    sinks.write_film(heat(spark, sf), path)
    return film.frame_snapshot(spark.read.parquet(path), SHOWN_HOUR).select("cell", "t", "hi_q", "wx_q")


@query
def write_dense_film(spark, sf):
    path = work_dir(spark, "dense")
    sinks.write_dense_film(heat(spark, sf), cells(spark, sf), path, *hour_span(spark, sf))
    return spark.read.parquet(path)


@query
def packed_frames(spark, sf):
    """The film's frames as bytes, a value an hour and field; told by their digests."""
    path = work_dir(spark, "dense")
    sinks.write_dense_film(heat(spark, sf), cells(spark, sf), path, *hour_span(spark, sf))
    packed = sinks.packed_frames(spark.read.parquet(path), width=512)
    return packed.select("frame", "n_cells", F.sha2("hi_q", 256).alias("hi_sha256"), F.sha2("wx_q", 256).alias("wx_sha256"))


@query
def fold_from_partials(spark, sf):
    """The fold from sums kept by day: a first question folds the first days, the next all others."""
    first, last = extent(spark, sf)
    early = str(partials.days_of(first, last)[:3][-1])
    path = partials.partials_path(work_dir(spark, "partials"), {"res": D.RES, "pixels": "all"})
    cube, lookup = stored_cube(spark, sf), pixels(spark, sf)
    partials.fold_from_partials(cube, lookup, path, first, early)
    hours = fold.cell_hours(partials.fold_from_partials(cube, lookup, path, first, last))
    return rounded(hours, "tc", "rh", "mm", "ws")


@query
def ramp_of_days(spark, sf):
    """The heat index ramp of the whole archive from counts kept by day."""
    path = work_dir(spark, "day-counts")
    partials.write_day_counts(heat(spark, sf), path)
    return rounded(partials.ramp_of_days(spark, path, "1970-01-01", "2100-01-01"), "lo", "mid", "hi")


@query
def memo_fold(spark, sf):
    memo = landing.FoldMemo()
    key = {"res": D.RES, "window": extent(spark, sf), "pixels": pixels(spark, sf).count(), "variables": S.CUBE_VARIABLES}
    first = memo.get(key, lambda: cell_hour(spark, sf))
    again = memo.get(key, lambda: first.where(F.lit(False)))
    counted = measured(again.groupBy("t").agg(F.count("*").alias("n")), "memo")
    memo.release()
    return counted


@query
def cached_table(spark, sf):
    base = work_dir(spark, "cache")
    key = {"release": S.FALLBACK_RELEASE, "zoom": S.DIVISION_ZOOM, "box": S.CONUS_BOX}
    landing.cached_table(spark, base, key, lambda: counties(spark, sf).drop("rings"))
    return landing.cached_table(spark, base, key, lambda: counties(spark, sf).where(F.lit(False)))


# ---- window -------------------------------------------------------------------------------

@query
def stitched_hours(spark, sf):
    cube = windowing.stitch(D.pixel_hours(spark, sf), "2026-06-30", "2026-07-03")
    t = H.valid_time(F.col("init_ts"), F.col("lead_h"))
    return cube.groupBy(t.alias("t")).agg(F.count("*").alias("n"), F.min("run").alias("run"))


@query
def stitch_union(spark, sf):
    """Two half archives read as one."""
    cube = D.pixel_hours(spark, sf)
    whole = windowing.stitch_union(cube.where(F.col("run") < 14), cube.where(F.col("run") >= 14))
    return whole.groupBy("run", "lead_h").agg(F.count("*").alias("n"))


@query
def scan_runs(spark, sf):
    return runs(spark, sf)


@query
def run_extent(spark, sf):
    return archive.run_extent(runs(spark, sf))


@query
def last_days(spark, sf):
    kept = measured(archive.last_days(runs(spark, sf), 3).select("run"), "runs")
    return stored_cube(spark, sf).join(broadcast_checked(kept), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"))


@query
def newest_reading(spark, sf):
    hours = cell_hour(spark, sf)
    return hours.groupBy("cell").agg(F.max("t").alias("t"), r6(F.max_by("tc", "t")).alias("tc"))


@query
def resolve_window(spark, sf):
    return resolved(spark, sf).drop("body")


@query
def resolve_last_days(spark, sf):
    asked = windowing.parse_window(D.requests(spark, sf))
    return windowing.resolve_window(asked, runs(spark, sf), default=5).drop("body")


@query
def films_of_requests(spark, sf):
    """Every request with what its film holds; one read of the archive for all."""
    requests = D.requests(spark, sf)
    resolved, films = week.films_of_requests(requests, runs(spark, sf), stored_cube(spark, sf), pixels(spark, sf))
    held = films.groupBy("d0", "d1").agg(
        F.count("*").alias("n_rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.sum("hi_q").alias("sum_hi_q"), F.sum("wx_q").alias("sum_wx_q"),
    )
    return resolved.drop("body", "n_runs", "t0", "t1").join(held, ["d0", "d1"], "left")


@query
def guard_resolution(spark, sf):
    """Cells without a pixel at each resolution up to the finest allowed: why finer ones are refused."""
    found = None
    for res in range(1, S.FINEST_RESOLUTION + 1):
        fold.guard_resolution(res)
        land_cells = mask.land_cells(D.divisions(spark, sf), res)
        held = fold.coverage(fold.label_pixels(D.grid(spark, sf), res), land_cells)
        row = held.agg(F.lit(res).alias("res"), F.count("*").alias("n_cells"), F.count_if(F.col("n_pixels") == 0).alias("n_empty"))
        found = row if found is None else found.union(row)
    return found


@query
def scan_grid(spark, sf):
    """The grid written and read as an archive keeps it."""
    path = work_dir(spark, "grid")
    D.grid(spark, sf).select(*S.GRID.fieldNames()).write.parquet(path)
    return rounded(archive.scan_grid(spark, path), "lat", "lon")


@query
def scan_pieces(spark, sf):
    """Division features written and read with typed properties."""
    path = work_dir(spark, "pieces")
    D.features(spark, sf).select(*S.PIECES.fieldNames()).write.parquet(path)
    kept = regions.filter_divisions(archive.scan_pieces(spark, path))
    return kept.select("id", "name", "region", "part", F.size("rings").alias("n_rings"))


@query
def read_cost(spark, sf):
    costed = windowing.read_cost(resolved(spark, sf), len(S.CUBE_VARIABLES))
    return costed.select("req", "n_days", "n_shards", "sec_per_day", "cost_s", "cost")


@query
def newest_run_wins(spark, sf):
    hours = windowing.newest_run(folded(spark, sf, leads=7), ["tc", "rh", "mm", "ws"])
    return rounded(hours, "tc", "rh", "mm", "ws")


# ---- mask ---------------------------------------------------------------------------------

@query
def filter_divisions(spark, sf):
    return counties(spark, sf).select("id", "name", "region", "part", F.size("rings").alias("n_rings"))


@query
def all_pieces(spark, sf):
    whole = regions.all_pieces(D.pieces(spark, sf), D.divisions(spark, sf), counties(spark, sf))
    return whole.select("id", "part", "region", F.size("rings").alias("n_rings"))


@query
def ring_edges(spark, sf):
    return rounded(regions.ring_edges(counties(spark, sf)), "x0", "y0", "x1", "y1")


@query
def ring_area(spark, sf):
    sized = D.raw_rings(spark, sf).select("id", "ord", regions.twice_area(F.col("ring")).alias("area2"))
    return sized.withColumn("is_exterior", F.col("area2") > 0)


@query
def ring_nesting(spark, sf):
    return regions.nest_rings(D.raw_rings(spark, sf)).select("id", "ord", "polygon", "is_hole")


@query
def explode_parts(spark, sf):
    """Divisions of two polygons, the second without its holes, taken apart."""
    parts = F.array("rings", F.slice("rings", 1, 1)).alias("parts")
    apart = regions.explode_parts(counties(spark, sf).select(F.col("part").alias("id"), parts))
    return apart.select("id", "part", F.size("rings").alias("n_rings"))


@query
def polyfill_center(spark, sf):
    edges = regions.ring_edges(D.divisions(spark, sf))
    return regions.polyfill_center(edges, D.mask_points(spark, sf), ["yi", "xi"]).drop("part")


@query
def polyfill_counties(spark, sf):
    """Pixels in parcels that overlap and have holes."""
    edges = regions.ring_edges(counties(spark, sf))
    return regions.polyfill_center(edges, D.mask_points(spark, sf), ["yi", "xi"])


@query
def polyfill_cells(spark, sf):
    edges = regions.ring_edges(counties(spark, sf))
    return regions.polyfill_cells(edges, FILL_RES)


@query
def polyfill_by_sql(spark, sf):
    """Cells of every polygon of every area, by table functions in SQL: areas of two polygons, taken apart and filled."""
    sql.register_functions(spark)
    areas = counties(spark, sf).select(F.col("part").alias("id"), F.array("rings", F.slice("rings", 1, 1)).alias("polygons"))
    # Nothing is shuffled after this, and a small file of areas would be one task.
    areas = areas.repartition(4 * spark.sparkContext.defaultParallelism)
    return spark.sql(
        "SELECT id, p.part, c.cell FROM {areas}, LATERAL parts(polygons) p, LATERAL polyfill(p.rings, :res) c", args={"res": FILL_RES}, areas=areas,
    )


@query
def dissolve_divisions(spark, sf):
    edges = regions.ring_edges(D.pieces(spark, sf))
    return regions.dissolve(regions.polyfill_center(edges, D.mask_points(spark, sf), ["yi", "xi"]), ["yi", "xi"])


@query
def outline_divisions(spark, sf):
    """Corners of the outline of every division, from its overlapping pieces: the seam is gone."""
    corners = outlines.union_outline(regions.ring_edges(D.pieces(spark, sf)))
    return rounded(corners.select("id", "x", "y"), "x", "y")


@query
def outline_cells(spark, sf):
    """Rings around the cells of every parcel: corners, and the cells they hold, less than none for a hole."""
    filled = regions.polyfill_cells(regions.ring_edges(counties(spark, sf)), FILL_RES)
    sized = outlines.ring_sizes(outlines.cell_outline(filled, FILL_RES, "part"), "part")
    n_cells = F.rint(F.col("area") / H.cell_area_km2(FILL_RES)).cast("bigint")
    return sized.select("part", "n_corners", n_cells.alias("n_cells"), "is_hole")


@query
def geometry_commands(spark, sf):
    """Rings of all areas as drawing commands on a fine grid, read back and measured."""
    def on_grid(v):
        return F.rint(v * 10_000).cast("bigint")

    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(on_grid(p["x"]).alias("x"), on_grid(p["y"]).alias("y"))))
    coded = D.features(spark, sf).select("id", encode_rings(rings).alias("commands"))
    read = coded.select("id", F.size("commands").alias("n_words"), F.posexplode(decode_rings(F.col("commands"))).alias("ord", "ring"))
    return read.select(
        "id", "n_words", "ord", F.size("ring").alias("n_points"), regions.twice_area(F.col("ring")).cast("bigint").alias("area2"),
        F.element_at("ring", 1)["x"].alias("x"), F.element_at("ring", 1)["y"].alias("y"),
    )


@query
def distinct_cells(spark, sf):
    return mask.land_cells(counties(spark, sf), FILL_RES)


@query
def cell_county(spark, sf):
    """Cells of all areas with position, county and label; areas that are no county give cells without one."""
    areas = D.features(spark, sf).where(F.size("rings") > 0).withColumn("id", H.division_key(F.col("division_id"), F.col("id")))
    divisions = regions.division_table(counties(spark, sf))
    placed = film.positions(mask.land_cells(areas, FILL_RES), "cell")
    named = film.cell_labels(regions.cell_county(placed, divisions), divisions)
    return regions.county_codes(named).select("cell", "pos", "id", "county_idx", "county_code", "label", "readout")


@query
def division_table(spark, sf):
    return regions.division_table(counties(spark, sf))


@query
def land_pixels(spark, sf):
    return land_lookup(spark, sf).select("yi", "xi", "cell")


@query
def land_blocks(spark, sf):
    kept = land_lookup(spark, sf)
    return kept.groupBy("yb", "xb").agg(F.count("*").alias("n_pixels"))


@query
def block_islands(spark, sf):
    return fold.block_spans(fold.land_blocks(land_lookup(spark, sf)))


@query
def block_of(spark, sf):
    """Storage blocks of the readings, at a block size that fits this grid."""
    cube = D.pixel_hours(spark, sf)
    return cube.groupBy(
        fold.block_of(F.col("yi"), 26).alias("block_y"), fold.block_of(F.col("xi"), 30).alias("block_x")
    ).agg(F.count("*").alias("n"))


@query
def prune_blocks(spark, sf):
    """Stored readings of land blocks, pruned while the job runs."""
    blocks = fold.land_blocks(land_lookup(spark, sf))
    kept = fold.prune_blocks(stored_cube(spark, sf), blocks)
    return kept.groupBy("yb", "xb").agg(F.count("*").alias("n"))


@query
def masked_fold(spark, sf):
    """The whole job on a stored archive: land pixels only, blocks pruned by island spans."""
    lookup = land_lookup(spark, sf)
    spans = fold.block_spans(fold.land_blocks(lookup))
    cube = fold.in_spans(stored_cube(spark, sf), spans)
    days = _days(archive.run_extent(runs(spark, sf)))
    return week.load_window(cube, lookup, *days).select("cell", "t", "hi_q", "wx_q")


@query
def fold_coverage(spark, sf):
    return fold.coverage(pixels(spark, sf), mask.land_cells(counties(spark, sf), D.RES))


@query
def cell_centres(spark, sf):
    placed = cells(spark, sf)
    lat, lon = H.cell_centre(F.col("cell"), D.RES)
    at = placed.withColumns({"lat": lat, "lon": lon}).withColumn("again", H.cell_of(F.col("lat"), F.col("lon"), D.RES))
    text = H.cell_hex(F.col("cell"))
    return rounded(
        at.select("cell", "pos", "lat", "lon", "again", text.alias("hex"), H.cell_from_hex(text).alias("from_hex")),
        "lat", "lon",
    )


# ---- tiles and directories ----------------------------------------------------------------

@query
def box_tiles(spark, sf):
    return regions.box_tiles(D.boxes(spark, sf))


@query
def box_of_readings(spark, sf):
    """Readings laid out along the curve, and those of one box: the middle of the grid."""
    path = work_dir(spark, "curve")
    at = D.grid(spark, sf).select("yi", "xi", "lon", "lat")
    curve.write_along_curve(D.pixel_hours(spark, sf).select("run", "lead_h", "yi", "xi").join(broadcast_checked(at), ["yi", "xi"]), path)
    return curve.read_box(spark, path, *MIDDLE).groupBy("yi", "xi").agg(F.count("*").alias("n"))


@query
def pixels_in_boxes(spark, sf):
    """Pixels in each of many boxes, met by their tiles."""
    boxes = D.boxes(spark, sf).select("box", "west", "south", "east", "north")
    # Well-packed pixels would be few tasks, and a place on the curve is some work.
    placed = dealt(D.grid(spark, sf), "yi", "xi").withColumn("place", curve.curve_place())
    return curve.in_boxes(placed, boxes, sums=["yi", "xi"])


@query
def box_intervals(spark, sf):
    """Stretches of the curve of each box."""
    return curve.box_intervals(D.boxes(spark, sf).select("box", "west", "south", "east", "north"), 6)


@query
def tile_points(spark, sf):
    at = H.lonlat_to_tile(F.col("lon"), F.col("lat"), F.col("z"))
    return D.tile_points(spark, sf).withColumn("tile", at).select("yi", "xi", "z", "tile.x", "tile.y")


@query
def tile_lonlat(spark, sf):
    at = H.lonlat_to_tile(F.col("lon"), F.col("lat"), F.col("z"))
    tiles = D.tile_points(spark, sf).withColumn("tile", at)
    back = H.tile_to_lonlat(F.col("z"), F.col("tile.x"), F.col("tile.y"), F.col("yi"), F.col("xi"), F.lit(4096))
    return rounded(tiles.withColumn("p", back).select("yi", "xi", "z", "p.lon", "p.lat"), "lon", "lat")


@query
def hilbert_ids(spark, sf):
    at = H.lonlat_to_tile(F.col("lon"), F.col("lat"), F.col("z"))
    tiles = D.tile_points(spark, sf).withColumn("tile", at)
    return tiles.select("yi", "xi", "z", H.hilbert_id(F.col("z"), F.col("tile.x"), F.col("tile.y")).alias("tile_id"))


@query
def delta_decode(spark, sf):
    return sequences.delta_decode(D.directory(spark, sf), ["dir"], "ord", width=1024)


@query
def covering_run(spark, sf):
    """The entry that covers each wanted tile: a wanted tile per line item."""
    entries = sequences.delta_decode(D.directory(spark, sf), ["dir"], "ord", width=1024)
    tops = measured(entries.groupBy("dir").agg(F.max("id").alias("top")), "tops")
    asked = D.table(spark, sf, "lineitem").withColumn("dir", (F.col("l_orderkey") % 50).cast("int"))
    at = (F.col("l_partkey") * D.SPREAD + F.col("l_orderkey")) % (F.col("top") + 8)
    keys = asked.join(broadcast_checked(tops), "dir").select("dir", at.alias("key"))
    found = sequences.covering_run(entries, keys, ["dir"], width=256)
    return found.groupBy("dir", "key", "id", "run").agg(F.count("*").alias("n"))


@query
def zigzag_moves(spark, sf):
    """Cursor positions of zigzag-coded moves, a path per directory."""
    moves = D.directory(spark, sf).select("dir", "ord", H.zigzag(F.col("length")).alias("dx"))
    return sequences.running_sum(moves, ["dir"], "ord", {"x": "dx"}, width=1024)


@query
def feature_properties(spark, sf):
    """Property maps from tag indexes into key and value tables."""
    f = D.features(spark, sf)
    keys = F.array(F.lit("subtype"), F.lit("country"), F.lit("@name"))
    values = F.array("name", "country", "subtype")
    props = archive.properties(keys, values, F.array(*[F.lit(i) for i in (0, 2, 1, 1, 2, 0)]))
    return f.withColumn("p", props).select(
        "id", F.col("p")["subtype"].alias("subtype"), F.col("p")["country"].alias("country"), F.col("p")["@name"].alias("name")
    )


# ---- landing and text ---------------------------------------------------------------------

@query
def landed_split(spark, sf):
    wanted = D.shards(spark, sf)
    return landing.split_landed(wanted, wanted.where(F.col("run") < 20), ["key"])


@query
def to_fetch(spark, sf):
    wanted = D.shards(spark, sf)
    return landing.to_fetch(wanted, wanted.where(F.col("run") < 20), ["key"])


@query
def already_landed(spark, sf):
    wanted = D.shards(spark, sf)
    return landing.already_landed(wanted, wanted.where(F.col("run") < 20), ["key"])


@query
def shard_names(spark, sf):
    key = F.col("key")
    return D.shards(spark, sf).select(
        "key", H.path_tail(key).alias("tail"), H.shard_index(key, S.CUBE_VARIABLES).alias("index"),
        H.shard_name(key, F.lit(None).cast("string")).alias("whole"), H.shard_name(key, F.col("variable")).alias("ranged"),
    )


@query
def latest_release(spark, sf):
    listing = D.table(spark, sf, "orders").select(
        F.concat(F.lit("tiles/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".0/")).alias("prefix")
    )
    return archive.latest_release(listing)


@query
def land_incremental(spark, sf):
    """Two landings of a growing archive, then what a reader sees and where it came from."""
    source, path = D.pixel_hours(spark, sf), work_dir(spark, "landing")
    landing.land_closed(spark, source.where(F.col("run") <= 20), path, newest=20)
    landing.land_closed(spark, source, path, newest=runs(spark, sf).agg(F.max("run")).first()[0])
    seen = landing.mirrored(spark, source, path)
    return seen.groupBy("run", "from_landing").agg(F.count("*").alias("n"), F.sum("xi").alias("sum_xi"))


@query
def division_labels(spark, sf):
    return D.features(spark, sf).select(
        F.col("id").alias("own_id"), H.region_suffix(F.col("region")).alias("suffix"),
        H.division_key(F.col("division_id"), F.col("id")).alias("key"),
        H.county_label(F.col("name"), H.region_suffix(F.col("region"))).alias("label"),
    )


@query
def hex_rgb(spark, sf):
    """Colour text of every order to channels."""
    text = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("o_orderkey") * D.SPREAD % 16777216)), 6, "0"))
    return D.table(spark, sf, "orders").select("o_orderkey", H.hex_rgb(text).alias("c")).select(
        "o_orderkey", "c.r", "c.g", "c.b"
    )


# ---- streams ------------------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    events = streams.read_files(spark, sf, streams.EVENT_SCHEMA, "events.parquet")
    wind, rain = F.col("event_id") % 11, F.col("event_id") % 7 * 0.5
    return events.select(F.col("user_id").alias("cell"), "ts", "value", wind.cast("double").alias("ws"), rain.cast("double").alias("mm"))


@query
def stream_fold(spark, sf):
    hours = streams.fold_events(spark, _event_stream(spark, sf), ["value"])
    return rounded(hours.withColumn("t", F.col("t").cast("timestamp_ntz")), "value")


@query
def stream_sustained(spark, sf):
    """The hourly fold of the events lands as files whose hours are mixed; the recurrence runs over those, a file a batch.

    After them come a file that lets go what is held, and one with an hour long past, which is late.
    """
    base = work_dir(spark, "stream-sustained")
    hours = f"{base}/hours"
    streams.drain(streams.stream_fold(_event_stream(spark, sf), ["value", "ws", "mm"]), f"{base}/folded", f"{base}/fold-checkpoint")
    folded = spark.read.schema(streams.HOUR_SCHEMA).parquet(f"{base}/folded")

    def run(rows: DataFrame, batches: int) -> None:
        """Lands rows as files spread by cell, and runs the stream over them in so many batches."""
        rows.write.mode("append").parquet(hours)
        n_files = len(spark.read.schema(streams.HOUR_SCHEMA).parquet(hours).inputFiles())
        stream = streams.read_files(spark, hours, streams.HOUR_SCHEMA, per_batch=-(-n_files // batches))
        steps = stream.select("cell", "t", F.col("value").alias("hi"), "ws", "mm")
        with streams.state_provider(spark):
            streams.drain(streams.stream_sustained(steps, hold_hours=24.0 * 45), f"{base}/load", f"{base}/load-checkpoint")

    run(folded.repartition(F.xxhash64("cell", "t")), 4)
    last = folded.groupBy("cell").agg((F.max("t") + F.expr("INTERVAL 60 DAYS")).alias("t"), F.min("t").alias("first"))
    run(last.drop("first"), 1)
    run(last.select("cell", F.col("first").alias("t"), F.lit(90.0).alias("value"), F.lit(0.0).alias("ws"), F.lit(0.0).alias("mm")), 1)
    every = spark.read.parquet(f"{base}/load")
    out = every.where("t IS NOT NULL").drop("late")
    late = every.groupBy("cell").agg(F.max("late").alias("late"))
    out = out.join(late, "cell")
    return rounded(out.withColumn("t", F.col("t").cast("timestamp_ntz")), "l")


@query
def stream_land(spark, sf):
    """Landing by a file stream, started twice: nothing lands twice."""
    base = work_dir(spark, "stream-land")
    archive.write_cube(D.pixel_hours(spark, sf), f"{base}/in")
    source = streams.read_files(spark, f"{base}/in", S.CUBE)
    for _ in range(2):
        streams.stream_land(source, f"{base}/landed", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/landed").groupBy("run").agg(F.count("*").alias("n"), F.sum("xi").alias("sum_xi"))


@query
def stream_released(spark, sf):
    """Sustained heat by event time: three landings of hours, out of order about the cuts, each a run from the checkpoint.

    Hours come out when the watermark has passed them; the last day is still held.
    """
    base = work_dir(spark, "stream-released")
    hours = f"{base}/hours"
    streams.drain(streams.stream_fold(_event_stream(spark, sf), ["value", "ws", "mm"]), f"{base}/folded", f"{base}/fold-checkpoint")
    folded = spark.read.schema(streams.HOUR_SCHEMA).parquet(f"{base}/folded")
    lo, hi = (F.unix_seconds(folded.agg(end("t")).scalar()) for end in (F.min, F.max))
    third = (hi - lo + 3600) / 3
    own = F.floor((F.unix_seconds("t") - lo) / third)
    near_cut = F.floor((F.unix_seconds("t") + 12 * 3600 - lo) / third)
    part = F.when(F.pmod(F.xxhash64("cell", "t"), F.lit(5)) == 0, F.least(near_cut, F.lit(2))).otherwise(own)
    marked = folded.withColumn("part", part)
    for k in range(3):
        marked.where(F.col("part") == k).drop("part").write.mode("append").parquet(hours)
        rows = streams.read_files(spark, hours, streams.HOUR_SCHEMA).select("cell", "t", F.col("value").alias("hi"), "ws", "mm")
        with streams.state_provider(spark):
            streams.drain(timed.stream_released(rows, "24 hours 30 minutes"), f"{base}/load", f"{base}/load-checkpoint")
    out = spark.read.parquet(f"{base}/load")
    return rounded(out.withColumn("t", F.col("t").cast("timestamp_ntz")), "l")


@query
def stream_corrections(spark, sf):
    """The hourly fold of all events in a table that late ones correct: a fifth of them come in a second landing."""
    base = work_dir(spark, "stream-corrections")
    events = D.table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    schema = events.schema
    for late in (False, True):
        events.where((F.col("event_id") % 5 == 0) == late).write.mode("append").parquet(f"{base}/events")
        readings = streams.read_files(spark, f"{base}/events", schema).withColumnRenamed("user_id", "cell")
        timed.fold_with_corrections(readings, ["value"], f"{base}/table", f"{base}/checkpoint", "60 days")
    table = timed.folded_so_far(spark, f"{base}/table")
    return rounded(table.withColumn("t", F.col("t").cast("timestamp_ntz")), "value")


@query
def stream_land_closed(spark, sf):
    """Landing by a stream that holds the newest run back: three landings, some rows after their run has closed."""
    base = work_dir(spark, "stream-land-closed")
    readings = D.pixel_hours(spark, sf).select("run", "lead_h", "xi")
    part = F.when(F.col("run") >= 20, 2).when((F.col("run") >= 10) | (F.col("lead_h") == 3), 1).otherwise(0)
    for k in range(3):
        readings.where(part == k).write.mode("append").parquet(f"{base}/in")
        source = streams.read_files(spark, f"{base}/in", readings.schema)
        timed.land_closed_stream(source, f"{base}/landed", f"{base}/checkpoint")
    landed = timed.landed_stream(spark, f"{base}/landed")
    return landed.groupBy("run").agg(F.count("*").alias("n"), F.sum("xi").alias("sum_xi"))
