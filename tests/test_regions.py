"""Cells, polygons, tiles, directories: brute force on small fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexheat import functions as H
from hexheat.functions.cells import register_cell_udf
from hexheat.operators import fold, regions, sequences
from hexheat.plans import sql


def star(rng, x, y, n, spread):
    """A closed ring around (x, y)."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + spread * rng.uniform(0.2, 1) * math.cos(a), y + spread * rng.uniform(0.2, 1) * math.sin(a)) for a in angles]
    return [*ring, ring[0]]


def as_pieces(spark, polygons):
    rows = [(i, p, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for i, p, rings in polygons]
    return spark.createDataFrame(rows, "id string, part string, rings array<array<struct<x:double,y:double>>>")


def inside(rings, px, py):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > py) != (by > py) and ax + (py - ay) / (by - ay) * (bx - ax) > px:
                n += 1
    return n % 2 == 1


@pytest.fixture(scope="module")
def polygons():
    rng = random.Random(11)
    out = [(f"d{i % 5}", f"p{i}", [star(rng, rng.uniform(-110, -80), rng.uniform(28, 45), 9, 4.0)]) for i in range(12)]
    shell = [(-100, 30), (-90, 30), (-90, 40), (-100, 40), (-100, 30)]
    hole = [(-97, 33), (-97, 37), (-93, 37), (-93, 33), (-97, 33)]
    return [*out, ("holed", "h", [[tuple(map(float, v)) for v in r] for r in (shell, hole)])]


def test_points_in_polygons(spark, polygons):
    rng = random.Random(5)
    points = [(i, rng.uniform(-112, -78), rng.uniform(26, 47)) for i in range(1500)]
    got = regions.polyfill_center(
        regions.ring_edges(as_pieces(spark, polygons)), spark.createDataFrame(points, "k int, px double, py double"), ["k"]
    )
    want = {(k, i, p) for k, x, y in points for i, p, rings in polygons if inside(rings, x, y)}
    assert {tuple(r) for r in got.select("k", "id", "part").collect()} == want


def test_scan_line_fill_equals_testing_every_centre(spark, polygons):
    res = 4
    got = {tuple(r) for r in regions.polyfill_cells(regions.ring_edges(as_pieces(spark, polygons)), res).collect()}
    axes = spark.range(-400, 400).select(F.col("id").alias("q")).select("q", F.explode(F.sequence(F.lit(0), F.lit(300))).alias("r"))
    lat, lon = H.centre_of_axial(F.col("q"), F.col("r"), res)
    near = axes.select(H.id_of_axial(F.col("q"), F.col("r")).alias("cell"), lat.alias("lat"), lon.alias("lon")).where(
        "lat BETWEEN 22 AND 52 AND lon BETWEEN -118 AND -72"
    )
    centres = near.collect()
    want = {(i, p, c.cell) for c in centres for i, p, rings in polygons if inside(rings, c.lon, c.lat)}
    assert got == want and len(want) > 500


def test_centre_of_a_cell_is_in_the_cell(spark):
    axes = spark.range(-60, 60).select(F.col("id").alias("q")).select("q", F.explode(F.sequence(F.lit(-40), F.lit(40))).alias("r"))
    for res in (3, 6):
        cell = H.id_of_axial(F.col("q"), F.col("r"))
        lat, lon = H.cell_centre(F.col("cell"), res)
        wrong = axes.select(cell.alias("cell")).withColumns({"lat": lat, "lon": lon}).where(
            H.cell_of(F.col("lat"), F.col("lon"), res) != F.col("cell")
        )
        assert wrong.count() == 0


def test_cell_is_the_nearest_centre(spark):
    """On the projected plane, against all seven candidates."""
    res, rng = 4, np.random.default_rng(2)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(25, 49, 400), rng.uniform(-124, -67, 400))]
    df = spark.createDataFrame(rows, "lat double, lon double").withColumn("cell", H.cell_of(F.col("lat"), F.col("lon"), res))
    q, r = H.axial_of(F.col("cell"))
    from hexheat.functions.cells import COS0, EARTH_KM, edge_km
    s = edge_km(res)
    for row in df.select("lat", "lon", q.alias("q"), r.alias("r")).collect():
        x = EARTH_KM * COS0 * math.radians(row.lon)
        y = EARTH_KM / COS0 * math.sin(math.radians(row.lat))

        def far(dq, dr):
            return math.hypot(x - s * math.sqrt(3) * (row.q + dq + (row.r + dr) / 2), y - s * 1.5 * (row.r + dr))

        assert min(far(*d) for d in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))) >= far(0, 0)


def test_sql_functions_agree_with_column_functions(spark):
    sql.register_functions(spark)
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-60, 60, 500), rng.uniform(-170, 170, 500))]
    df = spark.createDataFrame(rows, "lat double, lon double")
    assert df.where(F.expr("cell_of(lat, lon, 5)") != H.cell_of(F.col("lat"), F.col("lon"), 5)).count() == 0
    assert df.select(F.expr("wind_speed(3e0, 4e0)")).first()[0] == 5.0


def test_a_hexagon_library_can_be_plugged_in(spark):
    register_cell_udf(spark, "other_cell", lambda lat, lon, res: (lat * 10).round() * 1000 + res)
    got = spark.sql("SELECT other_cell(12.3D, 4.0D, 6)").first()[0]
    assert got == 123006


def test_hex_text_of_ids(spark):
    df = spark.createDataFrame([(4398046511104,), (1,)], "cell bigint")
    assert [r[0] for r in df.select(H.cell_hex(F.col("cell"))).collect()] == ["40000000000", "1"]
    assert df.where(H.cell_from_hex(H.cell_hex(F.col("cell"))) != F.col("cell")).count() == 0


def test_hilbert_ids_are_dense_and_walk_to_neighbours(spark):
    for z in (0, 1, 3, 5):
        n = 1 << z
        grid = spark.range(n * n).select((F.col("id") % n).cast("int").alias("x"), F.floor(F.col("id") / n).cast("int").alias("y"))
        rows = grid.select("x", "y", H.hilbert_id(F.lit(z), F.col("x"), F.col("y")).alias("h")).orderBy("h").collect()
        base = (4 ** z - 1) // 3
        assert [r.h for r in rows] == list(range(base, base + n * n))
        assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_tiles_are_clamped_and_invert(spark):
    df = spark.createDataFrame([(-180.0, 89.0), (180.0, -89.0), (None, 1.0)], "lon double, lat double")
    got = [r[0] for r in df.select(H.lonlat_to_tile(F.col("lon"), F.col("lat"), F.lit(3))).collect()]
    assert [tuple(g) if g else None for g in got] == [(0, 0), (7, 7), None]
    spots = spark.createDataFrame([(-100.3, 41.2), (13.4, -52.5)], "lon double, lat double")
    tile = spots.withColumn("t", H.lonlat_to_tile(F.col("lon"), F.col("lat"), F.lit(9)))
    back = tile.withColumn("p", H.tile_to_lonlat(F.lit(9), F.col("t.x"), F.col("t.y"), F.lit(2048), F.lit(2048), F.lit(4096)))
    assert back.where("abs(p.lon - lon) > 0.36 OR abs(p.lat - lat) > 0.36").count() == 0


def test_zigzag(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "v int")
    assert [r[0] for r in df.select(H.zigzag(F.col("v"))).collect()] == [0, -1, 1, -2, 2, -3]


def test_region_text(spark):
    df = spark.createDataFrame([("US-TX", "", "a"), (None, "d", "a"), ("X", None, "a"), ("A-B-C", "d", "a")], "r string, d string, i string")
    assert [r[0] for r in df.select(H.region_suffix(F.col("r"))).collect()] == ["TX", "", "X", "B-C"]
    assert [r[0] for r in df.select(H.division_key(F.col("d"), F.col("i"))).collect()] == ["a", "d", "a", "d"]


def test_division_filter_keeps_a_missing_region(spark):
    ring = [[{"x": 0.0, "y": 0.0}]]
    rows = [
        ("d", "i", "n", "county", True, "US", None, "p", ring), ("", "j", "n", "county", True, "US", "US-TX", "p", ring),
        ("d", "k", "n", "county", None, "US", "US-TX", "p", ring), ("d", "l", "n", "county", True, "US", "US-AK", "p", ring),
        ("d", "m", "n", "county", True, "US", "US-TX", "p", []), ("d", "o", "n", "state", True, "US", "US-TX", "p", ring),
    ]
    from hexheat import schemas as S
    got = regions.filter_divisions(spark.createDataFrame(rows, S.PIECES)).select("id", "region").collect()
    assert sorted(tuple(r) for r in got) == [("d", ""), ("j", "TX")]


def test_islands(spark):
    blocks = spark.createDataFrame([(0, x) for x in (0, 1, 2, 5, 7, 8, 1)] + [(1, 4)], "yb int, xb int")
    got = sorted(tuple(r) for r in fold.block_spans(blocks).select("yb", "xb0", "xb1").collect())
    assert got == [(0, 0, 2), (0, 5, 5), (0, 7, 8), (1, 4, 4)]


def test_running_operators_do_not_depend_on_the_stretch(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", i * 3 + rng.randrange(3), rng.randrange(9), rng.choice([None, rng.randrange(99)])) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, o int, v int, w int")
    state, want = {}, {}
    for g, o, v, w in rows:
        total, last = state.get(g, (0, None))
        state[g] = total + v, w if w is not None else last
        want[g, o] = state[g]
    for width in (1, 4, 64, 10_000):
        summed = sequences.running_sum(df, ["g"], "o", {"s": "v"}, width)
        both = sequences.running_last(summed, ["g"], "o", F.col("w"), "last", width)
        assert {(r.g, r.o): (r.s, r.last) for r in both.collect()} == want


def test_delta_decode_and_cover_against_a_loop(spark):
    rng = random.Random(8)
    entries, keys, decoded = [], [], {}
    for d in range(3):
        at = end = 0
        for i in range(120):
            delta, run, length, code = rng.randrange(1, 6), rng.randrange(4), rng.randrange(1, 50), rng.choice([0, 0, rng.randrange(1, 999)])
            entries.append((d, i, delta, run, length, code))
            at += delta
            offset = end if code == 0 and i > 0 else code - 1
            end = offset + length
            decoded[d, i] = (at, run, length, offset)
        keys += [(d, k) for k in range(at + 9) for _ in range(1 + k % 3)]
    df = spark.createDataFrame(entries, "dir int, ord int, delta int, run int, length int, offset_code int")
    found = sequences.delta_decode(df, ["dir"], "ord", width=16)
    assert {(r.dir, r.ord): (r.id, r.run, r.length, r.offset) for r in found.collect()} == decoded

    def cover(d, key):
        before = [(i, r) for (dd, _), (i, r, _, _) in decoded.items() if dd == d and i <= key]
        if not before:
            return None, None
        i, r = max(before)
        return (i, r) if r == 0 or key - i < r else (None, None)

    asked = spark.createDataFrame(keys, "dir int, key int")
    for width in (8, 1 << 16):
        got = sequences.covering_run(found, asked, ["dir"], width).collect()
        assert len(got) == len(keys)
        assert all((r.id, r.run) == cover(r.dir, r.key) for r in got)


def test_an_open_run_is_the_longest(spark):
    entries = spark.createDataFrame([(0, 5, 0), (0, 5, 2), (0, 20, 3), (0, 20, 1)], "dir int, id long, run int")
    keys = spark.createDataFrame([(0, 10), (0, 22), (0, 23)], "dir int, key long")
    got = {r.key: (r.id, r.run) for r in sequences.covering_run(entries, keys, ["dir"]).collect()}
    assert got == {10: (5, 0), 22: (20, 3), 23: (None, None)}


def test_colours(spark):
    steps = spark.createDataFrame([(k / 255,) for k in (0, 128, 255)], "v double")
    ramp = H.ramp_rgb(F.col("v"), F.lit(0.0), F.lit(1.0), ("#000000", "#ff8000")).alias("c")
    assert [(r.r, r.g, r.b) for r in steps.select(ramp).select("c.*").collect()] == [(0, 0, 0), (128, 64, 0), (255, 128, 0)]
    df = spark.createDataFrame([(None,), (-5.0,), (99.0,)], "v double")
    got = df.select(H.ramp_rgb(F.col("v"), F.lit(0.0), F.lit(1.0), ("#000000", "#ff8000"), fade=True).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [(40, 44, 50, 60), (0, 0, 0, 60), (255, 128, 0, 235)]


def test_polyfill_in_sql_fills_where_the_polygons_are(spark):
    """LATERAL is the generator itself: no join of polygons with their cells, which was broadcast. Odd rings give what is there."""
    sql.register_functions(spark)
    square = [(-100.0, 40.0), (-97.0, 40.0), (-97.0, 43.0), (-100.0, 43.0), (-100.0, 40.0)]
    hole = [(-99.0, 41.0), (-99.0, 42.0), (-98.0, 42.0), (-98.0, 41.0), (-99.0, 41.0)]
    gap = [(-100.0, 40.0), (None, 40.5), (-97.0, 43.0), (-100.0, 43.0), (-100.0, 40.0)]
    rows = [(0, [square, hole]), (1, [square, hole]), (2, [square]), (3, []), (4, None), (5, [square, None]), (6, [gap]), (7, [[]]), (None, [square])]
    areas = spark.createDataFrame(rows, "id int, rings array<array<struct<x: double, y: double>>>")
    filled = spark.sql("SELECT id, c.cell FROM {areas}, LATERAL polyfill(rings, 4) c", areas=areas)
    assert "Join" not in filled._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in filled.collect():
        got.setdefault(r.id, []).append(r.cell)
    own = regions.polyfill_cells(regions.ring_edges(areas.where("id IN (0, 2, 6)").withColumn("part", F.lit("p"))), 4)
    want = {}
    for r in own.collect():
        want.setdefault(r.id, []).append(r.cell)
    assert sorted(got[0]) == sorted(got[1]) == sorted(want[0]) and sorted(got[2]) == sorted(got[None]) == sorted(want[2])
    assert not {3, 4, 5, 7} & set(got) and len(got[0]) < len(got[2])


def test_pairs_of_points_and_parts_are_never_shuffled(spark, polygons, monkeypatch):
    """Crossings are counted where a pair is made: nothing is joined or grouped by the part after points have met it."""
    points = spark.createDataFrame([(0, -95.0, 35.0)], "k int, px double, py double")
    edges = regions.ring_edges(as_pieces(spark, polygons))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = regions.polyfill_center(edges, points, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = next(n for n, line in enumerate(plan.splitlines()) if "Join" in line)
    assert plan.count("Join ") == 1 and not any("Aggregate" in line or "Exchange" in line for line in plan.splitlines()[:joined])


def test_edges_of_a_square_are_all_that_count(spark):
    """Corners on the lines of squares, a part listed twice (counted twice, so nowhere inside), NULL names and corners."""
    def ring(x, y, w):
        return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]

    rows = [("a", "p", [ring(-100.0, 30.0, 2.0)]), ("b", "p", [ring(-99.5, 30.5, 0.5)]), ("c", "q", [ring(-99.0, 30.0, 1.0)]),
            ("c", "q", [ring(-99.0, 30.0, 1.0)]), (None, "r", [ring(-100.0, 30.0, 2.0)]), ("d", None, [ring(-100.0, 30.0, 2.0)])]
    points = [(10 * i + j, -100.25 + 0.25 * i, 29.75 + 0.25 * j) for i in range(10) for j in range(10)] + [(100, None, 30.0)]
    edges = regions.ring_edges(as_pieces(spark, rows))
    got = regions.polyfill_center(edges, spark.createDataFrame(points, "k int, px double, py double"), ["k"])
    want = {(k, i, p) for k, x, y in points if x is not None for i, p, rings in rows[:2] if inside(rings, x, y)}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60
