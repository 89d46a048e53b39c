"""Outlines of cells and of overlapping pieces against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hexheat.functions import cell_area_km2, id_of_axial
from hexheat.operators import outlines, regions


def ring(x0, y0, x1, y1, hole=False):
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    corners = corners[::-1] if hole else corners
    return [{"x": float(x), "y": float(y)} for x, y in [*corners, corners[0]]]


def pieces(spark, rows):
    return spark.createDataFrame(rows, "id string, part string, rings array<array<struct<x:double,y:double>>>")


def by_ring(df):
    out = defaultdict(list)
    for r in df.orderBy("id", "ring", "place").collect():
        out[r.id, r.ring].append((r.x, r.y))
    return out


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], points[0]])) / 2


def turned(points):
    """Corners from the least on, in their order."""
    k = points.index(min(points))
    return points[k:] + points[:k]


def test_cells_with_a_hole_and_an_island(spark):
    block = [(q, r) for q in range(-3, 4) for r in range(-3, 4) if abs(q + r) <= 3]
    a = [("a", q, r) for q, r in block if (q, r) != (0, 0)]
    rows = [*a, a[0], ("a", 20, 20), ("b", 5, 5), ("b", 6, 5)]
    cells = spark.createDataFrame(rows, "id string, q int, r int").select("id", id_of_axial(F.col("q"), F.col("r")).alias("cell"))
    sizes = outlines.ring_sizes(outlines.cell_outline(cells, 5)).collect()
    one = cell_area_km2(5)
    got = sorted((r.id, r.n_corners, round(r.area / one, 6), r.is_hole) for r in sizes)
    assert got == [("a", 6, -1.0, True), ("a", 6, 1.0, False), ("a", 42, 37.0, False), ("b", 10, 2.0, False)]


def test_outline_of_random_cells_has_their_area(spark):
    r = random.Random(3)
    rows = {(f"d{k}", r.randrange(12), r.randrange(12)) for k in range(4) for _ in range(80)}
    cells = spark.createDataFrame(sorted(rows), "id string, q int, r int").select("id", id_of_axial(F.col("q"), F.col("r")).alias("cell"))
    corners = outlines.cell_outline(cells, 4)
    got = defaultdict(float)
    for points in by_ring(corners).items():
        got[points[0][0]] += area(points[1]) / cell_area_km2(4)
        assert len(set(points[1])) == len(points[1])
    n = defaultdict(int)
    for i, *_ in rows:
        n[i] += 1
    assert {i: round(v, 6) for i, v in got.items()} == dict(n)
    no_cells = outlines.cell_outline(cells.where("false"), 4)
    assert no_cells.count() == 0


@pytest.mark.parametrize("most", [0, 30, 1 << 16])
def test_keys_linked_in_a_task_and_by_doubling_are_alike(spark, monkeypatch, most):
    """Sets over many blocks, rings that touch in a corner, keys that batches cut; written rounds only for large keys."""
    monkeypatch.setattr(outlines, "MOST_EDGES", most)
    monkeypatch.setattr(outlines, "BLOCK_CELLS", 3)
    written, write = [], outlines.measured
    monkeypatch.setattr(outlines, "measured", lambda df, name: written.append(name) or write(df, name))
    r = random.Random(8)
    rows = {(f"d{k}", r.randrange(-5, 15), r.randrange(-5, 15)) for k in range(6) for _ in range(4 << k)}
    cells = spark.createDataFrame([*sorted(rows), (None, 0, 0)], "id string, q int, r int").select("id", id_of_axial(F.col("q"), F.col("r")).alias("cell"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = by_ring(outlines.cell_outline(cells, 4))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    n, total = defaultdict(int), defaultdict(float)
    for i, *_ in rows:
        n[i] += 1
    for (i, _), points in got.items():
        total[i] += area(points) / cell_area_km2(4)
        step = [(a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 for a, b in zip(points, [*points[1:], points[0]])]
        assert len(points) >= 6 and max(step) < 1.01 * min(step)
    assert {i: round(v, 6) for i, v in total.items()} == dict(n)
    assert ("rings" in written) == (most < 100)


def test_seams_shared_edges_and_holes(spark):
    rows = [
        ("over", "w", [ring(0, 0, 6, 4)]), ("over", "e", [ring(5.8, 0, 12, 4)]),
        ("touch", "w", [ring(0, 0, 2, 2)]), ("touch", "e", [ring(2, 0, 4, 2)]),
        ("hole", "whole", [ring(0, 0, 9, 9), ring(3, 3, 6, 6, hole=True)]), ("hole", "cover", [ring(5, 2, 7, 5)]),
        ("apart", "a", [ring(0, 0, 1, 1)]), ("apart", "b", [ring(3, 3, 4, 4)]), ("twice", "a", [ring(0, 0, 1, 1)]), ("twice", "b", [ring(0, 0, 1, 1)]),
        ("corner", "a", [ring(0, 0, 1, 1)]), ("corner", "b", [ring(1, 1, 2, 2)]), ("inner", "a", [ring(0, 0, 9, 9)]), ("inner", "b", [ring(2, 2, 3, 3)]),
        ("none", "a", []),
    ]
    got = defaultdict(list)
    for (i, _), points in by_ring(outlines.union_outline(regions.ring_edges(pieces(spark, rows)))).items():
        got[i].append(turned(points))
    rect = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    assert {i: sorted(v) for i, v in got.items()} == {
        "over": [rect(0, 0, 12, 4)], "touch": [rect(0, 0, 4, 2)], "apart": [rect(0, 0, 1, 1), rect(3, 3, 4, 4)], "twice": [rect(0, 0, 1, 1)],
        "corner": [rect(0, 0, 1, 1), rect(1, 1, 2, 2)], "inner": [rect(0, 0, 9, 9)],
        "hole": sorted([rect(0, 0, 9, 9), [(3, 3), (3, 6), (6, 6), (6, 5), (5, 5), (5, 3)]]),
    }


@pytest.mark.parametrize("seed", range(3))
def test_union_of_random_rectangles(spark, seed):
    """Area and signs against a raster of unit squares."""
    r = random.Random(seed)
    rows, filled = [], defaultdict(set)
    for i in range(12):
        for k in range(r.randint(1, 7)):
            x, y = r.randrange(14), r.randrange(14)
            w, h = r.randint(1, 6), r.randint(1, 6)
            rows.append((f"d{i}", f"p{k}", [ring(x, y, x + w, y + h)]))
            filled[f"d{i}"] |= {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
    got = defaultdict(float)
    for (i, _), points in by_ring(outlines.union_outline(regions.ring_edges(pieces(spark, rows)))).items():
        got[i] += area(points)
        assert all(a[0] == b[0] or a[1] == b[1] for a, b in zip(points, points[1:]))
    assert {i: round(v, 6) for i, v in got.items()} == {i: len(v) for i, v in filled.items()}


def test_union_of_slanted_pieces(spark):
    """Two triangles that cross in four places."""
    rows = [("star", "up", [[{"x": x, "y": y} for x, y in [(0.0, 0.0), (6.0, 0.0), (3.0, 6.0), (0.0, 0.0)]]]),
            ("star", "down", [[{"x": x, "y": y} for x, y in [(0.0, 4.0), (3.0, -2.0), (6.0, 4.0), (0.0, 4.0)]]])]
    rings = by_ring(outlines.union_outline(regions.ring_edges(pieces(spark, rows))))
    (points,) = rings.values()
    assert len(points) == 12 and area(points) == pytest.approx(24.0, abs=1e-5)
