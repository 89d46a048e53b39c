"""Drawing commands against a plain reader of the format."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hexheat.functions.geometry import decode_rings, encode_rings, to_zigzag
from hexheat.functions.tiles import zigzag

RINGS = "array<array<struct<x:bigint,y:bigint>>>"


def plain_encode(rings):
    out, x, y = [], 0, 0
    zz = lambda v: 2 * v if v >= 0 else -2 * v - 1
    for ring in rings:
        if len(ring) < 4:
            continue
        for k, (a, b) in enumerate(ring[:-1]):
            out += [9] if k == 0 else [(len(ring) - 2) * 8 + 2] if k == 1 else []
            out += [zz(a - x), zz(b - y)]
            x, y = a, b
        out.append(15)
    return out


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(8)
    def ring(n):
        points = [(r.randint(-5000, 5000), r.randint(-5000, 5000)) for _ in range(n)]
        return [*points, points[0]]
    out = [[ring(r.randint(3, 9)) for _ in range(r.randint(0, 5))] for _ in range(40)]
    return [*out, [], None, [ring(128)], [ring(129), ring(3)], [ring(5000)], [[(1, 1), (2, 2), (1, 1)], ring(3)]]


def test_rings_to_commands_and_back(spark, shapes):
    rows = [(i, None if s is None else [[{"x": x, "y": y} for x, y in ring] for ring in s]) for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, f"id int, rings {RINGS}").withColumn("commands", encode_rings(F.col("rings")))
    for r in df.withColumn("back", decode_rings(F.col("commands"))).collect():
        s = shapes[r.id]
        if s is None:
            assert r.commands is None and r.back is None
            continue
        assert r.commands == plain_encode(s)
        assert [[(p.x, p.y) for p in ring] for ring in r.back] == [ring for ring in s if len(ring) >= 4]


def test_streams_of_other_writers(spark):
    """Lines without a close draw no ring; a ring may be drawn by several line commands."""
    rows = [(0, [9, 4, 4, 18, 0, 16, 16, 0]), (1, [9, 6, 12, 10, 10, 12, 10, 24, 44, 15]), (2, [15]), (3, [9, 2, 2, 9, 6, 6, 18, 2, 2, 4, 4, 15])]
    got = {r.id: [[(p.x, p.y) for p in ring] for ring in r.back] for r in
           spark.createDataFrame(rows, "id int, c array<bigint>").select("id", decode_rings(F.col("c")).alias("back")).collect()}
    assert got == {0: [], 1: [[(3, 6), (8, 12), (20, 34), (3, 6)]], 2: [], 3: [[(4, 4), (5, 5), (7, 7), (4, 4)]]}


def test_zigzag_codes(spark):
    values = [0, -1, 1, -2, 2, 2**40, -(2**40), 2**62 - 1, -(2**62)]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("z", to_zigzag(F.col("v")))
    assert [(r.z, r.back) for r in df.withColumn("back", zigzag(F.col("z"))).collect()] == [(2 * v if v >= 0 else -2 * v - 1, v) for v in values]
