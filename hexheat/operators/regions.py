"""Land regions: filters, rings, point in polygon, cell fill, dissolve and names.

Every polygon test is the half-open crossing rule: an edge counts for a point when one end is
above the point and the other is not, and the edge lies to the right. An odd count is inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexheat import schemas as S
from hexheat.functions import (
    centre_of_axial, county_label, division_key, edge_km, id_of_axial, region_suffix,
)
from hexheat.functions.cells import COS0, EARTH_KM, ROOT3
from hexheat.operators.film import positions
from hexheat.operators.sequences import running_last
from hexheat.session import broadcast_checked, dealt


def filter_divisions(pieces: DataFrame, exclude: tuple[str, ...] = S.EXCLUDED_REGIONS) -> DataFrame:
    """County pieces on land in the contiguous US, with key, name and two-letter region."""
    region = region_suffix(F.col("region"))
    kept = pieces.where(
        (F.col("subtype") == "county")
        & F.col("is_land").eqNullSafe(True)
        & (F.col("country") == "US")
        & (F.size("rings") > 0)
    ).withColumn("region", region)
    return kept.where(~F.col("region").isin(*exclude)).select(
        division_key(F.col("division_id"), F.col("id")).alias("id"), "name", "region", "part", "rings"
    )


def all_pieces(*frames: DataFrame) -> DataFrame:
    """Pieces of every tile in one table."""
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def twice_area(ring: Column) -> Column:
    """Twice the signed shoelace area of a closed ring."""
    tips = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    tails = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    terms = F.zip_with(tails, tips, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)


def nest_rings(rings: DataFrame) -> DataFrame:
    """Give each ring its polygon: a positive ring opens one, the negative ones after it are holes.

    Holes before any exterior belong nowhere and are dropped.
    """
    sized = rings.withColumn("area2", twice_area(F.col("ring")))
    opener = F.when(F.col("area2") > 0, F.col("ord"))
    nested = running_last(sized, ["id"], "ord", opener, "polygon")
    return nested.where(F.col("polygon").isNotNull()).withColumn(
        "is_hole", F.col("ord") != F.col("polygon")
    )


def explode_parts(divisions: DataFrame) -> DataFrame:
    """One row per polygon of a division that lists several: `parts` is an array of ring lists."""
    return divisions.select("id", F.posexplode("parts").alias("part", "rings"))


def ring_edges(pieces: DataFrame) -> DataFrame:
    """Consecutive vertex pairs of closed rings: `id, part, x0, y0, x1, y1`."""
    rings = pieces.select("id", "part", F.explode("rings").alias("ring"))
    n = F.greatest(F.size("ring") - 1, F.lit(0))
    pairs = F.arrays_zip(
        F.slice("ring", F.lit(1), n).alias("a"), F.slice("ring", F.lit(2), n).alias("b")
    )
    return rings.select("id", "part", F.explode(pairs).alias("e")).select(
        "id", "part",
        F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"),
        F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"),
    )


def _ends(edge: Column | None) -> list[Column]:
    return [F.col(c) if edge is None else edge[c] for c in ("x0", "y0", "x1", "y1")]


def crosses(py: Column, edge: Column | None = None) -> Column:
    """Edge, a row's or a struct, spans the horizontal through py, upper end open."""
    _, y0, _, y1 = _ends(edge)
    return (y0 > py) != (y1 > py)


def crossing_x(py: Column, edge: Column | None = None) -> Column:
    """Where a spanning edge meets the horizontal through py."""
    x0, y0, x1, y1 = _ends(edge)
    return x0 + (py - y0) / F.nullif(y1 - y0, F.lit(0.0)) * (x1 - x0)


def polyfill_cells(edges: DataFrame, res: int) -> DataFrame:
    """Cells whose centre lies in each part, by scan line: `id, part, cell`.

    Hexagon centres lie in rows of equal latitude. Each edge is cut by the rows it spans, the
    cuts of a row are ordered and paired, and each pair is filled with the centres between. The
    work is edges times rows crossed plus cells found; no point is ever compared with an edge
    it cannot meet. A huge polygon is spread over its rows.
    """
    s = edge_km(res)

    def row_of(lat: Column) -> Column:
        return F.sin(F.radians(lat)) * (EARTH_KM / COS0) / (1.5 * s)

    rows = F.sequence(
        F.floor(row_of(F.least("y0", "y1"))).cast("int"), F.ceil(row_of(F.greatest("y0", "y1"))).cast("int")
    )
    row_lat, _ = centre_of_axial(F.lit(0), F.col("r"), res)
    cuts = (
        edges.where(F.col("y0") != F.col("y1"))
        .withColumn("r", F.explode(rows)).withColumn("lat", row_lat)
        .where(crosses(F.col("lat")))
        .select("id", "part", "r", "lat", crossing_x(F.col("lat")).alias("from_x"))
    )
    along = Window.partitionBy("id", "part", "r").orderBy("from_x")
    spans = (
        cuts.withColumns({"n": F.row_number().over(along), "to_x": F.lead("from_x").over(along)})
        .where(F.col("n") % 2 == 1)
    )

    def column_of(lon: Column) -> Column:
        return F.radians(lon) * (EARTH_KM * COS0) / (s * ROOT3) - F.col("r") / 2.0

    columns = F.sequence(
        F.floor(column_of(F.col("from_x"))).cast("int"), F.ceil(column_of(F.col("to_x"))).cast("int")
    )
    _, lon = centre_of_axial(F.col("q"), F.col("r"), res)
    filled = spans.withColumn("q", F.explode(columns)).withColumn("lon", lon)
    inside = (F.col("lon") >= F.col("from_x")) & (F.col("lon") < F.col("to_x"))
    return filled.where(inside).select("id", "part", id_of_axial(F.col("q"), F.col("r")).alias("cell"))


SQUARE_DEG = 0.5
# More than a crossing can lie beyond the ends of its edge by rounding.
ROUNDING_DEG = 1e-6


def _steps(lo: Column, hi: Column, width: float) -> Column:
    return F.sequence(F.floor(lo / width).cast("int"), F.floor(hi / width).cast("int"))


def polyfill_center(edges: DataFrame, points: DataFrame, key: list[str]) -> DataFrame:
    """Which part holds each point (`px, py`, known by `key`): `key, id, part`.

    One equi join: a point meets the parts whose bounding box shares its half-degree square, and each of those
    brings the edges that a point of the square can count, so crossings are counted where the pair is made and no
    pair is shuffled. `key` must identify a point, so repeated readings of one place are to be made distinct first.
    """
    box = edges.where(F.col("id").isNotNull() & F.col("part").isNotNull()).groupBy("id", "part").agg(
        F.min(F.least("x0", "x1")).alias("west"), F.max(F.greatest("x0", "x1")).alias("east"),
        F.min(F.least("y0", "y1")).alias("south"), F.max(F.greatest("y0", "y1")).alias("north"),
        F.collect_list(F.when(F.col("y0") != F.col("y1"), F.struct("x0", "y0", "x1", "y1"))).alias("edges"),
    )
    # The edges of a row of squares first, then of each square of the row; those to its left are never counted.
    rows = box.withColumn("sy", F.explode(_steps(F.col("south"), F.col("north"), SQUARE_DEG))).withColumn("edges", F.filter("edges", lambda e: (
        (F.greatest(e["y0"], e["y1"]) >= F.col("sy") * SQUARE_DEG) & (F.least(e["y0"], e["y1"]) <= (F.col("sy") + 1) * SQUARE_DEG)
    )))
    squares = rows.withColumn("sx", F.explode(_steps(F.col("west"), F.col("east"), SQUARE_DEG))).withColumn("edges", F.filter("edges", lambda e: (
        F.greatest(e["x0"], e["x1"]) >= F.col("sx") * SQUARE_DEG - ROUNDING_DEG
    )))
    placed = points.select(*key, "px", "py").withColumns({
        "sx": F.floor(F.col("px") / SQUARE_DEG).cast("int"),
        "sy": F.floor(F.col("py") / SQUARE_DEG).cast("int"),
    })
    # Guessed from the file of areas, the squares would seem small, and be broadcast however many they are.
    near = placed.join(dealt(squares, "sx", "sy").hint("merge"), ["sx", "sy"]).where(
        F.col("px").between(F.col("west"), F.col("east")) & F.col("py").between(F.col("south"), F.col("north"))
    )
    px, py = F.col("px"), F.col("py")
    counted = F.filter("edges", lambda e: crosses(py, e) & (crossing_x(py, e) > px))
    return near.where(F.size(counted) % 2 == 1).select(*key, "id", "part")


def dissolve(parts: DataFrame, key: list[str]) -> DataFrame:
    """Pieces of one division become one region: the union of what each piece holds."""
    return parts.select("id", *key).distinct()


def distinct_cells(filled: DataFrame) -> DataFrame:
    """One division per cell. Where regions overlap, the least id, so reruns agree."""
    return filled.groupBy("cell").agg(F.min("id").alias("id"))


def division_table(pieces: DataFrame) -> DataFrame:
    """Divisions with the name and region of their first part, numbered in id order."""
    named = pieces.groupBy("id").agg(
        F.min_by("name", "part").alias("name"), F.min_by("region", "part").alias("region")
    )
    return positions(named, "id", "county_idx").withColumn(
        "label", county_label(F.col("name"), F.col("region"))
    )


def cell_county(cells: DataFrame, divisions: DataFrame) -> DataFrame:
    """County index per cell, NULL for a cell whose division is unknown."""
    return cells.join(broadcast_checked(divisions.select("id", "county_idx")), "id", "left")


def county_codes(cells: DataFrame) -> DataFrame:
    """The index as a binary reader wants it: 65535 for none."""
    return cells.withColumn("county_code", F.coalesce("county_idx", F.lit(S.NO_COUNTY)))


def box_tiles(boxes: DataFrame) -> DataFrame:
    """Every tile that a box touches at its zoom: `box, z, x, y`."""
    from hexheat.functions import lonlat_to_tile

    corners = boxes.withColumns({
        "nw": lonlat_to_tile(F.col("west"), F.col("north"), F.col("z")),
        "se": lonlat_to_tile(F.col("east"), F.col("south"), F.col("z")),
    })
    return tile_grid(corners, F.col("nw.x"), F.col("se.x"), F.col("nw.y"), F.col("se.y"), ["box", "z"])


def tile_grid(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column, keep: list[str]) -> DataFrame:
    """All (x, y) of a rectangle of tiles, per row."""
    wide = df.withColumns({"ys": F.sequence(y0, y1), "x": F.explode(F.sequence(x0, x1))})
    return wide.select(*keep, "x", F.explode("ys").alias("y"))

