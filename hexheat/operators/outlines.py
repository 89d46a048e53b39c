"""Outlines: the boundary of a set of cells, or of regions given as pieces that overlap, as closed rings.

Both ways end alike. What lies inside is cancelled edge by edge, by grouping on the edge itself; what is left is a set
of directed edges with the inside on their left, and those are linked to rings by pointer doubling: in each round
every edge learns from the edge that it points to, and then points twice as far. A ring of n edges takes log2(n)
rounds of one equi join, wherever its edges lie; no ring is gathered in one task.

Exteriors run counterclockwise and have positive area, holes clockwise and negative.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexheat.functions import axial_of, edge_km
from hexheat.functions.cells import COS0, EARTH_KM, ROOT3
from hexheat.operators.regions import polyfill_center
from hexheat.session import dealt, measured

# Corners of a cell from its centre, counterclockwise, in thirds of the axes.
CORNERS = ((-1, 2), (-2, 1), (-1, -1), (1, -2), (2, -1), (1, 1))
# Corners of polygons lie on a grid of this many steps a degree, about a centimetre, so that they can be joined on.
STEPS_PER_DEG = 10**7
# Squares in which edges that may meet are looked for.
SQUARE_DEG = 0.5
# A corner this near to an edge, in steps, lies on it.
NEAR = 1.5


def _corner(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def doubled(edges: DataFrame, key: str) -> DataFrame:
    """`edges` (numbers `edge`, `next`) with `ring`, the least edge number of the ring, and `place` along it from 0.

    `next` must lead round closed rings. Every round is a written table, so a lost executor costs one round.
    """
    state = measured(edges.select(
        key, "edge", F.col("next").alias("to"), F.struct(F.col("edge").alias("ring"), F.lit(0).cast("bigint").alias("ahead")).alias("near"),
    ), "rings")
    reach = 1
    while True:
        far = state.select(key, F.col("edge").alias("to"), F.col("to").alias("on"), F.col("near").alias("theirs"))
        theirs = F.struct(F.col("theirs.ring").alias("ring"), (F.col("theirs.ahead") + reach).alias("ahead"))
        after = measured(state.join(far, [key, "to"]).select(
            key, "edge", F.col("on").alias("to"), F.least("near", theirs).alias("near"),
            (F.col("near.ring") != F.least("near", theirs)["ring"]).alias("changed"),
        ), "rings")
        if after.where("changed").isEmpty():
            break
        state, reach = after.drop("changed"), 2 * reach
    sizes = after.groupBy(key, F.col("near.ring").alias("ring")).agg(F.count("*").alias("n"))
    placed = after.select(key, "edge", F.col("near.ring").alias("ring"), F.col("near.ahead").alias("ahead")).join(sizes, [key, "ring"])
    return placed.select(key, "edge", "ring", F.pmod(F.col("n") - F.col("ahead"), F.col("n")).alias("place"))


# A key with up to so many edges is linked in one task, one with more by pointer doubling.
MOST_EDGES = 1 << 16


def stitched(edges: DataFrame, key: str) -> DataFrame:
    """Directed edges (`key, ax, ay, bx, by`) as rings: the same rows with `ring` and `place`.

    Where several edges leave a corner, each edge that arrives goes on with the one that turns most to the left, so
    rings that touch in a corner stay apart.
    """
    own = measured(edges.where(F.col(key).isNotNull()).withColumn("edge", F.monotonically_increasing_id()), "edges")
    # Few: each has MOST_EDGES rows of the table.
    large = measured(own.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > MOST_EDGES).select(key), "large")
    if large.isEmpty():
        return _linked(own, key)
    small, rest = (own.join(F.broadcast(large), key, how) for how in ("left_anti", "left_semi"))
    return _linked(small, key).unionByName(_linked_by_doubling(rest, key))


def _linked_by_doubling(own: DataFrame, key: str) -> DataFrame:
    leaving = own.select(
        key, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("edge").alias("next"), F.col("bx").alias("cx"), F.col("by").alias("cy"),
    )
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    out = F.atan2(F.col("cy") - F.col("by"), F.col("cx") - F.col("bx"))
    # Clockwise from the way back, the first edge that is met turns most to the left.
    turn = F.pmod(back - out, F.lit(2 * math.pi))
    turn = F.when(turn < 1e-12, 2 * math.pi).otherwise(turn)
    linked = own.join(leaving, [key, "bx", "by"]).groupBy(key, "edge").agg(F.min_by("next", turn).alias("next"))
    return own.join(doubled(linked, key), [key, "edge"]).drop("edge")


def _linked(own: DataFrame, key: str) -> DataFrame:
    """The same for keys whose edges fit a task: keys stream past in Arrow batches, all whole keys of a batch at once."""
    types = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    fields = [f"`{c}` {types[c]}" for c in (key, "ax", "ay", "bx", "by")]
    ordered = dealt(own.select(key, "ax", "ay", "bx", "by", "edge"), key).sortWithinPartitions(key, "edge")
    return ordered.mapInArrow(_linker(key), ", ".join([*fields, "ring bigint", "place bigint"]))


def _linker(key: str) -> Callable[[Iterator], Iterator]:
    """Links and doubling as above, in arrays. Self-contained, so workers need not have this package."""

    def link(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def firsts(*columns):
            return np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))

        def rings(table: pa.Table, group: np.ndarray) -> pa.Table:
            n = len(group)
            ax, ay, bx, by, edge = (table.column(c).to_numpy() for c in ("ax", "ay", "bx", "by", "edge"))
            corners = [np.concatenate(pair) for pair in ((group, group), (ax, bx), (ay, by))]
            order = np.lexsort(corners[::-1])
            corner = np.empty(2 * n, dtype=np.int64)
            corner[order] = np.cumsum(firsts(*(c[order] for c in corners)))
            starts, ends = corner[:n], corner[n:]
            by_start = np.argsort(starts, kind="stable")
            lo, hi = (np.searchsorted(starts[by_start], ends, side) for side in ("left", "right"))
            arrives = np.repeat(np.arange(n), hi - lo)
            leaves = by_start[np.arange(len(arrives)) + np.repeat(hi - np.cumsum(hi - lo), hi - lo)]
            back = np.arctan2((ay - by)[arrives], (ax - bx)[arrives])
            turn = np.mod(back - np.arctan2((by - ay)[leaves], (bx - ax)[leaves]), 2 * np.pi)
            turn[turn < 1e-12] = 2 * np.pi
            best = np.lexsort((turn, arrives))
            best = best[firsts(arrives[best])] if len(best) else best
            to, ring, ahead = np.full(n + 1, n), np.arange(n + 1), np.zeros(n + 1, dtype=np.int64)  # n: leads nowhere
            to[arrives[best]] = leaves[best]
            reach = 1
            while reach < 2 * int(np.bincount(group).max()):
                nearer = ring[to] < ring
                ring, ahead = np.where(nearer, ring[to], ring), np.where(nearer, ahead[to] + reach, ahead)
                to, reach = to[to], 2 * reach
            closed, ring, ahead = to[:n] < n, ring[:n], ahead[:n]
            size = np.bincount(ring, minlength=n)[ring]
            placed = table.drop_columns("edge").append_column("ring", pa.array(edge[ring])).append_column("place", pa.array((size - ahead) % size))
            return placed.filter(pa.array(closed))

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if table.num_rows == 0:
                continue
            group = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            whole = int(np.searchsorted(group, group[-1]))  # the last key may go on
            if whole:
                yield from rings(table.slice(0, whole), group[:whole]).to_batches()
            held = table.slice(whole)
        if held is not None and held.num_rows:
            yield from rings(held, np.zeros(held.num_rows, dtype=np.int64)).to_batches()

    return link


# Cells of a block this wide are together in one task when the edges between them go.
BLOCK_CELLS = 32


def cell_boundary(cells: DataFrame, key: str = "id") -> DataFrame:
    """Edges (`key, ax, ay, bx, by`, in thirds of the axes) between the cells of a set and all others."""
    q, r = axial_of(F.col("cell"))
    corners = [(3 * q + dq, 3 * r + dr) for dq, dr in CORNERS]
    edges = F.array(*[
        F.struct(a.alias("ax"), b.alias("ay"), c.alias("bx"), d.alias("by")) for (a, b), (c, d) in zip(corners, [*corners[1:], corners[0]])
    ])
    block = [F.floor(v / BLOCK_CELLS).alias(n) for n, v in (("bq", q), ("br", r))]
    # Edges between cells of a block go without a shuffle; those between blocks after it.
    near = dealt(cells.select(key, "cell", *block), key, "bq", "br").distinct()
    each = near.select(key, "bq", "br", F.explode(edges).alias("e"))
    ends = {"least": F.least(*(tips := (_corner("e.ax", "e.ay"), _corner("e.bx", "e.by")))), "most": F.greatest(*tips)}
    alone = each.withColumns(ends)
    # An edge between two cells of the set is there once in each direction.
    for places in (("bq", "br"), ()):
        alone = alone.groupBy(key, *places, "least", "most").agg(F.count("*").alias("n"), F.first("e").alias("e")).where("n = 1")
    return alone.select(key, "e.*")


def cell_outline(cells: DataFrame, res: int, key: str = "id") -> DataFrame:
    """Rings around sets of cells: `key, ring, place, x, y, lon, lat`, a row a corner, x and y in km on the equal-area plane.

    A cell that a set lists twice counts once. An empty set has no ring.
    """
    rings = stitched(cell_boundary(cells, key), key)
    s = edge_km(res)
    x, y = (F.col("ax") / 3.0 + F.col("ay") / 6.0) * (s * ROOT3), F.col("ay") / 3.0 * (s * 1.5)
    lon, lat = F.degrees(x / (EARTH_KM * COS0)), F.degrees(F.asin(y * (COS0 / EARTH_KM)))
    return rings.select(key, "ring", "place", x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat"))


def ring_sizes(corners: DataFrame, key: str = "id") -> DataFrame:
    """`key, ring, n_corners, area, is_hole` of rings given by their corners in order."""
    along = Window.partitionBy(key, "ring").orderBy("place")
    # The last corner is followed by the first; a long ring's corners are summed in order of one window per ring.
    first = {c: F.first(c).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("x", "y")}
    x1, y1 = (F.coalesce(F.lead(c).over(along), first[c]) for c in ("x", "y"))
    terms = corners.withColumns({"x1": x1, "y1": y1})
    summed = terms.groupBy(key, "ring").agg(
        F.count("*").alias("n_corners"), (F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y")) / 2.0).alias("area")
    )
    return summed.withColumn("is_hole", F.col("area") < 0)


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def split_edges(edges: DataFrame) -> DataFrame:
    """Edges of parts (`id, part, x0, y0, x1, y1`) on the grid, cut where another part of the same id meets them.

    `id, part, ax, ay, bx, by`. Edges that may meet share a square, so no edge is held against all others.
    """
    ends = {n: F.rint(F.col(c) * STEPS_PER_DEG).cast("bigint") for n, c in (("ax", "x0"), ("ay", "y0"), ("bx", "x1"), ("by", "y1"))}
    on_grid = edges.select("id", "part", *[v.alias(k) for k, v in ends.items()]).where("ax <> bx OR ay <> by")
    own = measured(on_grid.withColumn("edge", F.monotonically_increasing_id()), "pieces")
    width = int(SQUARE_DEG * STEPS_PER_DEG)

    def squares(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor((lo - 2) / width), F.floor((hi + 2) / width))

    near = own.withColumn("sx", F.explode(squares(F.least("ax", "bx"), F.greatest("ax", "bx")))).withColumn(
        "sy", F.explode(squares(F.least("ay", "by"), F.greatest("ay", "by")))
    )
    other = near.select("id", "sx", "sy", F.col("part").alias("part2"), *[F.col(c).alias(c.replace("a", "c").replace("b", "d")) for c in ("ax", "ay", "bx", "by")])
    pairs = near.join(other, ["id", "sx", "sy"]).where("part <> part2").select(
        "id", "part", "edge", "ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"
    ).distinct()
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    vx, vy = F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy")
    length = F.sqrt(ux.cast("double") * ux + uy.cast("double") * uy)

    def along(px: Column, py: Column) -> Column:
        """A corner of the other edge that lies on this one, between its ends."""
        wx, wy = px - F.col("ax"), py - F.col("ay")
        inside = (wx * ux + wy * uy).cast("double") / (length * length)
        on = (F.abs(_cross(ux, uy, wx, wy)) <= NEAR * length) & (inside > 0) & (inside < 1)
        return F.when(on, F.struct(inside.alias("at"), px.alias("x"), py.alias("y")))

    # Proper crossings: each edge has the other's ends strictly on both sides, by more than the corners' reach.
    across = _cross(ux, uy, vx, vy).cast("double")
    c_side, d_side = (_cross(ux, uy, F.col(x) - F.col("ax"), F.col(y) - F.col("ay")) for x, y in (("cx", "cy"), ("dx", "dy")))
    a_side, b_side = (_cross(vx, vy, F.col(x) - F.col("cx"), F.col(y) - F.col("cy")) for x, y in (("ax", "ay"), ("bx", "by")))
    share = _cross(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay"), vx, vy).cast("double") / F.nullif(across, F.lit(0.0))
    meets = (F.signum(c_side) * F.signum(d_side) < 0) & (F.signum(a_side) * F.signum(b_side) < 0)
    crossing = F.when(meets, F.struct(
        share.alias("at"), F.rint(F.col("ax") + share * ux).cast("bigint").alias("x"), F.rint(F.col("ay") + share * uy).cast("bigint").alias("y")
    ))
    cuts = pairs.select("edge", F.explode(F.filter(
        F.array(along(F.col("cx"), F.col("cy")), along(F.col("dx"), F.col("dy")), crossing), lambda p: p.isNotNull()
    )).alias("p")).select("edge", "p.*")
    tips = own.select("edge", F.explode(F.array(
        F.struct(F.lit(0.0).alias("at"), F.col("ax").alias("x"), F.col("ay").alias("y")),
        F.struct(F.lit(1.0).alias("at"), F.col("bx").alias("x"), F.col("by").alias("y")),
    )).alias("p")).select("edge", "p.*")
    order = Window.partitionBy("edge").orderBy("at")
    pieces = tips.unionByName(cuts).withColumns({"bx": F.lead("x").over(order), "by": F.lead("y").over(order)})
    pieces = pieces.where("bx IS NOT NULL AND (x <> bx OR y <> by)")
    return own.select("id", "part", "edge").join(pieces, "edge").select("id", "part", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


def union_boundary(edges: DataFrame) -> DataFrame:
    """Edges `id, ax, ay, bx, by` of the union of all parts of an id, from the edges of the parts.

    Of stretches that parts share one stays if all have their inside on the same side, and none if not. What lies
    inside another part goes.
    """
    cut = measured(split_edges(edges), "cut")
    ends = _corner("ax", "ay"), _corner("bx", "by")
    forward = ends[0] < ends[1]
    grouped = cut.groupBy("id", F.least(*ends).alias("p"), F.greatest(*ends).alias("q")).agg(
        F.count_if(forward).alias("n_forward"), F.count_if(~forward).alias("n_back"), F.collect_set("part").alias("owners"),
    ).where("n_forward = 0 OR n_back = 0")
    alone = measured(_directed(grouped), "alone")
    middles = alone.select(
        F.col("id").alias("of"), "owners", "ax", "ay", "bx", "by",
        ((F.col("ax") + F.col("bx")) / (2.0 * STEPS_PER_DEG)).alias("px"), ((F.col("ay") + F.col("by")) / (2.0 * STEPS_PER_DEG)).alias("py"),
    )
    degrees = [(F.col(c) / float(STEPS_PER_DEG)).alias(n) for c, n in (("ax", "x0"), ("ay", "y0"), ("bx", "x1"), ("by", "y1"))]
    held = polyfill_center(cut.select("id", "part", *degrees), middles, ["of", "owners", "ax", "ay", "bx", "by"])
    inside = held.where((F.col("of") == F.col("id")) & ~F.array_contains("owners", F.col("part"))).select(
        F.col("of").alias("id"), "ax", "ay", "bx", "by"
    ).distinct()
    return alone.drop("owners").join(inside, ["id", "ax", "ay", "bx", "by"], "left_anti")


def _directed(grouped: DataFrame) -> DataFrame:
    """Edges between `p` and `q`, from the lesser corner to the greater where `n_forward` says so."""
    p, q, on = F.col("p"), F.col("q"), F.col("n_forward") > 0
    a, b = F.when(on, p).otherwise(q), F.when(on, q).otherwise(p)
    return grouped.select("id", "owners", a.alias("a"), b.alias("b")).select(
        "id", "owners", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")
    )


def union_outline(edges: DataFrame) -> DataFrame:
    """Rings around the union of all parts of an id: `id, ring, place, x, y`, a row a corner, in degrees.

    `edges` are those of `ring_edges`, exteriors counterclockwise and holes clockwise. Parts may overlap, share
    stretches of their edges or touch. Corners on a straight stretch are left out, so seams leave no trace.
    """
    rings = stitched(union_boundary(edges), "id")
    along = Window.partitionBy("id", "ring").orderBy("place")
    last = {c: F.last(c).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("ax", "ay")}
    before = {c: F.coalesce(F.lag(c).over(along), last[c]) for c in ("ax", "ay")}
    turned = rings.withColumns({"px": before["ax"], "py": before["ay"]})
    ux, uy = F.col("ax") - F.col("px"), F.col("ay") - F.col("py")
    vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    wide = F.greatest(F.sqrt(ux.cast("double") * ux + uy.cast("double") * uy), F.sqrt(vx.cast("double") * vx + vy.cast("double") * vy))
    bent = turned.where((F.abs(_cross(ux, uy, vx, vy)) > 2 * NEAR * wide) | (ux * vx + uy * vy < 0))
    degrees = [(F.col(c) / float(STEPS_PER_DEG)).alias(n) for c, n in (("ax", "x"), ("ay", "y"))]
    return bent.select("id", "ring", "place", *degrees)
