"""Embedding near-duplicates by lattice hashing.

A table of the index projects vectors to eight random dimensions and decodes them to the nearest point of the
E8 lattice. Close vectors often fall into one cell or into neighbouring ones, so a vector also probes the
lattice points next to its own. Pairs that meet in any table are verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import stored
from hexheat.llm.groups import components, group_bounds, pairs_in_groups, split_large, whole_groups
from hexheat.llm.ngram_join import joined_roots

COSINE = 0.93
TABLES, PROBES, WIDTH, SEED = 10, 6, 1.0, 11
BLOCK = 1024


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sum, by row."""
    y = np.rint(x)
    odd = np.flatnonzero(y.sum(1) % 2)
    worst = np.abs(x[odd] - y[odd]).argmax(1)
    gap = x[odd, worst] - y[odd, worst]
    y[odd, worst] += np.where(gap >= 0, 1, -1)
    return y


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: the nearer of the nearest even-sum point and the nearest one moved by halves."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(near[:, None], a, b)


def shortest_e8() -> np.ndarray:
    """The 240 shortest lattice vectors: the steps to a cell's neighbours."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                rows.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            rows.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(rows)


STEPS = shortest_e8()


def cell_keys(points: np.ndarray, table: int, label: np.ndarray) -> np.ndarray:
    """A 64-bit name of each (label, table, lattice point)."""
    h = label.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(table + 1)
    for c in np.rint(2 * points).astype(np.int64).astype(np.uint64).T:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c
    return (h ^ (h >> np.uint64(32))).astype(np.int64)


def projections(size: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.standard_normal((tables, size, 8)) / width, r.uniform(0, 2, (tables, 8))


def cells(vectors: np.ndarray, label: np.ndarray, tables: int, probes: int, width: float, seed: int) -> np.ndarray:
    """rows x tables x (1 + probes) cell names: the own one first, then the nearest neighbours'."""
    turn, shift = projections(vectors.shape[1], tables, width, seed)
    out = np.empty((len(vectors), tables, 1 + probes), np.int64)
    for t in range(tables):
        x = vectors @ turn[t] + shift[t]
        own = nearest_e8(x)
        out[:, t, 0] = cell_keys(own, t, label)
        # |x - own - step|^2 is least where the step points most along what is left over.
        order = np.argpartition(-((x - own) @ STEPS.T), probes - 1, axis=1)[:, :probes] if probes else np.zeros((len(x), 0), int)
        for p in range(probes):
            out[:, t, 1 + p] = cell_keys(own + STEPS[order[:, p]], t, label)
    return out


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows they are of: those neither NULL, empty nor zero, all of it finite."""
    rows = column.to_pylist()
    usable = [i for i, v in enumerate(rows) if v and all(c is not None for c in v)]
    if not usable:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    vectors = np.array([rows[i] for i in usable], float)
    with np.errstate(invalid="ignore", over="ignore"):
        peak = np.abs(vectors).max(1)
        fine = np.isfinite(peak) & (peak > 0)
    vectors = vectors[fine] / peak[fine, None]
    return vectors / np.linalg.norm(vectors, axis=1)[:, None], np.array(usable)[fine]


def near_vectors(
    embeddings: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH,
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """One row per row of `embeddings` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label link when their cosine is `cosine` or more. NULL labels and vectors that are NULL,
    empty, zero, or have NULL or non-finite parts link with nothing. Equal vectors of a label are one node with
    a weight, so copies link without being paired. Vectors of different lengths never link. component_id is the
    least vec_id reachable (NULL ids name no component), kept marks that row.
    """
    rows = stored(
        embeddings.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label")),
        "vectors",
    )
    sound = F.col("label").isNotNull() & (F.size("vector") > 0) & F.exists("vector", lambda x: x != 0) & F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    nodes = stored(
        rows.where(sound).groupBy("label", "vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight")), "nodes"
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lengths = np.array(x.column("vector").value_lengths())
            for n in np.unique(lengths):
                part = x.filter(pa.array(lengths == n))
                unit, at = unit_rows(part.column("vector"))
                part = part.take(pa.array(at))
                label = part.column("label").to_numpy() * 4099 + n
                keys = cells(unit, label, tables, probes, width, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"), part.column("weight"),
                        pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), int(n)).cast(pa.list_(pa.float64())),
                        pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), tables * (1 + probes)).cast(pa.list_(pa.int64())),
                    ],
                    ["node", "weight", "unit", "cells"],
                )

    index = stored(nodes.mapInArrow(hashed, "node long, weight long, unit array<double>, cells array<long>"), "cells")
    entries = index.select("node", F.posexplode("cells").alias("place", "key")).select(
        "node", "key", F.floor(F.col("place") / (1 + probes)).cast("int").alias("table"), (F.col("place") % (1 + probes) == 0).alias("own")
    )
    # A cell that no vector has as its own joins nothing.
    homes = entries.where("own").select("key").distinct()
    parts = split_large(entries.join(homes, "key", "left_semi"), "key", "node", block)
    dealt = parts.join(index, "node").repartition("key", "part").sortWithinPartitions("key", "part")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "part"], 8_000):
            key, part, side, table, node, weight = (t.column(c).to_numpy() for c in ("key", "part", "side", "table", "node", "weight"))
            own = np.array(t.column("own").to_pylist(), bool)
            lengths = np.array(t.column("unit").combine_chunks().value_lengths())
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            unit = np.zeros((len(node), lengths.max()))
            unit[np.arange(lengths.max()) < lengths[:, None]] = np.array(t.column("unit").combine_chunks().flatten())
            held = np.array(t.column("cells").combine_chunks().flatten()).reshape(len(node), tables, 1 + probes)
            for i, j in pairs_in_groups(group_bounds(key, part), side, 1 << 17):
                near = (own[i] | own[j]) & (node[i] != node[j])
                i, j = i[near], j[near]
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                i, j = i[near], j[near]
                here = first_meeting(held, i, j) == key[i]
                i, j = i[here], j[here]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                root = joined_roots(root, i, j)
            linked = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[linked]), pa.array(links[linked]), pa.array(node[root[linked]])], ["node", "links", "root"]
            )

    found = stored(dealt.mapInArrow(verified, "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    named = nodes.join(counts, "node", "left").join(roots, "node", "left").select(
        "label", "vector", F.coalesce("root", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n")
    )
    out = rows.join(named, ["label", "vector"], "left").select(
        "vec_id", F.coalesce("class", -1 - F.col("row")).alias("class"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links")
    )
    out = stored(out, "classes")
    least = out.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    return out.join(least, "class").select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def first_meeting(cells: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cell in which each pair counts: of the first table where one's own cell is among the other's, the lesser such cell."""
    out = np.zeros(len(i), np.int64)
    todo = np.arange(len(i))
    for t in range(cells.shape[1]):
        if not len(todo):
            break
        a, b = cells[i[todo], t], cells[j[todo], t]
        a_in, b_in = (a[:, :1] == b).any(1), (b[:, :1] == a).any(1)
        top = np.iinfo(np.int64).max
        cell = np.minimum(np.where(a_in, a[:, 0], top), np.where(b_in, b[:, 0], top))
        met = a_in | b_in
        out[todo[met]] = cell[met]
        todo = todo[~met]
    return out
