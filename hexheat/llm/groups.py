"""Helpers for similarity joins: whole groups from sorted batches, pairs inside groups, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import stored


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal keys, of about `rows` rows, from rows sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        edge = np.zeros(n - 1, bool)
        for k in keys:
            column = t.column(k).to_numpy()
            edge |= column[1:] != column[:-1]
        at = np.flatnonzero(edge)
        if len(at):
            end = int(at[-1]) + 1
            yield t.slice(0, end).combine_chunks()
            held, n = t.slice(end).combine_chunks().to_batches(), n - end
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal rows begin, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    edge = np.zeros(n - 1, bool)
    for k in keys:
        edge |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(edge) + 1, [n]])


def pairs_in_groups(bounds: np.ndarray, side: np.ndarray | None = None, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) inside each group, many at once; with sides (0, 1, 2), only those of two sides 0 and 1 or of two 2.

    `side` splits a large group: a task of one block against itself has side 2, one of two blocks 0 and 1.
    """
    sizes = np.diff(bounds)
    # Row i pairs with the rows after it in its group.
    ends = np.repeat(bounds[1:], sizes)
    after = ends - np.arange(len(ends)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    row = 0
    while row < len(ends):
        stop = max(row + 1, int(np.searchsorted(total, total[row] + at_once, side="right")) - 1)
        n = after[row:stop]
        i = np.repeat(np.arange(row, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(total[row:stop] - total[row], n)
        if side is not None and len(i):
            ok = (side[i] == 2) | (side[i] != side[j])
            i, j = i[ok], j[ok]
        if len(i):
            yield i, j
        row = stop


def split_large(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Rows with `part` (which task of its key) and `side`, so that no task of a key has more than about two blocks of rows.

    Keys of one row alone are left out. A key of up to `block` rows is one task. A larger one is dealt into
    blocks by the member's hash; each block meets itself and each other block once. Counts are summed before
    they are shuffled, and large keys are spread over tasks by their blocks.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = rows.join(counts, key)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(11)), blocks).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_own", own)
    met = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda b: F.struct(
            (F.least(b, F.col("_own")) * F.col("_blocks") + F.greatest(b, F.col("_own"))).alias("part"),
            F.when(b == F.col("_own"), 2).when(b > F.col("_own"), 0).otherwise(1).alias("side"),
        ),
    )
    return rows.withColumn("_met", F.explode(met)).withColumn("part", F.col("_met.part")).withColumn("side", F.col("_met.side")).drop(
        "_n", "_blocks", "_own", "_met"
    )


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable by `links` of a, b) for every node that has a link.

    Labels are lowered along links and then follow their own labels, until none changes; every round is a
    written table. Minima are taken before they are shuffled, so a node with very many links is no hot group.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    state = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "roots")
    while True:
        lower = both.join(state, F.col("a") == F.col("node")).groupBy("b").agg(F.min("root").alias("low")).select(F.col("b").alias("of"), "low")
        lowered = state.join(lower, F.col("node") == F.col("of")).select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        above = lowered.select(F.col("node").alias("up"), F.col("root").alias("upper"))
        after = stored(
            lowered.join(above, F.col("root") == F.col("up")).select("node", F.least("root", "upper").alias("root"), "was"), "roots"
        )
        if after.where("root <> was").isEmpty():
            return after.select("node", "root")
        state = after.select("node", "root")
