"""N-gram Jaccard join by chosen paths.

Each set of word n-grams is embedded in a row of min-hash coordinates. A run splits all sets on one sampled
coordinate; a bucket that is still large is split again on several sampled coordinates, and so on down to a
fixed depth; small buckets are compared directly. Runs repeat until the target recall. A pair is compared in
the first of its common leaf buckets only, so links are counted once and never written out as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import numbered, stored
from hexheat.llm.groups import components, group_bounds, pairs_in_groups, split_large, whole_groups

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99999
BUCKET = 4096
BLOCK = 1024
DEPTH = 3
CHILDREN = 6
COORDINATES = 32
WORDS_KEPT = 500_000


@dataclass(frozen=True)
class Paths:
    """The tree of sampled coordinates: runs at the root, CHILDREN below each node; in depth-first order."""

    runs: int
    coordinates: int
    depth: int
    children: int

    def below(self, path: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Paths one step longer; each step takes a coordinate that its path doesn't have."""
        if not path:
            return [(r,) for r in range(self.runs)]
        if len(path) >= self.depth:
            return []
        rest = [c for c in range(self.coordinates) if c not in path]
        shift = xxhash.xxh64_intdigest(str(path)) % len(rest)
        step = next(s for s in range(7, 100) if math.gcd(s, len(rest)) == 1)
        return [(*path, rest[(shift + k * step) % len(rest)]) for k in range(min(self.children, len(rest)))]

    def all(self) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = []
        stack = self.below(())[::-1]
        while stack:
            out.append(stack.pop())
            stack += self.below(out[-1])[::-1]
        return out


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair of that similarity has met with the wanted chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity)))


class Words:
    """Hashes of words, the frequent ones kept."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def hashes(self, words: list[str]) -> np.ndarray:
        kept = self.kept
        if len(kept) > WORDS_KEPT:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(kept.__getitem__, words), np.uint64, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, cache: Words, n: int = WORDS) -> np.ndarray:
    """The distinct n-grams of a text's words as sorted hashes; fewer words than n are one gram, none are none."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = cache.hashes(words)
    k = min(n, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - k + 1 + i]
    return np.unique(scrambled(total + np.uint64(k)))


def min_hashes(tokens: np.ndarray, coordinates: int) -> np.ndarray:
    odd = scrambled(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty(coordinates, np.uint64)
    for c in range(coordinates):
        out[c] = (tokens * odd[c] ^ (tokens >> np.uint64(29))).min()
    return (scrambled(out) >> np.uint64(33)).astype(np.int64).astype(np.int32)


def row_number(row: Column | None) -> Column:
    return F.monotonically_increasing_id() if row is None else row


def embedded(docs: DataFrame, n: int = WORDS, coordinates: int = COORDINATES, row: Column | None = None) -> DataFrame:
    """row, doc_id, size, set_lo and set_hi (a 128-bit name of the set), sig: min-hash coordinates; NULL where a text has no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for x in batches:
            sizes, names, sigs = [], [], []
            for text in x.column("text"):
                t = ngrams(text.as_py(), cache, n)
                sizes.append(len(t))
                names.append(np.frombuffer(xxhash.xxh128_digest(t.tobytes()), np.int64))
                sigs.append(min_hashes(t, coordinates) if len(t) else None)
            lo, hi = np.array(names, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [x.column("row"), x.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lo), pa.array(hi), pa.array(sigs, pa.list_(pa.int32()))],
                ["row", "doc_id", "size", "set_lo", "set_hi", "sig"],
            )

    rows = docs.select(row_number(row).alias("row"), "doc_id", "text")
    return rows.mapInArrow(work, "row long, doc_id long, size long, set_lo long, set_hi long, sig array<int>")


def leaves(sets: DataFrame, paths: Paths, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Leaf buckets (key, path, node), and each node's large buckets (node, large: paths).

    A level's rows are (key, path, node, sig); a bucket with more than `bucket` rows is split on the next
    coordinates unless it is at full depth, where `split_large` deals it out instead.
    """
    index = {p: i for i, p in enumerate(paths.all())}
    here = [(p, index[p]) for p in paths.below(())]
    named = lambda key, p: F.xxhash64(*key, F.lit(p[-1]), F.col("sig")[p[-1]])
    level = sets.select("node", "sig", F.explode(F.array(*[F.struct(F.lit(i).alias("path"), named([], p).alias("key")) for p, i in here])).alias("at"))
    level = level.select("node", "sig", "at.path", "at.key")
    done, large = None, None
    for depth in range(1, paths.depth + 1):
        if depth < paths.depth:
            big = stored(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key"), "big")
            rest = level.join(big, "key", "left_anti") if not big.isEmpty() else level
        else:
            big, rest = None, level
        rest = rest.select("key", "path", "node")
        done = rest if done is None else done.union(rest)
        if big is None or big.isEmpty():
            break
        again = stored(level.join(big, "key"), "large")
        marks = again.select("node", "path")
        large = marks if large is None else large.union(marks)
        here = [(p, i) for p, i in index.items() if len(p) == depth]
        kids = None
        for p, i in here:
            step = F.array(*[F.struct(F.lit(index[q]).alias("path"), named([F.col("key")], q).alias("key")) for q in paths.below(p)])
            kids = F.when(F.col("path") == i, step) if kids is None else kids.when(F.col("path") == i, step)
        level = again.select("node", "sig", F.explode(kids).alias("at")).select("node", "sig", "at.path", "at.key")
    if large is None:
        large = sets.select("node", F.lit(0).alias("path")).limit(0)
    return done, large.groupBy("node").agg(F.collect_set("path").alias("large"))


class FirstLeaf:
    """Finds the path of the first leaf where two sets meet."""

    def __init__(self, paths: Paths) -> None:
        self.paths = paths
        self.index = {p: i for i, p in enumerate(paths.all())}

    def flags(self, large: list[list[int] | None]) -> np.ndarray | None:
        if not any(large):
            return None
        out = np.zeros((len(large), len(self.index)), bool)
        for i, x in enumerate(large):
            out[i, x or []] = True
        return out

    def __call__(self, sig: np.ndarray, flags: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Path numbers, -1 for pairs that meet nowhere. Sets of one bucket agree on whether it is large."""
        found = np.full(len(i), -1, np.int32)

        def walk(path: tuple[int, ...], todo: np.ndarray) -> None:
            for p in self.paths.below(path):
                todo = todo[found[todo] < 0]
                if not len(todo):
                    return
                meet = todo[sig[i[todo], p[-1]] == sig[j[todo], p[-1]]]
                n = self.index[p]
                split = flags[i[meet], n] & flags[j[meet], n] if flags is not None and len(p) < self.paths.depth else np.zeros(len(meet), bool)
                found[meet[~split]] = n
                if split.any():
                    walk(p, meet[split])

        walk((), np.arange(len(i)))
        return found


def overlap(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many of i's tokens j has, for pairs sorted by i; tokens are numbers below len(tokens)."""
    out = np.empty(len(i), np.int64)
    mark = np.zeros(int(tokens.max(initial=0)) + 1, bool)
    bounds = group_bounds(i)
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = tokens[starts[i[a]]:starts[i[a]] + sizes[i[a]]]
        mark[own] = True
        at = a
        while at < b:  # some millions of tokens a time
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[j[at:b]]), 4_000_000)))
            js = j[at:end]
            n = sizes[js]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            place = np.arange(int(n.sum())) + np.repeat(starts[js] - first, n)
            out[at:end] = np.add.reduceat(mark[tokens[place]].astype(np.int32), first)
            at = end
        mark[own] = False
    return out


def set_links(docs: DataFrame, n: int, similarity: float, recall: float, bucket: int, block: int, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their set's node; nodes with their links' weights (node, links); a forest of links (a, b)."""
    paths = Paths(runs_for(recall, similarity), COORDINATES, DEPTH, CHILDREN)
    rows = stored(embedded(docs, n, row=row), "embedded")
    named = rows.where("sig is not null")
    # Equal sets are one node; its weight is how many rows have the set.
    sets = named.groupBy("set_lo", "set_hi").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("size").alias("size"), F.min("sig").alias("sig")
    )
    sets = stored(sets.select("set_lo", "set_hi", "node", "weight", "size", "sig"), "sets")
    leaf, large = leaves(sets, paths, bucket)
    parts = split_large(leaf, "key", "node", block)
    facts = sets.join(large, "node", "left").select("node", "weight", "size", "sig", "large")
    first = FirstLeaf(paths)
    columns = ["key", "part", "side", "path", "node", "weight", "size"]

    def candidates(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose first leaf this is and whose sizes allow the similarity."""
        key, part, side, path, size = (t.column(c).to_numpy() for c in ("key", "part", "side", "path", "size"))
        sig = np.array(t.column("sig").combine_chunks().flatten()).reshape(len(key), -1)
        flags = first.flags(t.column("large").to_pylist())
        for i, j in pairs_in_groups(group_bounds(key, part), side):
            near = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            i, j = i[near], j[near]
            here = first(sig, flags, i, j) == path[i]
            if here.any():
                yield i[here], j[here]

    def useful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["key", "part"], 20_000):
            keep = np.zeros(t.num_rows, bool)
            for i, j in candidates(t):
                keep[i] = keep[j] = True
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()

    shape = "key long, part int, side int, path int, node long, weight long, size long, sig array<int>, large array<int>"
    met = parts.join(facts, "node").select(*columns, "sig", "large").repartition("key", "part").sortWithinPartitions("key", "part")
    met = stored(met.mapInArrow(useful, shape), "met")
    needed = met.select("node").distinct()
    texts = docs.select(row_number(row).alias("node"), "text").join(needed, "node")
    loaded = met.join(texts, "node").repartition("key", "part").sortWithinPartitions("key", "part")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words()
        for t in whole_groups(batches, ["key", "part"], 2_000):
            sets_here = [ngrams(x.as_py(), cache, n) for x in t.column("text")]
            node, weight, size = (t.column(c).to_numpy() for c in ("node", "weight", "size"))
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            tokens = np.unique(np.concatenate(sets_here), return_inverse=True)[1]
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for i, j in candidates(t):
                common = overlap(tokens, starts, size, i, j)
                # In whole numbers: common / union >= similarity.
                ok = common * 1_000_000 >= round(similarity * 1_000_000) * (size[i] + size[j] - common)
                i, j = i[ok], j[ok]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                root = joined_roots(root, i, j)
            linked = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[linked]), pa.array(links[linked]), pa.array(node[root[linked]])], ["node", "links", "root"]
            )

    found = stored(loaded.mapInArrow(verified, "node long, links long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    forest = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct()
    members = rows.join(sets.select("set_lo", "set_hi", "node", "weight"), ["set_lo", "set_hi"], "left").select(
        "row", "doc_id", F.when(F.col("size") > 0, F.col("node")).alias("node"), "weight"
    )
    return members, counts, forest


def joined_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable index of each, after the links (i, j) join the trees in `root`."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def near_copies(
    docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, n_links, kept.

    Two rows link when their sets of word n-grams have a Jaccard similarity of `similarity` or more; words are
    what white space separates, and a text of fewer than n words is one gram. n_links counts the other rows
    linked directly, class_id is the least doc_id of all rows reachable by links, kept marks that row. NULL,
    empty and blank texts have no grams and link with nothing. Rows with a NULL doc_id count and carry links,
    but never name a class unless all its ids are NULL. Repeated rows link with each other like any equal texts.
    """
    return marked_rows(docs, None, n, similarity, recall, bucket, block).drop("row")


def marked_rows(
    docs: DataFrame, row: Column | None, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """`near_copies` with the number of each row."""
    members, counts, forest = set_links(docs, n, similarity, recall, bucket, block, row)
    roots = components(forest)
    rows = members.join(counts, "node", "left").join(roots, "node", "left").select(
        "row", "doc_id", F.coalesce("root", "node", -1 - F.col("row")).alias("class"),
        F.when(F.col("node").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
    )
    rows = stored(rows, "classes")
    least = stored(rows.groupBy("class").agg(F.min("doc_id").alias("class_id")), "least")
    return rows.join(least, "class").select(
        "row", "doc_id", "class_id", "n_links", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that `near_copies` doesn't keep; rows without an id stay."""
    rows, row = numbered(docs)
    gone = marked_rows(rows, F.col(row)).where("not kept and doc_id is not null").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)
