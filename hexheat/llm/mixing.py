"""Mixing sources to target weights by blocks of words.

Each source's texts form one long row of words, cut into blocks of fixed length. The mix is a row of slots in
output shards; a shard's slots go to sources by a multinomial draw, the n-th slot of a source goes to a block
through a pseudorandom permutation of its blocks, and blocks are joined to slots by index. A source goes round
all its blocks before any is used again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexheat.llm.common import free_name, stored

WORD = r"[^ \x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK = 64
SHARD = 4096
SEED = 20240607
ROWS_A_BUCKET = 20_000
ROUNDS = 4
SLOTS_A_TASK = 200_000


@dataclass
class Source:
    """One source: `words` in `blocks` blocks; the mix wants `wanted` of them, `target` before rounding."""

    name: str | None
    words: int
    target: float
    wanted: int
    key: int

    @property
    def blocks(self) -> int:
        return -(-self.words // BLOCK)

    def last_round(self) -> tuple[int, int, int]:
        """Slots filled to the end, and the words of the slot after them (0: none), all rounds counted; rounds."""
        rounds, rest = divmod(self.wanted, self.words) if self.words else (0, 0)
        if not rest:
            return rounds * self.blocks, 0, rounds
        tail = self.words - (self.blocks - 1) * BLOCK
        at = int(permuted(np.array([self.blocks - 1]), self.blocks, self.key + rounds, back=True)[0])
        if rest <= at * BLOCK:
            full, part = divmod(rest, BLOCK)
        elif rest < at * BLOCK + tail:
            full, part = at, rest - at * BLOCK
        else:
            full, part = divmod(rest + BLOCK - tail, BLOCK)
        return rounds * self.blocks + full, part, rounds

    @property
    def slots(self) -> int:
        full, part, _ = self.last_round()
        return full + (part > 0)


def mixed_bits(x: np.ndarray, key: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(key % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(i: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """Where a pseudorandom permutation of range(n) takes i: a Feistel network, walked until it falls into range."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask = np.uint64((1 << half) - 1)
    x = i.astype(np.uint64)
    out = np.ones(len(x), bool)
    while out.any():
        left, right = x[out] >> np.uint64(half), x[out] & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ (mixed_bits(left, key * 31 + r) & mask), left
            else:
                left, right = right, left ^ (mixed_bits(right, key * 31 + r) & mask)
        x[out] = (left << np.uint64(half)) | right
        out = x >= n
    return x.astype(np.int64)


def shared_out(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """Targets by weight that add up to all sizes; none is above `most` times its size, the excess is shared anew."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    left, mass = total, float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i]):
        targets[i] = float(min(most * sizes[i], left * weights[i] / mass)) if left > 0 else 0.0
        left, mass = left - targets[i], mass - weights[i]
    return targets


def sized(docs: DataFrame, row: Column) -> DataFrame:
    """row, doc_id, source, hash of the text, size of every row, written down: the only pass over the texts."""
    return stored(
        docs.select(
            row.alias("row"), "doc_id", "source", F.xxhash64("text").alias("hash"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "sized",
    )


def planned(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> list[Source]:
    """The sources by code point, NULL last, with repeating weights. One row per source reaches the driver."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = shared_out([r.n for r in rows], [weights[i % len(weights)] for i in range(len(rows))])
    return [Source(r.source, r.n, t, min(round(t), MOST_REPEATS * r.n), seed + 1000 * i) for i, (r, t) in enumerate(zip(rows, targets))]


def offsets(sizes: DataFrame) -> DataFrame:
    """Each row with `start`, its first word's place in its source's row of words.

    Rows are dealt by a hash of id and text to buckets of about ROWS_A_BUCKET rows, so no task holds a whole source, nor
    all rows of one id or without id: sums run inside buckets, and over the buckets' totals. Rows without words are
    dealt by their number, as their place tells nothing.
    """
    buckets = max(256, sizes.count() // ROWS_A_BUCKET)
    key = F.when(F.col("size") > 0, F.xxhash64("doc_id", "hash", F.lit(7))).otherwise(F.xxhash64("row"))
    dealt = sizes.withColumn("bucket", F.pmod(key, F.lit(buckets)))
    before = W.partitionBy("source", "bucket").orderBy("doc_id", "size", "hash", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = dealt.withColumn("inner", F.coalesce(F.sum("size").over(before), F.lit(0)))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    totals = totals.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("outer"))
    return rows.join(totals, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).select(
        "row", "doc_id", "source", "size", (F.col("outer") + F.col("inner")).alias("start")
    )


def drawn(sizes: DataFrame, sources: list[Source], shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """shard, source (its number), from_slot, n: multinomial counts of each shard as runs of a source's slots.

    Shards draw independently, each from its own seed. What the draws give a source beyond its slots goes, in
    order, to the sources that got too few, so that the totals are those wanted.
    """
    total = sum(s.slots for s in sources)
    shards = -(-total // shard)
    spark = sizes.sparkSession
    chances = np.array([s.slots for s in sources], float) / max(total, 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x.column("id").to_pylist()
            counts = [np.random.Generator(np.random.Philox([seed, k])).multinomial(min(shard, total - k * shard), chances) for k in ids]
            n = np.array(counts, np.int64).reshape(len(ids), len(chances))
            at, source = np.nonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(ids, np.int64)[at]), pa.array(source.astype(np.int32)), pa.array(n[at, source])], ["shard", "source_no", "n"]
            )

    counts = stored(spark.range(shards).mapInArrow(draw, "shard long, source_no int, n long"), "drawn")
    got = {r.source_no: r.n for r in counts.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    over, under, a, b = [], [], 0, 0
    for i, s in enumerate(sources):
        n = got.get(i, 0)
        over.append((i, s.slots, a))
        a += max(0, n - s.slots)
        if s.slots > n:
            under.append((b, b + s.slots - n, i, n))
            b += s.slots - n
    # Runs of slots per shard, sums taken per stretch of shards and then over the stretches.
    stretch = 4096
    counts = counts.withColumn("stretch", F.floor(F.col("shard") / stretch))
    inside = W.partitionBy("source_no", "stretch").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy("source_no").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.groupBy("source_no", "stretch").agg(F.sum("n").alias("m")).select(
        "source_no", "stretch", F.coalesce(F.sum("m").over(above), F.lit(0)).alias("outer")
    )
    runs = counts.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(ahead, ["source_no", "stretch"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for k, i, first, n in zip(*(x.column(c).to_pylist() for c in ("shard", "source_no", "first", "n"))):
                _, slots, spare = over[i]
                own = min(n, max(0, slots - first))
                if own:
                    out.append((k, i, first, own))
                lo, hi = spare + max(first, slots) - slots, spare + first + n - slots
                out += [(k, j, m + max(lo, c) - c, min(hi, d) - max(lo, c)) for c, d, j, m in under if hi > lo and c < hi and d > lo]
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                ["shard", "source_no", "from_slot", "n"],
            )

    return runs.select("shard", "source_no", (F.col("outer") + F.col("inner")).alias("first"), "n").mapInArrow(
        settle, "shard long, source_no int, from_slot long, n long"
    )


def filled(runs: DataFrame, sources: list[Source]) -> DataFrame:
    """shard, source_no, slot, round, block, words: which block each slot takes, and how many of its words."""
    ends = [s.last_round() for s in sources]
    tasks = max(1, sum(s.slots for s in sources) // SLOTS_A_TASK)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k, i, first, n in zip(*(x.column(c).to_pylist() for c in ("shard", "source_no", "from_slot", "n"))):
                s, (full, part, _) = sources[i], ends[i]
                slot = np.arange(first, first + n)
                rounds, at = np.divmod(slot, s.blocks)
                block = np.empty(n, np.int64)
                for r in np.unique(rounds):
                    block[rounds == r] = permuted(at[rounds == r], s.blocks, s.key + int(r))
                words = np.where(slot < full, BLOCK, part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, k)), pa.array(np.full(n, i, np.int32)), pa.array(slot), pa.array(rounds.astype(np.int32)), pa.array(block), pa.array(words)],
                    ["shard", "source_no", "slot", "round", "block", "words"],
                )

    return runs.repartition(tasks, "shard").mapInArrow(fill, "shard long, source_no int, slot long, round int, block long, words long")


def source_table(sizes: DataFrame, sources: list[Source]) -> DataFrame:
    rows = [(i, s.name, s.words, s.target, s.last_round()[2]) for i, s in enumerate(sources)]
    return sizes.sparkSession.createDataFrame(rows, "source_no int, name string, source_size long, target double, rounds int")


def takes(docs: DataFrame, row: Column, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sized rows with their source's numbers; slots; (row, round, least, most): words [least, most) of a row that a slot takes."""
    sizes = sized(docs, row)
    sources = planned(sizes, weights, seed)
    slots = stored(filled(drawn(sizes, sources, seed=seed), sources), "slots")
    named = F.broadcast(source_table(sizes, sources))
    rows = offsets(sizes).join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = stored(rows, "placed")
    blocks = rows.where("size > 0").select(
        "row", "source_no", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))).alias("block"),
    )
    least = F.greatest(F.col("block") * BLOCK, F.col("start")) - F.col("start")
    most = F.least(F.col("block") * BLOCK + F.col("words"), F.col("start") + F.col("size")) - F.col("start")
    pieces = blocks.join(slots, ["source_no", "block"]).select("row", "round", least.alias("least"), most.alias("most")).where("most > least")
    return rows, slots, pieces


def mix_words(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, taken.

    `taken` counts the words the mix takes from the row, repeats included, at most MOST_REPEATS times `size`.
    NULL text has size 0 and gives nothing; a NULL source is a source. Each source gives its target, rounded
    to whole words. The same rows give the same mix, however they are spread over files.
    """
    rows, _, pieces = takes(docs, F.monotonically_increasing_id(), weights, seed)
    taken = pieces.groupBy("row").agg(F.sum(F.col("most") - F.col("least")).alias("taken"))
    return rows.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of `docs`: one row per document and round that takes words of it.

    A round that takes all words gives the text as it is; else the text is the words taken, joined by spaces,
    and n_chars, where there is one, is its length. Documents that the mix takes nothing of are left out.
    """
    row = free_name(docs, "row")
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixing")
    rows, _, pieces = takes(kept, F.col(row), weights, seed)
    of, ranges = free_name(kept, "of"), free_name(kept, "ranges")
    cuts = pieces.groupBy("row", "round").agg(F.array_sort(F.collect_list(F.struct("least", "most"))).alias("cuts"), F.sum(F.col("most") - F.col("least")).alias("n"))
    cuts = cuts.join(rows.select("row", "size"), "row").select(
        F.col("row").alias(of), F.when(F.col("n") < F.col("size"), F.col("cuts")).alias(ranges)
    )
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(ranges, lambda x: F.slice(words, (x["least"] + 1).cast("int"), (x["most"] - x["least"]).cast("int")))), " ")
    text = F.when(F.col(ranges).isNull(), F.col("text")).otherwise(cut)
    out = kept.join(cuts, F.col(row) == F.col(of)).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)
