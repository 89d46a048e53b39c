"""Collocations: phrases of two or three words that stand together more often than their parts would.

Frequent n-grams are found in two passes. Texts are packed into chunks; a chunk's n-grams are counted by a 48-bit hash,
and the counts are dealt out by ranges of the hash. For each range the chunks' counts, which are Misra-Gries summaries
that nothing was taken from yet, are merged into one of a capacity above the range's mass divided by the threshold:
whatever is lost was rarer than the threshold. The second pass counts what is left exactly, by hash in the range's task
and then by the words themselves in the chunks, each of which is sent those hashes of its own that are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexheat.llm.common import stored

LONGEST = 3
LEAST = 10
COVERED = 50
TOP = 2000
NO_LANG = "und"
# Bytes of text in a chunk. A longer text is cut where a piece ends, or not at all where no piece ends.
CHUNK = 8 << 20
# Occurrences a range of hashes has on average, and the least number of ranges.
RANGE_MASS = 8_000_000
LEAST_RANGES = 64
# A summary's capacity, in multiples of mass / threshold.
CAPACITY = 2
BITS = 48

BREAKS = b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(BREAKS)] = 2
BREAK_OF = bytes(10 if b in BREAKS else b for b in range(256))


def parts(text: bytes, most: int) -> Iterator[bytes]:
    """A text cut after the first break beyond every `most` bytes."""
    if len(text) > most:
        text, start = text.translate(BREAK_OF), 0
        while len(text) - start > most and (cut := text.find(b"\n", start + most)) >= 0:
            yield text[start:cut]
            start = cut
        text = text[start:]
    yield text


def count_words(text: bytes) -> int:
    inside = KIND[np.frombuffer(text, np.uint8)] == 0
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(inside[:1].sum())


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and the number of breaks before each."""
    kind = KIND[np.frombuffer(text, np.uint8)]
    edge = np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, np.searchsorted(np.flatnonzero(kind == 2), starts)


class Chunk:
    """The words of a chunk as numbers, and its n-grams."""

    def __init__(self, lang: str, text: bytes) -> None:
        self.lang = lang
        starts, ends, self.piece = word_bounds(text)
        data = np.frombuffer(text, np.uint8)
        data = data[KIND[data] == 0]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data.tobytes())])
        coded = words.dictionary_encode()
        self.words, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)

    def starts(self, k: int) -> np.ndarray:
        """Places where k words of one piece begin."""
        n = len(self.ids) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1:]) if n > 0 else np.zeros(0, np.int64)

    def hashes(self, hash_bits: int = BITS) -> list[np.ndarray]:
        """For each k, the hashes of all k-grams by place."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()], np.uint64)[self.ids]
        h = np.full(len(own), xxhash.xxh3_64_intdigest(self.lang), np.uint64)
        out = []
        for k in range(1, LONGEST + 1):
            at = self.starts(k)
            h = (h[at if k > 1 else slice(None)] ^ own[at + k - 1]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
            h ^= h >> np.uint64(29)
            out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - hash_bits)))
            if k < LONGEST:
                # The next length goes on from every place; places without a k-gram have no longer one either.
                full = np.zeros(len(own), np.uint64)
                full[at] = h
                h = full
        return out

    def phrases(self, k: int, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Distinct k-grams among those that begin at the given places, as text, and how often each does."""
        if not len(at):
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        key, base = self.ids[at], len(self.words)
        for i in range(1, k):
            key = np.unique(key, return_inverse=True)[1] * base + self.ids[at + i]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        columns = [self.words.take(pa.array(self.ids[at[first] + i])) for i in range(k)]
        joined = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())) if k > 1 else columns[0]
        return joined.cast(pa.large_string()).cast(pa.string()), counts


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """chunk, lang, n_words, size, packed: the texts of `docs`, lower-cased and packed by language, as a written table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            text = b"\n".join(held.pop(lang))
            del sizes[lang]
            values = [lang], [count_words(text)], [len(text)], [pa.compress(text, "zstd", asbytes=True)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["lang", "n_words", "size", "packed"])

        for x in batches:
            for lang, text in zip(x.column("lang").to_pylist(), x.column("text").to_pylist()):
                lang = NO_LANG if lang is None else lang
                for part in parts((text or "").encode().lower(), chunk_bytes):
                    held.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                    if sizes[lang] >= chunk_bytes:
                        yield flush(lang)
                    elif len(sizes) > 1 and sum(sizes.values()) >= 3 * chunk_bytes:
                        yield flush(max(sizes, key=sizes.get))
        for lang in [*held]:
            yield flush(lang)

    packed = docs.select("lang", "text").mapInArrow(work, "lang string, n_words bigint, size bigint, packed binary")
    return stored(packed.withColumn("chunk", F.monotonically_increasing_id()), "chunks")


def unpacked(row: pa.Table | pa.RecordBatch, i: int) -> Chunk:
    return Chunk(row.column("lang")[i].as_py(), pa.decompress(row.column("packed")[i].as_buffer(), row.column("size")[i].as_py(), "zstd", asbytes=True))


def summaries(packed: DataFrame, range_bits: int, hash_bits: int = BITS) -> DataFrame:
    """range, chunk, wide, deltas, counts: how often each hash stands in a chunk, by range; hashes in order, as differences."""
    shift = hash_bits - range_bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for i in range(x.num_rows):
                hashes, counts = np.unique(np.concatenate(unpacked(x, i).hashes(hash_bits)), return_counts=True)
                ranges = (hashes >> np.uint64(shift)).astype(np.int64)
                cuts = np.searchsorted(ranges, np.arange((1 << range_bits) + 1))
                out = []
                for r in np.unique(ranges).tolist():
                    own = np.diff(hashes[cuts[r]:cuts[r + 1]], prepend=np.uint64(r << shift))
                    wide = bool(own.max() >> np.uint64(32))
                    out.append((r, wide, own.astype("<u8" if wide else "<u4").tobytes(), counts[cuts[r]:cuts[r + 1]].astype("<u4").tobytes()))
                if out:
                    r, wide, deltas, counts = map(list, zip(*out))
                    chunk = pa.array([x.column("chunk")[i].as_py()] * len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r, pa.int64()), chunk, pa.array(wide), pa.array(deltas, pa.binary()), pa.array(counts, pa.binary())],
                        ["range", "chunk", "wide", "deltas", "counts"],
                    )

    return packed.mapInArrow(work, "range bigint, chunk bigint, wide boolean, deltas binary, counts binary")


def merged(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Two Misra-Gries summaries (hashes, counts, most that any count lacks) as one of at most `capacity` counters."""
    hashes, place = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([a[1], b[1]]), len(hashes)).astype(np.int64)
    lack = a[2] + b[2]
    if len(hashes) > capacity:
        # Taking the count that is next after `capacity` from all takes it from more than `capacity` counters at once.
        less = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        keep = counts > less
        hashes, counts, lack = hashes[keep], counts[keep] - less, lack + less
    return hashes, counts, lack


def frequent(rows: list[tuple[np.ndarray, np.ndarray]], least: int, factor: int = CAPACITY) -> np.ndarray:
    """Hashes whose counts reach `least` over all rows of (hashes in order, counts), in order."""
    mass = sum(int(c.sum()) for _, c in rows)
    capacity = factor * (mass // least) + 1
    summary = (np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for k, row in enumerate(rows):
        waiting.append(row)
        n += len(row[0])
        if n > capacity or k == len(rows) - 1:
            exact = np.concatenate([h for h, _ in waiting]), np.concatenate([c for _, c in waiting]).astype(np.int64), 0
            summary, waiting, n = merged(summary, exact, capacity), [], 0
    hashes, counts, lack = summary
    hashes = hashes[counts + lack >= least]
    # Second pass: exact counts of what is left.
    exact = np.zeros(len(hashes), np.int64)
    for h, c in rows:
        at, hit = found(h, hashes)
        exact[at] += c[hit]
    return hashes[exact >= least]


def found(these: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the ordered `among` of those of `these` that are in it, and which those are."""
    if not len(among):
        return np.zeros(0, np.int64), np.zeros(len(these), bool)
    at = np.minimum(np.searchsorted(among, these), len(among) - 1)
    hit = among[at] == these
    return at[hit], hit


def frequent_by_chunk(counted: DataFrame, least: int, range_bits: int, hash_bits: int = BITS) -> DataFrame:
    """chunk, hashes: those hashes of each chunk that are frequent in all chunks together, from `summaries`."""
    shift = hash_bits - range_bits

    def work(group: pa.Table) -> pa.Table:
        base = np.uint64(group.column("range")[0].as_py() << shift)
        rows = []
        for wide, deltas, counts in zip(*(group.column(c).to_pylist() for c in ("wide", "deltas", "counts"))):
            own = np.frombuffer(deltas, "<u8" if wide else "<u4").astype(np.uint64)
            rows.append((np.cumsum(own) + base, np.frombuffer(counts, "<u4").astype(np.int64)))
        left = frequent(rows, least)
        own = [h[found(h, left)[1]].astype("<u8").tobytes() for h, _ in rows]
        out = pa.table({"chunk": group.column("chunk"), "hashes": pa.array(own, pa.binary())})
        return out.filter(pc.greater(pc.binary_length(out.column("hashes")), 0))

    return counted.groupBy("range").applyInArrow(work, "chunk bigint, hashes binary")


def frequent_phrases(packed: DataFrame, least: int = LEAST, range_mass: int = RANGE_MASS, hash_bits: int = BITS) -> DataFrame:
    """lang, k, phrase, a: every phrase of 1 to 3 words that occurs at least `least` times in its language, from `chunks`."""
    mass = LONGEST * (packed.agg(F.sum("n_words")).first()[0] or 0)
    range_bits = max(mass // range_mass, LEAST_RANGES - 1).bit_length()
    sent = frequent_by_chunk(summaries(packed, range_bits, hash_bits), least, range_bits, hash_bits)

    def work(chunk: pa.Table, sent: pa.Table) -> pa.Table:
        out = [pa.table({"lang": pa.array([], pa.string()), "k": pa.array([], pa.int32()), "phrase": pa.array([], pa.string()), "a": pa.array([], pa.int64())})]
        if chunk.num_rows and sent.num_rows:
            own = unpacked(chunk, 0)
            left = np.sort(np.frombuffer(b"".join(sent.column("hashes").to_pylist()), "<u8"))
            for k, hashes in enumerate(own.hashes(hash_bits), 1):
                phrases, counts = own.phrases(k, own.starts(k)[found(hashes, left)[1]])
                out.append(pa.table({"lang": pa.array([own.lang] * len(phrases), pa.string()), "k": pa.array([k] * len(phrases), pa.int32()),
                                     "phrase": phrases, "a": pa.array(counts, pa.int64())}))
        return pa.concat_tables(out)

    by_chunk = packed.groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(work, "lang string, k int, phrase string, a bigint")
    return by_chunk.groupBy("lang", "k", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), in whole numbers of up to 38 digits."""
    return F.expr("((cast({0} as decimal(19,0)) * cast({0} as decimal(19,0)) * 1000000BD) div (cast({1} as decimal(19,0)) * cast({2} as decimal(19,0))))".format(a, left, right))


def scored(phrases: DataFrame) -> DataFrame:
    """lang, k, phrase, a, l, r, score of all phrases of two and more words: the cut with the least score, the first of equals."""
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = phrases.where("k > 1").withColumn("cut", cut).withColumns({
        "first": F.array_join(F.slice(words, 1, F.col("cut")), " "), "rest": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " "),
    })
    known = phrases.select("lang", "phrase", "a")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    least = F.min(F.struct(exact_score("a", "l", "r").alias("score"), "cut", "l", "r")).alias("least")
    return cuts.groupBy("lang", "k", "phrase", "a").agg(least).select("lang", "k", "phrase", "a", "least.l", "least.r", "least.score")


def not_covered(candidates: DataFrame, phrases: DataFrame, percent: int = COVERED) -> DataFrame:
    """Candidates that don't lie inside a longer one with at least `percent` % of their occurrences."""
    words = F.split("phrase", " ")
    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")),
    )))
    longer = phrases.where("k > 2").select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def first_of_each(rows: DataFrame, n: int, order: list[Column], bucket: int = 200_000, narrow: int = 50) -> DataFrame:
    """The first `n` rows of each lang with their `rank`; many rows are first thinned out in buckets, so no task sorts them all."""
    def ranked(df: DataFrame, *by: str | Column) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= n)

    buckets = rows.count() // bucket + 1
    while buckets > 1:
        rows = ranked(rows, "lang", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
        buckets = buckets // narrow if buckets > narrow else 1
    return ranked(rows, "lang")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = COVERED, top: int = TOP, chunk_bytes: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases by score.

    Case counts for letters other than A to Z. Breaks end pieces and no phrase crosses them; words are what blanks and
    tabs separate. NULL text is empty, NULL lang is `und`. Repeated rows count each; an empty table gives an empty one.
    Ties go by occurrences, then by the phrase's bytes, so no two rows share a rank.
    """
    packed = chunks(docs, chunk_bytes)
    phrases = stored(frequent_phrases(packed, least), "phrases")
    totals = packed.groupBy("lang").agg(F.sum("n_words").alias("n"))
    candidates = stored(not_covered(scored(phrases), phrases, percent), "scored")
    best = first_of_each(candidates, top, [F.desc("score"), F.desc("a"), F.asc("phrase")])
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
