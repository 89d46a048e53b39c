"""Removal of repeated passages by sorting suffixes, deep and shallow.

Only suffixes that can matter are sorted. Each window of LENGTH bytes has an anchor, the place of its least
GRAM-byte hash, so equal windows have equal anchors at equal places; the windows of one anchor are one short
stretch of text. Stretches whose anchor occurs in one document alone are dropped. The others meet by anchor,
where the suffixes at their windows are sorted: a multikey quicksort by eight bytes a step down to a shallow
depth, and blind tries for the groups that are still together. Suffixes that stay together to full depth are
one window, and its owner is the least document. Hashes bring together what may be equal; what is removed has
been compared byte by byte.

Documents travel in chunks of rows. A chunk sends each different stretch once, with the least document that
has it, so a passage that a third of all documents share is one row a chunk. At its edges, stretches differ in
every document though they have one anchor. The windows of an anchor with more than HOT different stretches are
therefore dealt out by a hash of all their bytes, which equal windows share, and sorted in those parts: dealt by
their first bytes, those at the edges of a passage would stay together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import text_or_empty
from hexheat.llm.groups import group_bounds, whole_groups

LENGTH, GRAM = 50, 24
SHALLOW = 24
CHUNK_BITS = 9
BUCKET_BYTES = 4 << 20
HOT = 1 << 12
# A longer text is a chunk of its own, so a chunk of rows holds 512 times this at most, or one text.
LONG_TEXT = 1 << 16
PIECE = 1 << 19
BLOCK = 1 << 18
NO_ID = np.iinfo(np.int64).max
PRIME = 0x9E3779B97F4A7C15
U = np.uint64


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM = 16 + 8 bytes from each place on."""
    power = lambda e: U(pow(PRIME, e, 2**64))
    h = text.astype(np.uint64) + U(1)
    for width in (1, 2, 4):
        h = h[:-width] * power(width) + h[width:]
    eight = h
    h = h[:-8] * power(8) + h[8:]
    return scrambled(h[:len(h) - 8] * power(8) + eight[16:])


def anchors(hashes: np.ndarray) -> np.ndarray:
    """For each window, the place of the least hash of its grams, the leftmost of equals."""
    span = LENGTH - GRAM + 1
    n = len(hashes) - span + 1
    out = np.empty(max(n, 0), np.int64)
    low = U((1 << 20) - 1)
    for at in range(0, n, BLOCK):
        part = hashes[at:at + BLOCK + span - 1]
        m = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[:len(m) - (span - width)], m[span - width:])
        out[at:at + len(m)] = (m & low).astype(np.int64) + at
    return out


class Stretches:
    """The stretches of a chunk: start, anchor, number of windows, document, anchor's hash, and a name of the whole stretch.

    Texts are gone through PIECE bytes at a time, so what is held for each byte is bounded. A longer text is
    cut into pieces that overlap by a window; a stretch at such a cut comes in two parts.
    """

    def __init__(self, docs: list[bytes], ids: np.ndarray) -> None:
        lengths = np.array([len(d) for d in docs], np.int64)
        self.text = np.frombuffer(b"".join(docs), np.uint8)
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        parts = [self.piece(a, b) for a, b in self.pieces()]
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        self.start, self.anchor, self.windows, self.hash, self.name = (np.concatenate(x) for x in zip(empty, *parts))
        self.doc = ids[np.searchsorted(self.ends, self.start, side="right")] if len(self.start) else np.zeros(0, np.int64)

    def pieces(self) -> Iterator[tuple[int, int]]:
        """Ranges of bytes: some whole texts, or a part of a long one."""
        begin = 0
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            if b - begin > PIECE and a > begin:
                yield begin, a
                begin = a
            while b - begin > PIECE + LENGTH:
                yield begin, begin + PIECE + LENGTH - 1
                begin += PIECE
        if begin < len(self.text):
            yield begin, len(self.text)

    def piece(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        if b - a < LENGTH:
            return (*[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2)
        hashes = gram_hashes(self.text[a:b])
        anchor = anchors(hashes)
        lo, hi = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.starts, b, side="left")
        ends = np.minimum(self.ends[lo:hi], b) - a
        end = np.repeat(ends, np.diff(ends, prepend=0))[:len(anchor)]
        whole = np.arange(len(anchor)) + LENGTH <= end
        first = whole.copy()
        first[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1]) | (end[1:] != end[:-1])
        start = np.flatnonzero(first)
        windows = np.add.reduceat(whole.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        anchor = anchor[start]
        return start + a, anchor + a, windows, hashes[anchor], names(hashes, start, windows)


def names(hashes: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """A hash of each whole stretch: four grams cover every byte of it."""
    end = start + windows + LENGTH - 1
    name = windows.astype(np.uint64)
    for at in (start, start + GRAM, end - 2 * GRAM, end - GRAM):
        name = scrambled(name * U(PRIME) + hashes[at])
    return name


def short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U(16)


def chunk_parts(t: pa.Table) -> Iterator[tuple[int, list[bytes], np.ndarray, pa.Table]]:
    """chunk, texts as bytes, ids, rows for each chunk of a table that holds whole chunks."""
    chunk = t.column("chunk").to_numpy()
    bounds = group_bounds(chunk)
    for a, b in zip(bounds[:-1], bounds[1:]):
        part = t.slice(a, b - a)
        yield int(chunk[a]), *chunk_rows(part), part


def chunk_rows(part: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Texts and ids in the order of the rows' numbers."""
    part = part.take(pa.array(np.argsort(part.column("row").to_numpy(), kind="stable")))
    ids = part.column("doc_id").fill_null(int(NO_ID)).to_numpy()
    return [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()], ids


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """bucket and indexes of the hashes in it, in order of their short hashes."""
    bucket = (hashes % U(buckets)).astype(np.int64)
    order = np.lexsort((short(hashes), bucket))
    bounds = group_bounds(bucket[order])
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b > a:
            yield int(bucket[order[a]]), order[a:b]


def wanted_hashes(s: Stretches, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """bucket, its different short anchor hashes, sorted, and for each the least power of two that its different stretches don't exceed."""
    fresh = np.zeros(len(s.name))
    fresh[np.unique(s.name, return_index=True)[1]] = 1
    for bucket, at in by_bucket(s.hash, buckets):
        own, place = np.unique(short(s.hash[at]), return_inverse=True)
        n = np.maximum(np.bincount(place, fresh[at]), 1)
        yield bucket, own, np.ceil(np.log2(n)).astype(np.uint8)


def pack_six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed piece."""
    raw = b"".join([np.array([a.nbytes for a in arrays], np.int64).tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, int(n) // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def least_by(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, NO_ID)
    np.minimum.at(out, group, value)
    return out


def window_names(s: Stretches, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the windows of the stretches `at`, some stretches at a time: place of the stretch in `at`, number of the window, its name."""
    for low in range(0, len(at), BLOCK // LENGTH):
        some = at[low:low + BLOCK // LENGTH]
        n = s.windows[some]
        sizes = n + LENGTH - 1
        number = ranges(np.zeros(len(some), np.int64), n)
        start = np.repeat(np.cumsum(sizes) - sizes, n) + number
        hashes = gram_hashes(s.text[ranges(s.start[some], sizes)])
        yield low + np.repeat(np.arange(len(some)), n), number, names(hashes, start, np.ones(len(start), np.int64))


def window_bytes(s: Stretches, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of the stretches `at`: place of the stretch in `at`, number, start in the text, name."""
    parts = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)]
    of, number, name = (np.concatenate(x) for x in zip(parts, *window_names(s, at)))
    return of, number, s.start[at[of]] + number, name


def different_windows(s: Stretches, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the windows of the stretches `at`, each different one: number of its stretch, its number in it, the least and
    the greatest document that has it, its bytes, its name."""
    of, number, start, name = window_bytes(s, at)
    class_of, first = classes(s.text, start, np.full(len(start), LENGTH), name, s.hash[at[of]])
    doc = s.doc[at[of]]
    least, most = least_by(class_of, doc, len(first)), -least_by(class_of, -doc, len(first))
    text = s.text[ranges(start[first], np.full(len(first), LENGTH))]
    return at[of[first]], number[first], least, most, text, name[first]


def classes(text: np.ndarray, start: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each piece of text, and a piece of each class: pieces of one class are the same bytes.

    Pieces with equal keys and sizes are held against the first of them; what differs, as where hashes collide, is told
    apart by its bytes.
    """
    order = np.lexsort((size, *keys))
    bounds = group_bounds(*[k[order] for k in keys], size[order])
    members = np.diff(bounds)
    class_of = np.empty(len(start), np.int64)
    class_of[order] = np.repeat(np.arange(len(members)), members)
    first = order[bounds[:-1]]
    differs = []
    others = np.flatnonzero(first[class_of] != np.arange(len(start)))
    for at in np.split(others, np.flatnonzero(np.diff(np.cumsum(size[others]) // BLOCK)) + 1) if len(others) else []:
        apart = text[ranges(start[at], size[at])] != text[ranges(start[first[class_of[at]]], size[at])]
        if apart.any():
            differs.append(at[np.unique(np.repeat(np.arange(len(at)), size[at])[apart])])
    if differs:
        known: dict[tuple[int, bytes], int] = {}
        more = []
        for i in np.concatenate(differs).tolist():
            key = (int(class_of[i]), text[start[i]:start[i] + size[i]].tobytes())
            if key not in known:
                known[key] = len(first) + len(more)
                more.append(i)
            class_of[i] = known[key]
        first = np.concatenate([first, np.array(more, np.int64)])
    return class_of, first


class BlindTrie:
    """Strings of one length in a trie whose inner nodes know only their depth and their branching bytes."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, text: bytes, leaf: int) -> int:
        """The number of the leaf that holds the text: `leaf` if it is new."""
        if self.root is None:
            self.root = [-1, text, leaf]
            return leaf
        node = self.root
        while node[0] >= 0:  # blind: a byte without a branch goes down any one
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[1]
        if other == text:
            return node[2]
        depth = next(i for i, (a, b) in enumerate(zip(text, other)) if a != b)
        parent, node = None, self.root
        while 0 <= node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        new = [-1, text, leaf]
        if node[0] == depth:
            node[1][text[depth]] = new
            return leaf
        inner = [depth, {text[depth]: new, other[depth]: node}]
        if parent is None:
            self.root = inner
        else:
            parent[1][text[parent[0]]] = inner
        return leaf


def equal_windows(text: np.ndarray, place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes at `place`, the indexes of those that equal another of their group over LENGTH bytes, and their class.

    Suffixes that part from all others on the way down are left out at once.
    """
    word = text.astype(np.uint64)
    for width in (1, 2, 4):
        word = (word[:-width] << U(8 * width)) | word[width:]
    at = np.arange(len(place))
    for depth in range(0, SHALLOW, 8):
        key = word[place[at] + depth]
        order = np.lexsort((key, group[at]))
        at, key = at[order], key[order]
        bounds = group_bounds(group[at], key)
        sizes = np.diff(bounds)
        group = group.copy()
        group[at] = np.repeat(np.arange(len(sizes)), sizes)
        at = at[np.repeat(sizes > 1, sizes)]
        if not len(at):
            return at, at
    data = text.tobytes()
    rest = [data[p + SHALLOW:p + LENGTH] for p in place[at].tolist()]
    leaf: list[int] = []
    bounds = group_bounds(group[at]).tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a == 2:  # a trie of one leaf
            leaf += (a, a if rest[a] == rest[a + 1] else a + 1)
            continue
        trie = BlindTrie()
        leaf += [trie.insert(rest[i], i) for i in range(a, b)]
    return at, np.array(leaf)


def held_elsewhere(name: np.ndarray, hash_: np.ndarray, owner: np.ndarray, windows: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a document below the stretch's own has: index of the stretch, first and last window.

    The stretches are all those of the anchors at hand, their bytes one after the other in `text`.
    """
    sizes = windows + LENGTH - 1
    starts = np.cumsum(sizes) - sizes
    class_of, first = classes(text, starts, sizes, name, hash_)
    order = np.argsort(hash_[first], kind="stable")
    first, place = first[order], np.argsort(order)
    class_of = place[class_of]
    members = np.bincount(class_of, minlength=len(first))
    least = least_by(class_of, owner, len(members))
    anchor_bounds = group_bounds(hash_[first])
    alone = np.repeat(np.diff(anchor_bounds) == 1, np.diff(anchor_bounds))
    group = np.repeat(np.arange(len(anchor_bounds) - 1), np.diff(anchor_bounds))
    # Windows of the classes that meet others at their anchor.
    shared = np.flatnonzero(~alone)
    n = windows[first[shared]]
    place, of = ranges(starts[first[shared]], n), np.repeat(shared, n)
    offset = np.cumsum(n) - n
    best = least[of]
    if len(place):
        at, leaf = equal_windows(text, place, group[of])
        if len(at):
            low = least_by(leaf, best[at], int(leaf.max()) + 1)
            best[at] = low[leaf]
    begin = np.zeros(len(members), np.int64)
    begin[shared] = offset
    whole = np.flatnonzero(alone[class_of] & (least[class_of] < owner))
    some = np.flatnonzero(~alone[class_of])
    k = windows[some]
    each = np.repeat(some, k)
    number = ranges(np.zeros(len(some), np.int64), k)
    hit = best[ranges(begin[class_of[some]], k)] < owner[each]
    each, number = each[hit], number[hit]
    runs = np.flatnonzero(np.concatenate([[True], (each[1:] != each[:-1]) | (number[1:] != number[:-1] + 1)])) if len(each) else np.zeros(0, np.int64)
    last = np.concatenate([runs[1:], [len(each)]]) - 1 if len(runs) else runs
    return (
        np.concatenate([whole, each[runs]]),
        np.concatenate([np.zeros(len(whole), np.int64), number[runs]]),
        np.concatenate([windows[whole] - 1, number[last]]),
    )


# Stretches and windows of a chunk are known by the stretch's number in it.
STRETCH_KINDS = ("<i8", "<i4", "u1", "u1", "u1")
REPLY_KINDS = ("<i4", "u1", "u1")
WINDOW_KINDS = ("<i4", "u1", "<i8", "<i8", "u1")
WINDOW_REPLY_KINDS = ("<i4", "u1", "<i8")


def in_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text, row, chunk: rows in their order, those with long texts apart and each a chunk of its own."""
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    long = F.octet_length("text") > LONG_TEXT
    return rows.where(~long).withColumn("chunk", F.shiftright("row", CHUNK_BITS)).unionByName(rows.where(long).withColumn("chunk", -F.col("row") - 1))


def n_buckets(docs: DataFrame) -> int:
    return max(64, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)


def sent_pieces(rows: DataFrame, buckets: int, hot: int) -> DataFrame:
    """What chunks send: chunk, bucket, n, data. Buckets from `buckets` on hold windows of hot anchors, those below hold stretches."""

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["chunk"], 1):
            for chunk, texts, ids, _ in chunk_parts(t):
                found = list(wanted_hashes(Stretches(texts, ids), buckets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(found), pa.int64()), pa.array([b for b, *_ in found], pa.int64()),
                     pa.array([pack_six(h) + n.tobytes() for _, h, n in found], pa.binary())],
                    ["chunk", "bucket", "data"],
                )

    def mark_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket"], 1):
            bucket = t.column("bucket").to_numpy()
            bounds = group_bounds(bucket)
            for a, b in zip(bounds[:-1], bounds[1:]):
                part = t.slice(a, b - a)
                data = [x.as_py() for x in part.column("data")]
                lists = [unpack_six(x[:len(x) // 7 * 6]) for x in data]
                counts = np.concatenate([np.frombuffer(x[len(x) // 7 * 6:], np.uint8) for x in data])
                _, place, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
                marks = np.stack([n[place] > 1, np.bincount(place, 2.0 ** counts)[place] > hot])
                marks = np.split(marks, np.cumsum([len(x) for x in lists])[:-1], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("chunk").combine_chunks(), part.column("bucket").combine_chunks(), pa.array([np.packbits(m, axis=1).tobytes() for m in marks], pa.binary())],
                    ["chunk", "bucket", "data"],
                )

    def send_stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, bytes]] = []
        if left.num_rows:
            chunk = int(left.column("chunk")[0].as_py())
            texts, ids = chunk_rows(left)
            s = Stretches(texts, ids)
            by_window = [np.zeros(0, np.int64)]
            marks = dict(zip(right.column("bucket").to_pylist(), right.column("data").to_pylist()))
            for bucket, at in by_bucket(s.hash, buckets):
                hashes = short(s.hash[at])
                own = np.unique(hashes)
                marked = np.frombuffer(marks[bucket], np.uint8).reshape(2, -1)
                shared, crowded = np.unpackbits(marked, axis=1, count=len(own)).astype(bool)
                # Or the anchor is in several documents of this chunk.
                place = np.searchsorted(own, hashes)
                low, high = least_by(place, s.doc[at], len(own)), -least_by(place, -s.doc[at], len(own))
                by_window.append(at[crowded[place]])
                at = at[((shared | (low < high)) & ~crowded)[place]]
                if not len(at):
                    continue
                class_of, first = classes(s.text, s.start[at], s.windows[at] + LENGTH - 1, s.name[at])
                owner, at = least_by(class_of, s.doc[at], len(first)), at[first]
                text = s.text[ranges(s.start[at], s.windows[at] + LENGTH - 1)]
                offset = (s.anchor[at] - s.start[at]).astype(np.uint8)
                out.append((chunk, bucket, len(at), pack(owner, at.astype(np.int32), offset, s.windows[at].astype(np.uint8), text)))
            at = np.concatenate(by_window)
            if len(at):
                stretch, number, least, most, text, name = different_windows(s, at)
                bucket = (name % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bounds = group_bounds(bucket[order])
                text = text.reshape(-1, LENGTH)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    own = order[a:b]
                    data = pack(stretch[own].astype(np.int32), number[own].astype(np.uint8), least[own], most[own], text[own].ravel())
                    out.append((chunk, buckets + int(bucket[own[0]]), len(own), data))
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table({
            "chunk": pa.array(cols[0], pa.int64()), "bucket": pa.array(cols[1], pa.int64()),
            "n": pa.array(cols[2], pa.int64()), "data": pa.array(cols[3], pa.binary()),
        })

    listed = rows.mapInArrow(list_anchors, "chunk long, bucket long, data binary")
    marks = listed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(mark_shared, "chunk long, bucket long, data binary")
    return rows.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(send_stretches, "chunk long, bucket long, n long, data binary")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans (array of start, end in bytes), kept (binary, what is left).

    A byte is in a span when a LENGTH-byte string over it also starts in a document with a smaller doc_id.
    NULL text is empty. A document with a NULL id comes after all others; repeated rows of one id don't make
    each other repeat. Texts shorter than LENGTH have no spans. Other columns are not read. Anchors of more than
    `hot` different stretches are dealt out by window.
    """
    rows = in_chunks(docs)
    buckets = n_buckets(docs)

    def match_windows(part: pa.Table) -> Iterator[tuple[int, bytes]]:
        """chunk and its windows that a document below the chunk's greatest has."""
        pieces = [unpack(x.as_py(), *WINDOW_KINDS) for x in part.column("data")]
        stretch, number, least, most, text = (np.concatenate(x) for x in zip(*pieces))
        low = least.copy()
        # Suffixes are read eight bytes a step: the last ones have some to spare.
        at, leaf = equal_windows(np.concatenate([text, np.zeros(8, np.uint8)]), np.arange(len(least)) * LENGTH, np.zeros(len(least), np.int64))
        if len(at):
            low[at] = least_by(leaf, least[at], int(leaf.max()) + 1)[leaf]
        ends = np.cumsum([len(p[0]) for p in pieces]).tolist()
        for chunk, i, j in zip(part.column("chunk").to_pylist(), [0, *ends[:-1]], ends):
            at = i + np.flatnonzero(low[i:j] < most[i:j])
            if len(at):
                yield chunk, pack(stretch[at], number[at], low[at])

    def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["bucket"], 1):
            bounds = group_bounds(t.column("bucket").to_numpy())
            for a, b in zip(bounds[:-1], bounds[1:]):
                part = t.slice(a, b - a)
                if part.column("bucket")[0].as_py() >= buckets:
                    cut = list(match_windows(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([c for c, _ in cut], pa.int64()), pa.array([True] * len(cut), pa.bool_()), pa.array([d for _, d in cut], pa.binary())],
                        ["chunk", "by_window", "data"],
                    )
                    continue
                pieces = [unpack(x.as_py(), *STRETCH_KINDS) for x in part.column("data")]
                owner, number, offset, windows, text = (np.concatenate(x) for x in zip(*pieces))
                windows = windows.astype(np.int64)
                start = np.cumsum(windows + LENGTH - 1) - (windows + LENGTH - 1)
                hashes = gram_hashes(text)
                hash_, name = hashes[start + offset], names(hashes, start, windows)
                chunk = np.repeat(part.column("chunk").to_numpy(), [len(p[0]) for p in pieces])
                of, first, last = held_elsewhere(name, hash_, owner, windows, text)
                order = np.argsort(chunk[of], kind="stable")
                of, first, last = of[order], first[order].astype(np.uint8), last[order].astype(np.uint8)
                ends = group_bounds(chunk[of])
                cut = [(int(chunk[of[i]]), pack(number[of[i:j]], first[i:j], last[i:j])) for i, j in zip(ends[:-1], ends[1:]) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in cut], pa.int64()), pa.array([False] * len(cut), pa.bool_()), pa.array([d for _, d in cut], pa.binary())],
                    ["chunk", "by_window", "data"],
                )

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, ids = chunk_rows(left)
        s = Stretches(texts, ids)
        change = np.zeros(len(s.text) + 1, np.int64)
        if len(s.start):
            place, firsts = classes(s.text, s.start, s.windows + LENGTH - 1, s.name)
            later = s.doc > least_by(place, s.doc, len(firsts))[place]
            np.add.at(change, s.start[later], 1)
            np.add.at(change, s.start[later] + s.windows[later] + LENGTH - 1, -1)
            replies = [[], []]
            for by_window, data in zip(right.column("by_window").to_pylist(), right.column("data").to_pylist()):
                replies[by_window].append(data)
            if replies[True]:
                stretch, number, low = (np.concatenate(x) for x in zip(*[unpack(x, *WINDOW_REPLY_KINDS) for x in replies[True]]))
                at = np.flatnonzero(np.isin(s.hash, s.hash[stretch]))
                of, own, start, name = window_bytes(s, at)
                class_of, first = classes(s.text, start, np.full(len(start), LENGTH), name, s.hash[at[of]])
                # The window that stands for its class in the reply, and with it the least document of all chunks.
                begins = np.searchsorted(of, np.arange(len(at)))
                told = class_of[begins[np.searchsorted(at, stretch)] + number]
                least = least_by(told, low, len(first))
                hit = least[class_of] < s.doc[at[of]]
                np.add.at(change, start[hit], 1)
                np.add.at(change, start[hit] + LENGTH, -1)
            if replies[False]:
                stretch, first, last = (np.concatenate(x) for x in zip(*[unpack(x, *REPLY_KINDS) for x in replies[False]]))
                order = np.argsort(place, kind="stable")
                bounds = np.searchsorted(place[order], np.arange(len(firsts) + 1))
                at = place[stretch]
                n = bounds[at + 1] - bounds[at]
                here = order[ranges(bounds[at], n)]
                first, last = np.repeat(first, n).astype(np.int64), np.repeat(last, n).astype(np.int64)
                np.add.at(change, s.start[here] + first, 1)
                np.add.at(change, s.start[here] + last + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans, kept = [], []
        for a, b in zip(s.starts, s.ends):
            step = np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
            kept.append(s.text[a:b][~gone[a:b]].tobytes())
        return pa.table({
            "doc_id": left.column("doc_id"), "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
        })

    sent = sent_pieces(rows, buckets, hot).drop("n")
    replies = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort_suffixes, "chunk long, by_window boolean, data binary")
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        cut_out, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs`."""
    return repeated_spans(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
