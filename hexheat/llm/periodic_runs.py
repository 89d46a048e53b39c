"""Runs of repeated words in a text: stretches that are at least four times as long as their period.

Two places p words apart that lie in such a run agree for a while, so it is enough to look at places on a grid
whose step grows with p; over all p that is a harmonic sum. Where the words of a grid place and of the place p
further on agree, the longest common extension of the two, forwards and backwards, gives the run. Extensions
come from suffixes at the places of a difference cover only: any two places reach two of them by the same, short
step, whose words are compared; the rest is the least common prefix between neighbours in the order of suffixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import free_name
from hexheat.llm.groups import group_bounds

# Every difference modulo 31 is that of two members.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# Texts of about so many characters are searched together; a longer one alone.
CHARS_AT_ONCE = 1 << 22
# Pairs of places whose extensions are looked up together.
PAIRS_AT_ONCE = 1 << 19

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _steps() -> np.ndarray:
    """For two remainders, the least step that leads both into the cover."""
    in_cover = np.isin(np.arange(MODULUS), COVER)
    steps = np.full((MODULUS, MODULUS), -1)
    for s in reversed(range(MODULUS)):
        hit = np.roll(in_cover, -s)
        steps[np.ix_(hit, hit)] = s
    return steps


STEPS = _steps()
PLACE = np.full(MODULUS, -1)
PLACE[COVER] = np.arange(len(COVER))


class Extensions:
    """Longest common extensions of places in `symbols`, whose parts (equal `part`) end in a symbol found nowhere else."""

    def __init__(self, symbols: np.ndarray, part: np.ndarray) -> None:
        self.symbols = symbols
        at = (np.arange(len(symbols) // MODULUS + 1)[:, None] * MODULUS + COVER).ravel()
        self.at = at[at < len(symbols)]
        order, names = self._sorted(part)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self._tables(order, names, part)

    def sample(self, place: np.ndarray) -> np.ndarray:
        return place // MODULUS * len(COVER) + PLACE[place % MODULUS]

    def _sorted(self, part: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Sampled suffixes in order, those of one part together, and names of their first 31, 62, 124, … symbols."""
        base = int(self.symbols.max()) + 2
        packed = max(1, 62 // base.bit_length())
        padded = np.concatenate([self.symbols, np.full(MODULUS + packed, -1)]) + 1
        order = np.argsort(part[self.at], kind="stable")
        name = np.empty(len(order), np.int64)
        tied = np.arange(len(order))
        bounds = group_bounds(part[self.at][order])
        name[order] = np.repeat(bounds[:-1], np.diff(bounds))
        for first in range(0, MODULUS, packed):
            places, key = self.at[order[tied]] + first, 0
            for k in range(min(packed, MODULUS - first)):
                key = key * base + padded[places + k]
            tied = self._refined(order, name, tied, key)
        names = [name.copy()]
        length = MODULUS
        while len(tied):
            # What is tied agrees in `length` symbols, none of which ends its part, so the place after them is there.
            key = names[-1][self.sample(self.at[order[tied]] + length)]
            tied = self._refined(order, name, tied, key)
            names.append(name.copy())
            length *= 2
        return order, names

    @staticmethod
    def _refined(order: np.ndarray, name: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Sorts the tied places of `order` by name and key, names them anew, and returns the places still tied."""
        if not len(tied):
            return tied
        of = name[order[tied]]
        by = np.lexsort((key, of))
        order[tied] = order[tied[by]]
        bounds = group_bounds(of[by], key[by])
        sizes = np.diff(bounds)
        name[order[tied]] = np.repeat(tied[bounds[:-1]], sizes)
        return tied[np.repeat(sizes > 1, sizes)]

    def _tables(self, order: np.ndarray, names: list[np.ndarray], part: np.ndarray) -> None:
        """Common prefixes of neighbours, and their least over 1, 2, 4, … neighbours."""
        a, b = self.at[order[:-1]], self.at[order[1:]]
        common = np.zeros(len(a), np.int64)
        same = np.flatnonzero(part[a] == part[b])
        for k in reversed(range(len(names))):
            agree = names[k][self.sample(a[same] + common[same])] == names[k][self.sample(b[same] + common[same])]
            common[same[agree]] += MODULUS << k
        limit = np.full(len(same), MODULUS)
        common[same] += self._compared(a[same] + common[same], b[same] + common[same], limit)
        self.least = [common]
        widest = int(np.diff(group_bounds(part[self.at][order])).max(initial=1))
        while 2 << (len(self.least) - 1) <= widest:
            t, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(t[:-half], t[half:]))

    def _compared(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many symbols agree from two places, up to a limit for each."""
        out, todo, n = limit.copy(), np.flatnonzero(limit > 0), 0
        while len(todo):
            agree = self.symbols[i[todo] + n] == self.symbols[j[todo] + n]
            out[todo[~agree]] = n
            n += 1
            todo = todo[agree]
            todo = todo[limit[todo] > n]
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols agree from places `i` and `j` on, each two different places of one part."""
        step = STEPS[i % MODULUS, j % MODULUS]
        out = self._compared(i, j, step)
        on = np.flatnonzero(out == step)
        x, y = self.rank[self.sample(i[on] + step[on])], self.rank[self.sample(j[on] + step[on])]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        least = np.empty(len(on), np.int64)
        # Suffixes of different parts, which only a part's end leads to, agree in nothing.
        least[level >= len(self.least)] = 0
        for k in range(len(self.least)):
            at = np.flatnonzero(level == k)
            least[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        out[on] += least
        return out


def grid_pairs(words: np.ndarray, part: np.ndarray, sizes: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places on the grid, and periods, where two words agree with the two that lie one period further on.

    Parts lie in descending order of their sizes. A run of period p holds (exponent - 1) * p places in a row that
    agree with the place p further on; one of the first (exponent - 2) * p is on the grid, so at least p + 1 agree
    from there on, or, for p = 1, two at the least.
    """
    ends = np.cumsum(sizes)
    at, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(1, int(sizes.max(initial=0)) // exponent + 1):
        wide = int(np.searchsorted(-sizes, -max(least, exponent * p), side="right"))
        if not wide:
            break
        n, step = int(ends[wide - 1]), (exponent - 2) * p
        hit = np.flatnonzero(words[0:n - p - 1:step] == words[p:n - 1:step]) * step
        if len(hit):
            hit = hit[words[hit + 1] == words[hit + p + 1]]
            at.append(hit)
            periods.append(np.full(len(hit), p))
    at, periods = np.concatenate(at), np.concatenate(periods)
    one = part[at] == part[at + periods + 1]
    return at[one], periods[one]


def runs_of(listed: list[list[bytes]], least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, ...]:
    """Text number, start, length and period of all runs in lists of words, by text, start and period."""
    counts = np.array([len(x) for x in listed], np.int64)
    by_size = np.argsort(-counts, kind="stable")
    sizes = counts[by_size]
    total = int(sizes.sum())
    words = pa.array((w for k in by_size for w in listed[k]), pa.large_binary(), size=total).dictionary_encode().indices.to_numpy()
    part = np.repeat(np.arange(len(sizes)), sizes)
    at, period = grid_pairs(words, part, sizes, least, exponent)
    # Only texts with such a pair are sorted; each of them stands between two symbols found nowhere else.
    used, place = np.unique(part[at], return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    inner = np.concatenate([[0], np.cumsum(sizes[used])])
    symbols = np.empty(int(inner[-1]) + len(used) + 1, np.int64)
    marks = inner + np.arange(len(used) + 1)
    is_word = np.ones(len(symbols), bool)
    is_word[marks] = False
    symbols[is_word] = words[np.isin(part, used)]
    symbols[marks] = int(words.max(initial=0)) + 1 + np.arange(len(marks))
    found = [np.zeros((4, 0), np.int64)]
    if len(used):
        inside = np.cumsum(~is_word)
        after = Extensions(symbols, inside - (~is_word))
        # Backwards from the places before; the mark before a text is met at most once, as it agrees with nothing.
        before = Extensions(symbols[::-1].copy(), inside[::-1].copy())
        last = len(symbols) - 1
        for some in range(0, len(at), PAIRS_AT_ONCE):
            own, p, mark = at[some:some + PAIRS_AT_ONCE], period[some:some + PAIRS_AT_ONCE], marks[place[some:some + PAIRS_AT_ONCE]]
            i = own - starts[part[own]] + mark + 1
            back = before.common(last - (i + p - 1), last - (i - 1))
            length = back + after.common(i, i + p) + p
            ok = length >= np.maximum(least, exponent * p)
            found.append(least_periods(np.stack([by_size[part[own]], i - back - mark - 1, length, p])[:, ok]))
    of, start, length, period = least_periods(np.concatenate(found, axis=1))
    order = np.lexsort((period, start, of))
    return of[order], start[order], length[order], period[order]


def least_periods(runs: np.ndarray) -> np.ndarray:
    """Text, start, length and period of different runs. One turns up with multiples of its period too: the least counts."""
    of, start, length, period = runs
    order = np.lexsort((period, length, start, of))
    return runs[:, order][:, group_bounds(of[order], start[order], length[order])[:-1]] if len(order) else runs


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words without what a run holds after its first period."""
    if not len(start):
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, start + period, 1)
    np.add.at(inside, start + length, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(inside)[:-1] == 0)]


def portions(texts: list[str | None], most: int) -> Iterator[list[str]]:
    """Texts in order, NULL as empty, about `most` characters a time."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def periodic_runs(
    docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT,
    prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, key: str = "doc_id",
) -> DataFrame:
    """`docs` with `runs`, an array of start, length and period counted in words, by start and period, and `collapsed`,
    the words that no run holds after its first period, joined by one space (under longer names where it has such columns).

    Words are what ASCII white space separates. A run has its least period, is at least `least` words and `exponent`
    (3 or more) periods long, and no neighbouring word continues it. NULL and empty texts have no run and an empty
    `collapsed`. Repeated rows are searched each, an empty table gives an empty one. A text is searched as a whole,
    however long. `prepare` may change the words of a row, given its `key`, before they are searched.
    """
    if exponent < 3 or least < exponent:
        raise ValueError("runs are at least three periods and as many words long")
    runs, rest = free_name(docs, "runs"), free_name(docs, "collapsed")
    kinds = [f"`{c}` {k}" for c, k in docs.dtypes]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keys, done = x.column(key).to_pylist() if prepare else [], 0
            for held in portions(x.column(text).to_pylist(), CHARS_AT_ONCE):
                listed = [t.encode().split() for t in held]
                part = x.slice(done, len(held))
                if prepare:
                    listed = [prepare(k, w) for k, w in zip(keys[done:done + len(held)], listed)]
                done += len(held)
                of, start, length, period = runs_of(listed, least, exponent)
                ends = np.searchsorted(of, np.arange(len(listed) + 1))
                left = [
                    b" ".join(collapsed(w, start[a:b], length[a:b], period[a:b]))
                    for w, a, b in zip(listed, ends[:-1].tolist(), ends[1:].tolist())
                ]
                found = pa.StructArray.from_arrays([pa.array(v) for v in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), pa.array(left, pa.binary()).cast(pa.string())],
                    [*part.schema.names, runs, rest],
                )

    return docs.mapInArrow(work, ", ".join([*kinds, f"`{runs}` array<{RUN}>", f"`{rest}` string"]))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, a tenth of which repeat a stretch to their end: by the checksum of the id, none without id."""
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equals; NULL where there is none."""
    return F.aggregate(
        runs, F.lit(None).cast(RUN),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and digests of all runs and of the collapsed words, of every row of `docs`."""
    found = periodic_runs(docs.select("doc_id", "text"), prepare=planted).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
