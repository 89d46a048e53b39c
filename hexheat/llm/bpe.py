"""BPE encoding and decoding by speculation.

A greedy longest match proposes the tokens of each distinct word. A row of tokens is what merging would give
exactly when every token merges to itself and every adjacent pair of them merges to that pair, so pairs are
checked, all at once; only words with a failing pair are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import free_name

VOCABULARY = "word_bpe_49k.json"
WORDS_KEPT = 700_000
SHORT = 48
NEVER = 1 << 60
CHARS_AT_ONCE = 1 << 20


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """A byte-level BPE vocabulary with a word-end suffix, as in the JSON files of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        ids = model["vocab"]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in (*ids.items(), *self.special.items()):
            self.tokens[i] = token
        self.letters = byte_letters()
        self.inside, self.last = {}, {}
        for token, i in ids.items():
            if token.endswith(self.suffix):
                self.last[token[:-len(self.suffix)]] = i
            else:
                self.inside[token] = i
        self.longest = max(map(len, self.inside))
        self.longest_last = max(map(len, self.last))
        # Step k joins left[k] and right[k] to made[k]; born is the step that made a token, -1 for letters.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.step_of: dict[tuple[int, int], int] = {}
        self.made_by: list[int] = []
        self.born = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for step, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = ids[a], ids[b], ids[a + b]
            self.merges[left, right] = (step, made)
            self.step_of[left, right] = step
            self.made_by.append(made)
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = step, left, right
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.steps = keys[order], np.array([x[0] for x in self.merges.values()], np.int64)[order]
        self.size = size
        pattern = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.own = np.array([self.merged_letters(i) for i in range(size)])
        self.kept: dict[str, list[int]] = {}

    def merged_letters(self, token: int) -> bool:
        """Whether the token's letters merge back to it."""
        if self.tokens[token] in self.special or self.born[token] < 0:
            return True
        text = self.tokens[token]
        ended = text.endswith(self.suffix)
        return self.merge(text[:-len(self.suffix)] if ended else text, ended) == [token]

    def merge(self, letters: str, ended: bool = True) -> list[int]:
        """Exact merging: always the earliest step, the leftmost of equals."""
        n = len(letters)
        row = [self.inside[x] for x in letters]
        if ended:
            row[-1] = self.last[letters[-1]]
        if n <= SHORT:
            return self.merge_short(row)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(m[0], i, m[1], row[i], row[i + 1]) for i in range(n - 1) if (m := self.merges.get((row[i], row[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if row[i] != a or j >= n or row[j] != b:
                continue
            row[i], row[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merges.get((made, row[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], made, row[after[i]]))
            if (h := before[i]) >= 0 and (m := self.merges.get((row[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], row[h], made))
        return [x for x in row if x >= 0]

    def merge_short(self, row: list[int]) -> list[int]:
        """The same for few letters, where going over all pairs again is faster than a heap."""
        step_of = self.step_of
        steps = [step_of.get(p, NEVER) for p in zip(row, row[1:])]
        while steps:
            least = min(steps)
            if least == NEVER:
                break
            i = steps.index(least)
            row[i:i + 2] = [self.made_by[least]]
            del steps[i]
            if i < len(steps):
                steps[i] = step_of.get((row[i], row[i + 1]), NEVER)
            if i:
                steps[i - 1] = step_of.get((row[i - 1], row[i]), NEVER)
        return row

    def propose(self, letters: str) -> list[int]:
        """The longest token that fits, again and again; only the word's end takes tokens with the suffix."""
        out, i, n = [], 0, len(letters)
        while True:
            if n - i <= self.longest_last and (t := self.last.get(letters[i:])) is not None:
                out.append(t)
                return out
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (t := self.inside.get(letters[i:j])) is not None:
                    out.append(t)
                    i = j
                    break

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their letters gives that pair.

        The later-born of the two is taken apart at the seam, step by step; if what meets at the seam merges
        before the part that was taken apart was made, the pair never comes to be.
        """
        ok, todo = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        # A join at the seam counts if its step is below `limit`; the same step counts where it lies further left.
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(todo):
            x, y = a[todo], b[todo]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joins = (self.keys[at] == key) & (self.steps[at] < limit[todo])
            ok[todo[joins]] = False
            first = (self.born[x] > self.born[y]) | (self.born[y] < 0)
            done = joins | ((self.born[x] < 0) & (self.born[y] < 0))
            limit[todo] = np.where(first, self.born[x], self.born[y] + 1)
            a[todo] = np.where(first, self.right[x], x)
            b[todo] = np.where(first, y, self.left[y])
            todo = todo[~done]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words and keeps them."""
        if not words:
            return
        spelled = [w if w.isascii() and w.isprintable() else "".join([self.letters[x] for x in w.encode()]) for w in words]
        rows = [self.propose(s) for s in spelled]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((t for r in rows for t in r), np.int64, int(lengths.sum()))
        word = np.repeat(np.arange(len(rows)), lengths)
        bad = np.zeros(len(rows), bool)
        bad[word[~self.own[flat]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, place = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        bad[word[inner[~good[place]]]] = True
        for i in np.flatnonzero(bad):
            rows[i] = self.merge(spelled[i])
        self.kept.update(zip(words, rows))

    def split(self, text: str) -> list[str | int]:
        """Words in order; special tokens as their ids."""
        out: list[str | int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # Letters are put in lower case one by one: a final sigma is a sigma like any other.
                out += self.words.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        listed = [self.split(t) for t in texts]
        fresh = {w for ws in listed for w in ws if w.__class__ is str and w not in self.kept}
        if len(self.kept) + len(fresh) > WORDS_KEPT:
            self.kept.clear()
            fresh = {w for ws in listed for w in ws if w.__class__ is str}
        self.learn(list(fresh))
        out = []
        for ws in listed:
            ids: list[int] = []
            for w in ws:
                if w.__class__ is str:
                    ids += self.kept[w]
                else:
                    ids.append(w)
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=1)
def vocabulary(path: str | None) -> WordBpe:
    return WordBpe(path or default_path())


def in_pieces(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in order, NULL as empty, about CHARS_AT_ONCE characters a time."""
    piece, n = [], 0
    for t in texts:
        piece.append(t or "")
        n += len(piece[-1])
        if n >= CHARS_AT_ONCE:
            yield piece
            piece, n = [], 0
    if piece:
        yield piece


def encode_decode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """`docs` with `ids` array<int> and `decoded` string (under longer names where it has such columns).

    NULL text is empty: no ids and an empty decoded text. Repeated rows are encoded each. `path` names the
    vocabulary file and must exist on every executor; NULL stands for the installed public one.
    """
    ids_name, decoded_name = free_name(docs, "ids"), free_name(docs, "decoded")
    kinds = [f"`{c}` {k}" for c, k in docs.dtypes]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for x in batches:
            done = 0
            for piece in in_pieces(x.column(text).to_pylist()):
                rows = bpe.encode_all(piece)
                ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
                part = x.slice(done, len(piece))
                done += len(piece)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(map(bpe.decode, rows), pa.string())],
                    [*part.schema.names, ids_name, decoded_name],
                )

    return docs.mapInArrow(work, ", ".join([*kinds, f"`{ids_name}` array<int>", f"`{decoded_name}` string"]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs`."""
    coded = encode_decode(docs.select("doc_id", "text"), path=path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
