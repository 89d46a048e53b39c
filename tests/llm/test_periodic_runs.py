"""Runs of repeated words against plain Python that tries every period at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from hexheat.llm import periodic_runs as pr


def plain_runs(words, least=6, exponent=4):
    found = {}
    n = len(words)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i + p - start
            if length >= max(least, exponent * p):
                found.setdefault((start, length), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def plain_left(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def plain_planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def found(listed, least=6, exponent=4):
    out = [[] for _ in listed]
    for of, s, n, p in zip(*(x.tolist() for x in pr.runs_of([[w.encode() for w in x] for x in listed], least, exponent))):
        out[of].append((s, n, p))
    return out


def invented(r):
    """Words of a small alphabet with repeated stretches, some inside others, some cut short."""
    out = []
    for _ in range(r.randint(0, 6)):
        stretch = [r.choice("abc") for _ in range(r.randint(1, 9))]
        if r.random() < 0.4:
            stretch = stretch * r.randint(1, 6)
        out += (stretch * r.randint(1, 7))[: r.randint(1, 90)] + [r.choice("abcd") for _ in range(r.randint(0, 5))]
    return out


def test_the_cover_reaches_every_difference():
    assert {(a - b) % pr.MODULUS for a in pr.COVER for b in pr.COVER} == set(range(pr.MODULUS))
    assert pr.STEPS.min() == 0 and all((a + pr.STEPS[a, b]) % pr.MODULUS in pr.COVER and (b + pr.STEPS[a, b]) % pr.MODULUS in pr.COVER
                                       for a in range(pr.MODULUS) for b in range(pr.MODULUS))


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_plain_search(seed):
    r = random.Random(seed)
    listed = [invented(r) for _ in range(r.randint(1, 60))]
    assert found(listed) == [plain_runs(x) for x in listed]
    assert found(listed, 3, 3) == [plain_runs(x, 3, 3) for x in listed]
    assert found(listed, 10, 5) == [plain_runs(x, 10, 5) for x in listed]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), max_size=5))
def test_runs_equal_plain_search_on_two_letters(listed):
    assert found(listed) == [plain_runs(x) for x in listed]


def test_extensions_equal_plain_comparison():
    r = random.Random(2)
    words = [r.choice("ab") for _ in range(150)] * 5 + ["a"] * 300
    symbols = np.array([ord(w) for w in words] + [1])
    ext = pr.Extensions(symbols, np.zeros(len(symbols), np.int64))
    i, j = np.array([r.randrange(len(words)) for _ in range(2000)]), np.array([r.randrange(len(words)) for _ in range(2000)])
    i, j = i[i != j], j[i != j]

    def plain(a, b):
        n = 0
        while symbols[a + n] == symbols[b + n]:
            n += 1
        return n

    assert ext.common(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_very_long_texts():
    same, period = ["w"] * 300_000, [f"w{i}" for i in range(1000)] * 100
    assert found([same, period, ["x", *period, *same]]) == [[(0, 300_000, 1)], [(0, 100_000, 1000)], [(1, 100_000, 1000), (100_001, 300_000, 1)]]


def test_pairs_in_small_portions(monkeypatch):
    r = random.Random(77)
    listed = [invented(r) for _ in range(60)]
    monkeypatch.setattr(pr, "PAIRS_AT_ONCE", 5)
    assert found(listed) == [plain_runs(x) for x in listed]


def test_collapsed_of_runs_inside_runs():
    words = (["a"] * 8 + ["b"]) * 5
    runs = plain_runs(words)
    assert (0, 45, 9) in runs and (0, 8, 1) in runs
    got = pr.runs_of([[w.encode() for w in words]])
    assert [w.decode() for w in pr.collapsed([w.encode() for w in words], *got[1:])] == plain_left(words, runs)


def test_digests(make_docs, rows):
    r = random.Random(9)
    rows = [*rows, *((1000 + i, " \n".join(invented(r))) for i in range(60)), (2000, "x " * 20), (2000, "x " * 20), (None, "y y y y y y y z")]
    rows += [(3001, "a b a b a b a b\x0bc"), (3002, "é é " * 9), (3003, "\x1f \x85 " * 7)]
    expected = []
    for i, text, *_ in rows:
        words = plain_planted(i, [w for w in re.split("[ \x09-\x0d]+", text or "") if w])
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        expected.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(plain_left(words, runs)))))
    got = pr.run_digests(make_docs(rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=repr) == sorted(expected, key=repr)
    assert any(e[1] > 1 for e in expected) and any(e[0] is not None and e[0] < 1000 and e[1] for e in expected)


def test_columns_stay_and_an_empty_table(make_docs):
    docs = make_docs([(1, "x x x x x x x"), (2, None)])
    got = pr.periodic_runs(docs)
    assert got.columns == [*docs.columns, "runs_", "collapsed_"]
    assert sorted((r.collapsed_, [tuple(x) for x in r.runs_]) for r in got.collect()) == [("", []), ("x", [(0, 7, 1)])]
    assert pr.run_digests(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        pr.periodic_runs(docs, exponent=2)
