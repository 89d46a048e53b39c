"""Quality scores, words taken by the mix, and the recall of the n-gram join, worked out again in plain Python."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from hexheat.llm import mixing, ngram_join, quality


def plain_features(text: str) -> list[float]:
    text = text or ""
    n = len(text) + 1
    words, lines = regex.split("[ \t\n\x0b\f\r]+", text), text.split("\n")
    count = lambda pattern: len(regex.findall(pattern, text))
    space, no_space = "[ \t\n\x0b\f\r]", "[^ \t\n\x0b\f\r]"
    doubled = regex.compile(f"(?<!{no_space})({no_space}+){space}+(?=\\1(?!{no_space}))")
    return [
        math.log1p(len(text)), n / len(words), n / len(lines), count(r"\p{Lu}") / n, count(r"\p{Nd}") / n,
        count(r"[^\p{L}\p{Nd} \t\n\x0b\f\r.,]") / n, count("[.,]") / n, len(set(words)) / len(words), len(set(lines)) / len(lines),
        len(doubled.findall(text)) / len(words),
    ]


def plain_score(model: quality.Additive, x: list[float]) -> float:
    """A walk through the tables: the bin of a value is the number of cuts that are not above it."""
    at = lambda cuts, v: sum(c <= v for c in cuts)
    total = model.intercept + sum(t[at(e, v)] for t, e, v in zip(model.tables, model.edges, x))
    total += sum(t[at(model.coarse[j], x[j])][at(model.coarse[k], x[k])] for (j, k), t in model.pairs.items())
    return 1 / (1 + math.exp(-total))


def test_quality_scores(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "ǅ ١٢ x x x\ty y"), (-5, "Word " * 300_000)], "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(odd)
    model = quality.fit_quality(docs, labels)
    known = [r for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    texts = {r.doc_id: r.text for r in some.collect()}
    # Rows stand in the order of their hashes, as sums depend on it in the last bits.
    place = {r.doc_id: r.draw for r in docs.select("doc_id", F.xxhash64("doc_id").alias("draw")).collect()}
    known.sort(key=lambda r: place[r.doc_id])
    again = quality.fit(np.array([plain_features(texts[r.doc_id]) for r in known]), np.array([r.quality for r in known], float))
    assert len(model.tables) == len(quality.NAMES)
    for a, b in zip([*model.tables, *model.pairs.values()], [*again.tables, *again.pairs.values()]):
        assert a == pytest.approx(b, abs=1e-6)
    described = {r.doc_id: list(r)[1:] for r in quality.described(some).collect()}
    for i, x in described.items():
        assert x == pytest.approx(plain_features(texts[i]), rel=1e-12)
    scored = some.select("doc_id", quality.scorer(model)(*[c.cast("double") for c in quality.features(F.coalesce("text", F.lit(""))).values()]).alias("s"))
    for r in scored.collect():
        assert r.s == pytest.approx(plain_score(model, described[r.doc_id]), abs=1e-12)


def test_scores_with_pairs():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (2000, 3))
    model = quality.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float))
    assert model.pairs and model.score(x[:200]) == pytest.approx([plain_score(model, list(v)) for v in x[:200]])


def test_words_taken_by_the_mix(spark, make_docs, rows):
    """Blocks of each source's row of words, gone through by the permutation of each round until the target is reached."""
    r = random.Random(4)
    rows = [*rows, *((5000 + i, "w " * r.randint(0, 400), f"s{i % 4}") for i in range(80)), *((None, f"n{i} " * 30, "s1") for i in range(40))]
    docs = make_docs(rows).coalesce(1)
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(mixing.WORD), F.lit(0))).alias("size"),
                        F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(7)), F.lit(256)).alias("bucket")).collect()
    by_source = defaultdict(list)
    for x in sizes:
        by_source[x.source].append((x.bucket, (x.doc_id is not None, x.doc_id or 0), x.size, x.hash))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    totals = [sum(x[2] for x in by_source[s]) for s in order]
    targets = mixing.shared_out(totals, [(5, 2, 1)[k % 3] for k in range(len(order))])
    expected = Counter()
    for k, (source, words, target) in enumerate(zip(order, totals, targets)):
        wanted, n_blocks, key = min(round(target), 3 * words), -(-words // mixing.BLOCK), mixing.SEED + 1000 * k
        times = np.zeros(words, np.int64)
        turn = 0
        while wanted > 0:
            for block in mixing.permuted(np.arange(n_blocks), n_blocks, key + turn).tolist():
                first, last = block * mixing.BLOCK, min((block + 1) * mixing.BLOCK, words)
                take = min(wanted, last - first)
                times[first:first + take] += 1
                wanted -= take
            turn += 1
        at = 0
        for _, doc, size, _ in sorted(x for x in by_source[source] if x[2]):
            expected[source, doc, size, int(times[at:at + size].sum())] += 1
            at += size
    got = Counter()
    source_of = {(round(t, 6), n): s for s, t, n in zip(order, targets, totals)}
    for x in mixing.mix_words(docs).collect():
        if x.size:
            got[source_of[round(x.target, 6), x.source_size], (x.doc_id is not None, x.doc_id or 0), x.size, x.taken] += 1
    assert got == expected


def test_recall_of_the_ngram_join_at_the_threshold(make_docs):
    """Pairs with a similarity of 0.80 to 0.82, each pair of words of its own."""
    rows = []
    for k in range(400):
        a = [f"{k}w{i}" for i in range(204)]
        b = a[:183] + [f"{k}v{i}" for i in range(21)]
        x, y = ({tuple(t[i:i + 5]) for i in range(200)} for t in (a, b))
        assert 0.8 <= len(x & y) / len(x | y) <= 0.82
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = ngram_join.near_copies(make_docs(rows, clashing=False)).collect()
    assert sum(r.n_links for r in got) == 2 * 400 and all(r.class_id == r.doc_id // 2 * 2 for r in got)
