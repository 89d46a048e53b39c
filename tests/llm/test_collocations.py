"""Collocations against plain Python that lists and counts every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from hexheat.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string"


def plain_pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def plain_counts(rows):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in plain_pieces(text):
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[" ".join(w[i:i + k])] += 1
    return counts, totals


def plain(rows, least=10, percent=50, top=2000):
    counts, totals = plain_counts(rows)
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if a >= least and " " in p}
        ranked = []
        for p, a in cands.items():
            w = p.split(" ")
            if any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= percent * a for q, b in cands.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[" ".join(w[:c])] * f[" ".join(w[c:])]), c, f[" ".join(w[:c])], f[" ".join(w[c:])]) for c in range(1, len(w)))
            ranked.append((-score, -a, p.encode(), p, a, left, right, score))
        for rank, (_, _, _, p, a, left, right, score) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p, a, left, right, totals[lang], score))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = ["The", "of", "new", "York", "city", "ß", "日本", "x\xa0y", "a-b", "\x1f", "HE", "É"]
    out = []
    for i in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in range(r.randint(0, 40)))
        if r.random() < 0.3:
            text += " new york city hall " * r.randint(1, 3)
        out.append((i, text, r.choice(["en", "en", "de", None, "und"])))
    out += [(1, "", "en"), (2, None, None), (3, " .,\n", "fr"), (4, "one two", "it"), out[5], out[5], (None, "new york " * 30, "en")]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(f"x{c}") for c in ["chunk", "packed", "size", "range", "hashes", "k", "phrase", "a", "l", "r", "n", "rank", "score"]})


def got(df):
    return sorted(tuple(x) for x in df.collect())


def test_collocations(docs, corpus):
    df = co.collocations(docs)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got(df) == plain(corpus) and len(plain(corpus)) > 40


def test_few_ranks_other_thresholds_and_small_chunks(docs, corpus):
    assert got(co.collocations(docs, least=4, percent=80, top=7, chunk_bytes=200)) == plain(corpus, 4, 80, 7)


def test_phrases_when_hashes_collide(docs, corpus):
    """With hashes of 10 bits nearly all phrases share one with others; the last counts are by the words themselves."""
    counts, _ = plain_counts(corpus)
    expected = sorted((lang, p.count(" ") + 1, p, a) for lang, f in counts.items() for p, a in f.items() if a >= 10)
    packed = co.chunks(docs, 300)
    for bits in (10, co.BITS):
        assert got(co.frequent_phrases(packed, 10, 50, bits)) == expected


@pytest.mark.parametrize("seed", range(5))
def test_no_frequent_hash_is_lost(seed):
    r = np.random.default_rng(seed)
    drawn = [np.unique(np.minimum(r.zipf(1.3, 400), 1 << 40).astype(np.uint64), return_counts=True) for _ in range(60)]
    total = Counter()
    for h, c in drawn:
        total.update(dict(zip(h.tolist(), c.tolist())))
    for least in (2, 5, 10, 100):
        for factor in (1, 2):
            assert co.frequent(drawn, least, factor).tolist() == sorted(h for h, c in total.items() if c >= least)


def test_merging_keeps_capacity_and_its_promise():
    r = np.random.default_rng(1)
    total, summary, capacity = Counter(), (np.zeros(0, np.uint64), np.zeros(0, np.int64), 0), 40
    for _ in range(50):
        h, c = np.unique(np.minimum(r.zipf(1.2, 300), 10_000).astype(np.uint64), return_counts=True)
        total.update(dict(zip(h.tolist(), c.tolist())))
        other = co.merged((np.zeros(0, np.uint64), np.zeros(0, np.int64), 0), (h, c, 0), capacity)
        summary = co.merged(summary, other, capacity)
    held = dict(zip(summary[0].tolist(), summary[1].tolist()))
    mass = sum(total.values())
    assert len(held) <= capacity and summary[2] <= mass / (capacity + 1)
    assert all(held.get(h, 0) <= n <= held.get(h, 0) + summary[2] for h, n in total.items())
    assert all(h in held for h, n in total.items() if n > mass / (capacity + 1))


def test_long_texts_are_cut_where_pieces_end():
    text = ("some words, and more. " * 50 + "x " * 500).encode()
    cut = list(co.parts(text, 64))
    assert max(map(len, cut[:-1])) < 64 + 25 and [w for p in cut for w in plain_pieces(p.decode()) if w] == [w for w in plain_pieces(text.decode()) if w]
    assert list(co.parts(b"x " * 100, 10)) == [b"x " * 100] and list(co.parts(b"", 10)) == [b""]


def test_a_long_text(spark):
    rows = [(1, "w " * 200_000 + ". " + "u v " * 100_000, "en")]
    assert got(co.collocations(spark.createDataFrame(rows, SCHEMA), chunk_bytes=1 << 14)) == plain(rows)


def test_scores_beyond_64_bits(spark):
    r = random.Random(6)
    rows = [(a := r.randrange(10**12, 10**13), a + r.randrange(10**6), a * 3 + r.randrange(10**9)) for _ in range(50)] + [(10**13, 10**13, 10**13), (10, 7_000_000, 11_000_000)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    assert [x.s for x in df.select(co.exact_score("a", "l", "r").alias("s")).collect()] == [10**6 * a * a // (left * right) for a, left, right in rows]


def test_thinning_in_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"), F.col("id").cast("string").alias("phrase"), (F.col("id") * 7919 % 1000).alias("score"))
    order = [F.desc("score"), F.asc("phrase")]
    one = got(co.first_of_each(df, 20, order).select("lang", "rank", "phrase", "score"))
    assert one == got(co.first_of_each(df, 20, order, bucket=10, narrow=4).select("lang", "rank", "phrase", "score")) and len(one) == 40


def test_an_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
