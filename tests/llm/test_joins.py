"""Suffix dedup, the n-gram join, the lattice join, mixing, quality and the pipeline against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from hexheat.llm import groups, lattice_join, mixing, ngram_join, quality, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def roots_of(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


# ---- suffix dedup -------------------------------------------------------------------------

def removed(rows):
    owner = {}
    key = lambda i: float("inf") if i is None else i
    for i, text, *_ in rows:
        b = (text or "").encode()
        for k in range(len(b) - 49):
            w = b[k:k + 50]
            owner[w] = min(owner.get(w, float("inf")), key(i))
    out = []
    for i, text, *_ in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if owner[b[k:k + 50]] < key(i):
                gone[k:k + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(make_docs, rows):
    got = sorted((tuple(r) for r in suffix_dedup.removal_digests(make_docs(rows)).collect()), key=repr)
    assert got == removed(rows)


def test_suffix_dedup_of_monotone_and_interleaved_texts(make_docs):
    """Runs of one byte, texts that share many shifted windows, and copies over several chunks."""
    r = random.Random(9)
    blocks = ["".join(r.choice("ab") for _ in range(80)) for _ in range(5)]
    many = [(i, "a" * r.randint(0, 200)) for i in range(30)] + [(50 + i, "".join(r.sample(blocks, 3))) for i in range(40)]
    many += [(1000 - i, blocks[0] + "xyz" * r.randint(0, 30)) for i in range(600)]
    r.shuffle(many)
    got = sorted((tuple(x) for x in suffix_dedup.removal_digests(make_docs(many)).collect()), key=repr)
    assert got == removed(many)


def test_suffix_dedup_of_a_text_longer_than_a_piece(make_docs):
    r = random.Random(6)
    long = "".join(r.choice("abcdefgh ") for _ in range(suffix_dedup.PIECE + 90_000))
    at = suffix_dedup.PIECE - 30
    many = [(5, long), (3, long[at - 40:at + 70]), (9, long[:at] + "new" + long[at:]), (4, long[-60:])]
    got = sorted((tuple(x) for x in suffix_dedup.removal_digests(make_docs(many)).collect()), key=repr)
    assert got == removed(many)


@pytest.mark.parametrize("hot", [0, 3])
def test_suffix_dedup_by_window(make_docs, rows, hot):
    r = random.Random(9)
    blocks = ["".join(r.choice("ab") for _ in range(80)) for _ in range(5)]
    many = [*rows, *[(50 + i, "".join(r.sample(blocks, 3))) for i in range(40)], *[(None, blocks[1] + blocks[0])] * 2]
    many += [(1000 - i // 2, f"{r.random()}" + blocks[0] + f"{r.randint(0, 30)}" * 5) for i in range(600)]
    r.shuffle(many)
    frame = suffix_dedup.repeated_spans(make_docs(many), hot=hot)
    got = sorted(
        ((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in frame.collect()), key=repr
    )
    assert got == removed(many)


def test_suffix_dedup_deals_out_a_hot_anchor(make_docs):
    """A passage between texts of its documents' own: its edges make as many stretches of an anchor as documents."""
    r = random.Random(4)
    own = lambda: "".join(r.choice("abcdefghijklmnop ") for _ in range(60))
    passage = own() + own()
    rows = suffix_dedup.in_chunks(make_docs([(i, own() + passage + own()) for i in range(2000)]))
    n = defaultdict(int)
    for x in suffix_dedup.sent_pieces(rows, 64, 100).select("bucket", "n").collect():
        n[x.bucket] += x.n
    assert max([v for b, v in n.items() if b < 64], default=0) <= 2 * 100
    spread = [v for b, v in n.items() if b >= 64]
    assert len(spread) == 64 and max(spread) < 2 * sum(spread) / 64


def test_suffix_dedup_when_names_collide(make_docs, rows, monkeypatch):
    """With names of two bits nearly all stretches and windows share one with others; bytes tell them apart."""
    def weak(hashes, start, windows):
        return (hashes[start] ^ hashes[start + windows - 1]) & np.uint64(3)

    r = random.Random(12)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(60, 120))) for _ in range(6)]
    docs = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60))).join(r.sample(passages, 3)).encode()) for i in range(40)]
    expected = {x[0]: x[4] for x in removed([(i, t.decode()) for i, t in docs])}
    s = suffix_dedup.Stretches([t for _, t in docs], np.arange(40))
    monkeypatch.setattr(suffix_dedup, "names", weak)
    weak_name = s.name & np.uint64(3)
    for size in (s.windows + 49,):
        class_of, first = suffix_dedup.classes(s.text, s.start, size, weak_name)
        texts = [s.text[a:a + n].tobytes() for a, n in zip(s.start, size)]
        assert len(first) == len(set(texts)) and all(texts[first[c]] == t for c, t in zip(class_of, texts))
    at = np.arange(len(s.start))
    stretch, number, least, most, text, _ = suffix_dedup.different_windows(s, at)
    windows = {text[50 * k:50 * k + 50].tobytes() for k in range(len(stretch))}
    plain = {}
    for i, t in docs:
        for k in range(len(t) - 49):
            plain.setdefault(t[k:k + 50], []).append(i)
    assert windows == set(plain) and len(stretch) == len(plain)
    assert all((a, b) == (min(plain[w]), max(plain[w])) for a, b, w in zip(least, most, (text[50 * k:50 * k + 50].tobytes() for k in range(len(stretch)))))
    assert expected


def test_suffix_dedup_of_long_texts_apart(make_docs, monkeypatch):
    """Texts longer than LONG_TEXT are chunks of their own, among others that share passages with them."""
    monkeypatch.setattr(suffix_dedup, "LONG_TEXT", 200)
    r = random.Random(13)
    passage = "".join(r.choice("abcdefgh é") for _ in range(90))
    many = [(r.randrange(500), "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 300))) + passage * r.randint(0, 2)) for _ in range(120)]
    assert sorted((tuple(x) for x in suffix_dedup.removal_digests(make_docs(many)).collect()), key=repr) == removed(many)
    chunks = suffix_dedup.in_chunks(make_docs(many)).collect()
    assert all((c.chunk < 0) == (len(c.text.encode()) > 200) for c in chunks) and len({c.row for c in chunks}) == len(many)


def test_blind_trie_finds_equal_strings():
    r = random.Random(2)
    strings = ["".join(r.choice("ab") for _ in range(8)).encode() for _ in range(300)]
    trie, leaf = suffix_dedup.BlindTrie(), {}
    for i, s in enumerate(strings):
        assert trie.insert(s, i) == leaf.setdefault(s, i)


# ---- n-gram join --------------------------------------------------------------------------

def jaccard_join(rows, n=5, least=0.8):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    links = [(a, b) for b in range(len(rows)) for a in range(b) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    n_links = [sum(i in l for l in links) for i in range(len(rows))]
    root = roots_of(len(rows), links)
    out = []
    for i, (doc, *_rest) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((doc, least_id, n_links[i], doc is not None and doc == least_id))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bucket", "block"), [(256, 1024), (2, 2)])
def test_ngram_join(make_docs, rows, bucket, block):
    got = sorted((tuple(r) for r in ngram_join.near_copies(make_docs(rows), bucket=bucket, block=block).collect()), key=repr)
    assert got == jaccard_join(rows)


def test_drop_near_copies_keeps_the_other_text_of_an_id(make_docs):
    copied, own = (" ".join(f"{w}{i}" for i in range(60)) for w in "ab")
    docs = make_docs([(1, copied), (2, own), (2, copied + " more"), (3, "third")])
    left = ngram_join.drop_near_copies(docs)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, copied), (2, own), (3, "third")]


def test_ngram_join_of_a_hot_group(make_docs):
    """Hundreds of variants of one text, all alike, in buckets that never get small."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(words)
        w[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = sorted((tuple(x) for x in ngram_join.near_copies(make_docs(rows), bucket=16, block=32).collect()), key=repr)
    assert got == jaccard_join(rows)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 300), (500, 400)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in groups.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 400: 300, 500: 300}


# ---- lattice join -------------------------------------------------------------------------

def test_e8_points_are_nearest():
    x = np.random.default_rng(0).normal(size=(3000, 8)) * 2
    own = lattice_join.nearest_e8(x)
    d = ((x - own) ** 2).sum(1)
    assert len(lattice_join.STEPS) == 240 and (d <= 1 + 1e-9).all()
    assert all((((x - own - s) ** 2).sum(1) >= d - 1e-9).all() for s in lattice_join.STEPS)


def test_recall_at_the_threshold():
    """Pairs whose cosine is just the threshold, in 64 dimensions."""
    r = np.random.default_rng(1)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = 0.93 * a + np.sqrt(1 - 0.93**2) * b
    label = np.zeros(len(a))
    x, y = (lattice_join.cells(v, label, lattice_join.TABLES, lattice_join.PROBES, lattice_join.WIDTH, lattice_join.SEED) for v in (a, c))
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert met.mean() > 0.98


def test_lattice_join(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    rows = []
    for i in range(160):
        v = base[i % 30] + r.normal(size=16) * 0.12
        rows.append((1000 - i, [float(x) for x in v], i % 2))
    rows += [(2, rows[0][1], 0), (3, rows[0][1], 0), (4, rows[0][1], None), (5, None, 0), (6, [0.0] * 16, 0), (7, [float("nan")] * 16, 0)]
    rows += [(8, [], 0), (9, [1.0, None] * 8, 0), (None, rows[0][1], 0), (10, [float("inf")] + [1.0] * 15, 0), (11, [2.0, 1.0], 0), (12, [2.0, 1.0], 0), (3, rows[0][1], 0)]
    unit = []
    for _, v, label in rows:
        fine = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if fine else None)
    links = [
        (a, b) for b in range(len(rows)) for a in range(b)
        if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    ]
    assert len(links) > 100
    root = roots_of(len(rows), links)
    expected = []
    for i, (vec, *_rest) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None)
        expected.append((vec, sum(i in l for l in links), least, vec is not None and vec == least))
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "vec_id long, embedding array<double>, label int, node int, key string")
    for block in (1024, 8):
        got = [tuple(x) for x in lattice_join.near_vectors(df, block=block).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)


# ---- mixing -------------------------------------------------------------------------------

def test_targets():
    assert mixing.shared_out([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.shared_out([1, 100, 100], [5, 2, 1]) == pytest.approx([3, 132, 66])
    assert mixing.shared_out([0, 8], [5, 2]) == pytest.approx([0, 8])
    assert mixing.shared_out([0, 0], [5, 2]) == [0, 0] and mixing.shared_out([], []) == []


def test_permutations():
    for n in (1, 2, 3, 5, 64, 1000):
        p = mixing.permuted(np.arange(n), n, 5)
        assert sorted(p) == list(range(n)) and (mixing.permuted(p, n, 5, back=True) == np.arange(n)).all()


def test_mixing(make_docs, rows):
    got = mixing.mix_words(make_docs(rows)).collect()
    sizes = {}
    for i, text, source in rows:
        sizes.setdefault(source, []).append(len((text or "").split()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.shared_out([sum(sizes[s]) for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    assert len(got) == len(rows)
    source_of = defaultdict(set)
    for i, _, source in rows:
        source_of[i].add(source)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        source = next(s for s in source_of[r.doc_id] if sum(sizes[s]) == r.source_size and targets[s] == pytest.approx(r.target))
        taken[source] += r.taken
    assert {s: taken[s] for s in order} == {s: round(targets[s]) for s in order}
    again = mixing.mix_words(make_docs(rows).repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixed_rows_hold_the_words_taken(make_docs, rows):
    docs = make_docs([r for r in rows if r[0] is not None][:-1])
    taken = defaultdict(int)
    for r in mixing.mix_words(docs).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    held = defaultdict(int)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        held[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and set(r.text.split()) <= set(texts[r.doc_id].split())
    assert {k: v for k, v in taken.items() if v} == dict(held)


# ---- quality ------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(scored) > 50 and scored.score.between(0, 1).all()
    assert (scored.predicted == scored.quality).mean() > 0.95


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_quality_edge_cases(spark, make_docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(101, 1, 0), (101, 1, 0), (None, 1, 0), (108, None, None), (115, 0, 1), (9999, 0, 0)], none.schema)
    for labels in (none, odd):
        got = quality.score_quality(make_docs(rows), labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.score == 0.5 for r in quality.score_quality(make_docs(rows), none).collect())
    kept = quality.accepted(make_docs(rows), none)
    assert kept.columns == make_docs(rows).columns and kept.count() == len(rows)


# ---- empty tables and the pipeline --------------------------------------------------------

def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (
        suffix_dedup.removal_digests(docs), ngram_join.near_copies(docs), ngram_join.drop_near_copies(docs), lattice_join.near_vectors(vectors),
        mixing.mix_words(docs), mixing.mixed(docs), quality.score_quality(docs, labels), quality.accepted(docs, labels),
    ):
        assert df.columns and df.count() == 0


def test_pipeline_stages_against_plain_python(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    first = by_name["quality classifier"](spark, docs, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r for r in first.collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)
    second = {r.doc_id: r for r in by_name["exact dedup"](spark, first, sf).collect()}
    seen, expected = set(), []
    for i in sorted(kept):
        n = " ".join(__import__("re").split(r"[ \x09-\x0D]+", kept[i].text))
        expected += [] if n in seen else [i]
        seen.add(n)
    assert sorted(second) == expected
    frame = spark.createDataFrame(list(second.values()), docs.schema)
    third = {r.doc_id for r in by_name["n-gram Jaccard join"](spark, frame, sf).collect()}
    assert third == {r[0] for r in jaccard_join([(i, second[i].text) for i in second]) if r[3]}
    assert first.columns == docs.columns


def test_pipeline_runs_on_an_empty_table(spark, tmp_path, sf):
    import corpus_pipeline

    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
