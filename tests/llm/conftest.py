from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHING = ["row", "node", "key", "chunk", "bucket", "hash", "ids", "decoded", "size", "start", "weight", "part", "side", "path", "sig", "label", "score", "recipe", "norm", "words", "found", "n", "of", "ranges", "cuts", "runs", "collapsed", "best", "bad"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def make(rows, clashing=True):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.withColumns({c: F.lit(f"x{c}") for c in CLASHING}) if clashing else df

    return make


@pytest.fixture(scope="session")
def texts():
    """Invented texts with exact and near copies, shared passages, blanks and a long one."""
    r = random.Random(3)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ß", "é", "st", "日"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(r.randint(5, 160)) for _ in range(40)]
    passage = text(60)
    out = list(base)
    for i in range(12):
        words = base[i].split(" ")
        words[len(words) // 2] = "changed"
        out.append(" ".join(words))
    out += [base[3], base[3] + "\n", base[3].replace(" ", "\t\n", 1), "", " \n", None, "a", "a b", "a b", text(4000)]
    out += [f"{text(20)} {passage} {text(20)}" for _ in range(6)]
    out += [base[5] + " " + base[6]]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    """(doc_id, text, source), with a repeated row and rows without an id or a source."""
    out = [(100 + 7 * i % 83 + 83 * (i // 83), t, None if i % 11 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return [*out, out[4], (None, texts[0], "s0"), (None, texts[7] + " tail", "s1")]
