"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting gives every feature, and then the pairs that promise most, a lookup table over bins; each
round adds one shallow tree of a single feature or pair. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import text_or_empty

# Labelled rows that the model may be fitted on; of more, those with the least hash of their id.
FIT_ROWS = 20_000
ACCEPT = 0.3
LABEL_FOLDS, HELD_OUT = 5, 0


def features(text: Column) -> dict[str, Column]:
    """Numbers that describe a whole text; all are finite, an empty text's too."""
    n = F.length(text) + 1
    words = F.split(text, r"\s+")
    n_words = F.size(words)
    lines = F.split(text, "\n")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return {
        "chars": F.log1p(F.length(text).cast("double")),
        "word_length": n / n_words,
        "line_length": n / F.size(lines),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{Nd}"),
        "symbols": share(r"[^\p{L}\p{Nd}\s.,]"),
        "stops": share(r"[.,]"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "doubled": F.regexp_count(text, F.lit(r"(?<!\S)(\S+)\s+(?=\1(?!\S))")) / n_words,
    }


NAMES = [
    "chars", "word_length", "line_length", "upper", "digits", "symbols", "stops", "distinct_words", "distinct_lines", "doubled",
]


@dataclass
class Additive:
    """intercept + sum of tables[j][bin of feature j] + sum of pairs[j, k][coarse bins of j and k]."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (j, k), table in self.pairs.items():
            total += table[
                np.searchsorted(self.coarse[j], x[:, j], side="right"), np.searchsorted(self.coarse[k], x[:, k], side="right")
            ]
        return 1 / (1 + np.exp(-total))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.array([])


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, least: float, ridge: float) -> np.ndarray:
    """Step per bin of a tree over ordered bins with a few leaves, each cut where the gain is largest."""
    g, h = np.concatenate([[0.0], np.cumsum(grad)]), np.concatenate([[0.0], np.cumsum(hess)])
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            at = at[(h[at] - h[a] >= least) & (h[b] - h[at] >= least)]
            if len(at):
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), i, int(at[gain.argmax()]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    step = np.zeros(len(grad))
    for a, b in parts:
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def pair_tree(grad: np.ndarray, hess: np.ndarray, least: float, ridge: float) -> tuple[np.ndarray, float]:
    """Step per cell of the best tree with one cut by each feature (four leaves), and its gain."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    corners = lambda m: (m[:-1, :-1], m[:-1, -1:] - m[:-1, :-1], m[-1:, :-1] - m[:-1, :-1], m[-1, -1] - m[:-1, -1:] - m[-1:, :-1] + m[:-1, :-1])
    gs, hs = corners(g), corners(h)
    worth = sum(a**2 / (b + ridge) for a, b in zip(gs, hs))
    worth = np.where(np.minimum.reduce(hs) >= least, worth, 0)
    if not worth.size or worth.max() <= 0:
        return np.zeros_like(grad), 0.0
    i, j = np.unravel_index(worth.argmax(), worth.shape)
    v = [a[i, j] / (b[i, j] + ridge) for a, b in zip(gs, hs)]
    step = np.empty_like(grad)
    step[:i + 1, :j + 1], step[:i + 1, j + 1:], step[i + 1:, :j + 1], step[i + 1:, j + 1:] = v
    return step, float(worth.max() - g[-1, -1] ** 2 / (h[-1, -1] + ridge))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, bins: int = 64, leaves: int = 3,
    n_pairs: int = 6, pair_bins: int = 12, pair_rounds: int = 60, least: float = 1.0, ridge: float = 1.0,
) -> Additive:
    """Fits 0/1 labels. Without rows the score is 1/2 everywhere; with one class alone, near that class."""
    n, p = x.shape
    model = Additive(float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))))
    model.edges = [cuts(x[:, j], bins) for j in range(p)]
    model.coarse = [cuts(x[:, j], pair_bins) for j in range(p)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not n:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        prob = 1 / (1 + np.exp(-total))
        return y - prob, prob * (1 - prob)

    for _ in range(rounds):
        for j, b in enumerate(at):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(b, g, size), np.bincount(b, h, size), leaves, least, ridge)
            model.tables[j] += step
            total += step[b]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def pair_step(j: int, k: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        cell, shape = rough[j] * sizes[k] + rough[k], (sizes[j], sizes[k])
        sums = [np.bincount(cell, v, sizes[j] * sizes[k]).reshape(shape) for v in (g, h)]
        return pair_tree(*sums, least, ridge)

    g, h = slopes()
    gains = sorted(((pair_step(j, k, g, h)[1], j, k) for j in range(p) for k in range(j)), reverse=True)
    model.pairs = {(j, k): np.zeros((sizes[j], sizes[k])) for gain, j, k in gains[:n_pairs] if gain > 0}
    for _ in range(pair_rounds):
        for j, k in model.pairs:
            step = rate * pair_step(j, k, *slopes())[0]
            model.pairs[j, k] += step
            total += step[rough[j], rough[k]]
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % LABEL_FOLDS


def described(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in `keep`, and the features of every row."""
    return docs.select("doc_id", *keep, *[c.cast("double").alias(k) for k, c in features(text_or_empty()).items()])


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Additive:
    """The model, from rows whose fold is not the held-out one and whose label is not NULL.

    At most `fit_rows` rows reach the driver, those with the least hashes of their ids, and only rows that may be among
    them are described. Repeated labels of a document count each.
    """
    known = labels.where((fold(F.col("doc_id")) != HELD_OUT) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("n_labels")).withColumn("draw", F.xxhash64("doc_id"))
    share = 1.2 * fit_rows / max(1, known.count())
    if share < 1:
        known = known.where(F.col("draw") < int(-(2**63) + share * 2**64))
    # Some 1.2 * fit_rows rows of two numbers at most, whatever the size of the tables.
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    each = F.explode(F.sequence(F.lit(1), F.least("n_labels", F.lit(fit_rows).cast("long"))))
    rows = described(labelled, "quality", "draw", "n_labels").withColumn("nth", each)
    chosen = rows.orderBy("draw", "doc_id", "quality", *NAMES).limit(fit_rows).toPandas()
    return fit(chosen[NAMES].to_numpy(float), chosen["quality"].to_numpy(float))


def scorer(model: Additive):
    """A column function of the features in their order."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in x])))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Scores come from the text alone; NULL counts as empty. A document with a NULL id is not held out.
    Repeated rows score alike. Without usable labels every score is 1/2.
    """
    score = scorer(fit_quality(docs, labels))
    return described(docs).select("doc_id", score(*NAMES).alias("score")).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= accept).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with all their columns."""
    score = scorer(fit_quality(docs, labels))
    parts = [c.cast("double") for c in features(text_or_empty()).values()]
    return docs.where(score(*parts) >= accept)
