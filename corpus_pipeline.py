"""The corpus pipeline: documents in, token digests of the mix out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Columns that `docs` has
besides those of documents pass through all stages but the last, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexheat.llm.bpe import digests
from hexheat.llm.common import stored, table
from hexheat.llm.exact_dedup import drop_copies
from hexheat.llm.mixing import mixed
from hexheat.llm.ngram_join import drop_near_copies
from hexheat.llm.quality import accepted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, doesn't reject.

    NULL text is scored as empty; repeated rows score alike and stay or go together; a text is scored whole, however
    long. Rows without an id are scored like others and never fitted. Without usable labels nothing is rejected.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the least doc_id.

    NULL and empty texts are one group. Rows that repeat the staying row stay with it, as nothing tells
    them apart; rows without an id stay too. Of several texts of one id each is decided by itself.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id.

    NULL, empty and blank texts are no copies of anything and stay. Rows that repeat a row
    that stays, and rows without an id, stay.
    """
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: a row per document and round of its source that takes words of it.

    NULL is a source of its own. NULL, empty and blank texts give no words and are left out. Repeated rows are rows of
    their own. A round that takes part of a text, however long, gives those words.
    """
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the decoded text of every row of the mix.

    NULL text is encoded as empty; repeated rows give a row each, and a NULL id stays NULL.
    """
    return digests(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources", mixing),
    ("BPE encoding and decoding", encoding),
]

# A classifier, a probabilistic join, drawn blocks and a tokenizer are not SQL; the tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
