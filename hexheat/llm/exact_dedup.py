"""Exact deduplication by content-defined chunk recipes, from DataFrame functions only.

A text is cut where its content says so, so a text is an ordered list of chunks. Chunks move once, to have
their identifiers verified; documents are then compared by their lists of identifiers alone, and the long
texts themselves never move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import SPACE, numbered, stored, text_or_empty

LEAST, MOST = 512, 4096
# A cut is allowed after three characters of these kinds; that is about one place in a few hundred of plain text.
CUT = r"[aeiouyäöüéèíóñ][nrstlm][ ,.;\n]"


def normal(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def chunks(text: Column) -> Column:
    """The text in pieces, cut by content; each is LEAST to MOST characters long but for the last."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{LEAST},{MOST}}}?(?<={CUT})|.{{1,{MOST}}}"), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def colliding(pieces: DataFrame) -> DataFrame:
    """Of (hash, chunk) rows, the hashes that stand for different chunks, with each chunk's ordinal: (hash, chunk, ordinal).

    The bytes themselves are compared: a hash is an identifier when its least and greatest chunk are the same.
    """
    return (
        pieces.groupBy("hash")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .where("least <> most")
        .select("hash")
    )


def exact_groups(docs: DataFrame, hash_of: Callable[[Column], Column] = chunk_hash) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; NULL counts as empty, and
    all empty texts are one group. keep_id is the least doc_id of the group (NULL ids are never chosen; a
    group of NULL ids alone has keep_id NULL and keeps nothing). Repeated rows are rows of the group like any
    other: each counts in group_size and is marked like its twin. Further columns of `docs` are not read.
    """
    return marked_rows(docs, F.monotonically_increasing_id(), hash_of).drop("row")


def marked_rows(docs: DataFrame, row: Column, hash_of: Callable[[Column], Column] = chunk_hash) -> DataFrame:
    """`exact_groups` with the number of each row."""
    texts = docs.select(row.alias("row"), "doc_id", normal(text_or_empty()).alias("norm"))
    cut = texts.select("row", "doc_id", "norm", chunks(F.col("norm")).alias("chunks"))
    recipes = stored(
        cut.select(
            "row", "doc_id",
            F.transform("chunks", hash_of).alias("recipe"),
            F.sha2("norm", 256).alias("text_sha256"),
        ),
        "recipes",
    )
    pieces = cut.select(F.explode("chunks").alias("chunk")).select(hash_of(F.col("chunk")).alias("hash"), "chunk")
    bad = stored(colliding(pieces), "colliding")
    if bad.isEmpty():
        recipes = recipes.withColumn("told_apart", F.lit(None).cast("string"))
    else:
        places = cut.select("row", F.posexplode("chunks").alias("place", "chunk")).withColumn("hash", hash_of(F.col("chunk")))
        places = places.join(bad, "hash", "left_semi")
        told = places.groupBy("row").agg(
            F.to_json(F.array_sort(F.collect_set(F.struct("place", F.sha2("chunk", 512).alias("name"))))).alias("told_apart")
        )
        recipes = recipes.join(told, "row", "left")
    groups = recipes.groupBy("recipe", "told_apart").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    r, g = recipes.alias("r"), groups.alias("g")
    same = (F.col("r.recipe") == F.col("g.recipe")) & F.col("r.told_apart").eqNullSafe(F.col("g.told_apart"))
    return r.join(g, same).select(
        "r.row", "r.doc_id", "g.keep_id", "g.group_size",
        F.coalesce(F.col("r.doc_id") == F.col("g.keep_id"), F.lit(False)).alias("kept"),
        "r.text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that `exact_groups` drops; rows without an id stay, as nothing tells them apart."""
    rows, row = numbered(docs)
    gone = marked_rows(rows, F.col(row)).where("not kept and doc_id is not null").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)
