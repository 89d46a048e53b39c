"""Licence scans by diagonal voting, from DataFrame functions only.

All rolling word grams of all documents are joined to the places they have in the templates. A hit says where
the template would begin (its diagonal); hits of one copy share a diagonal, and an inserted or missing word
moves it by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hexheat.llm.common import stored, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 2
# Phrases whose every place counts, and their labels: fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices in common use; a label is given where most of one is there.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl-2.0",
}
SHARE, DRIFT = 0.8, 2


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case.

    lower() also changes letters beyond ASCII, but maps none of them to an ASCII letter alone except the
    Kelvin sign, which is set aside first; so words compare with ASCII words as if only A-Z were changed.
    """
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str], gram: int) -> DataFrame:
    """hash, gram, template, tpos, n_grams, label, base: one row per gram of a template, a fixed few hundred."""
    rows = []
    for n, (text, label, base) in enumerate([(t, x, True) for t, x in phrases.items()] + [(t, x, False) for t, x in notices.items()]):
        parts = text.split(" ")
        rows += [(n, i, len(parts) - gram + 1, label, base, " ".join(parts[i:i + gram])) for i in range(len(parts) - gram + 1)]
    made = spark.createDataFrame(rows, "template int, tpos int, n_grams int, label string, base boolean, gram string")
    return made.withColumn("hash", F.xxhash64("gram"))


def scan_licences(
    docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
    gram: int = GRAM, share: float = SHARE, drift: int = DRIFT,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A phrase stands where all its grams vote for one diagonal; a notice where diagonals at most `drift` apart
    hold `share` of its grams. score is the largest share of a template found, 0 if none was. NULL text is
    empty text and has no words; repeated rows are reported each. Templates shorter than `gram` words are an error.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    if any(len(t.split(" ")) < gram for t in (*phrases, *notices)):
        raise ValueError("a template has fewer words than a gram")
    listed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(text_or_empty()).alias("words"))
    rolling = F.transform("words", lambda x, i: F.concat_ws(" ", x, *[F.get("words", i + j) for j in range(1, gram)]))
    # One more, NULL, at the end of each document: it stays in the join and carries the number of words.
    places = listed.select("row", "doc_id", F.posexplode(F.concat(rolling, F.array(F.lit(None).cast("string")))).alias("pos", "text"))
    marks = templates(docs.sparkSession, phrases, notices, gram)
    hits = places.withColumn("text_hash", F.xxhash64("text")).join(
        F.broadcast(marks), (F.col("text_hash") == F.col("hash")) & (F.col("text") == F.col("gram")), "left"
    )
    hits = stored(
        hits.where("text is null or template is not null").select("row", "doc_id", "pos", "template", "tpos", "n_grams", "label", "base"),
        "licence_hits",
    )
    voted = (
        hits.where("template is not null")
        .groupBy("row", "template", "n_grams", "label", "base", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("tpos"), F.min("pos").alias("least"), F.max("pos").alias("most"))
    )
    exact = voted.where("base and size(tpos) = n_grams").select(
        "row", "label", F.col("base").alias("is_base"), F.col("least"), F.lit(1.0).alias("score")
    )
    in_order = W.partitionBy("row", "template").orderBy("diagonal")
    near = voted.where("not base").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(in_order) > drift).cast("int"), F.lit(1)))
    near = (
        near.withColumn("run", F.sum("new").over(in_order))
        .groupBy("row", "template", "n_grams", "label", "run")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("n"), F.min("least").alias("least"))
        .where(F.col("n") >= share * F.col("n_grams"))
        .select("row", "label", F.lit(False).alias("is_base"), "least", (F.col("n") / F.col("n_grams")).alias("score"))
    )
    listing = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_row = exact.union(near).groupBy("row").agg(
        F.count_if("is_base").alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("least"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("least"))).cast("long").alias("last_word"),
        listing(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"),
        listing("label").alias("labels"),
        F.max("score").alias("score"),
    )
    ends = hits.where("template is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return ends.join(by_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
