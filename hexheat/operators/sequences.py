"""Running sums and as-of lookups that hold up when one group has most of the rows.

A plain window over a group orders the whole group in one task. Here a group is cut into
stretches of the ordering key, each stretch is summarised where it lies, the summaries (one
row per stretch) are carried forward, and only then is each stretch ordered by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STRETCH = 1 << 16
OPEN = (1 << 63) - 1


def _stretches(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("stretch", F.floor(F.col(order) / width))


def running_sum(df: DataFrame, part: list[str], order: str, sums: dict[str, str], width: int = STRETCH) -> DataFrame:
    """Add inclusive running sums. `sums` maps new column to summed column.

    `order` is a non-negative integer, unique in its group, so a stretch holds at most `width`
    rows whatever the size of the group.
    """
    cut = _stretches(df, order, width)
    before = Window.partitionBy(*part).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(*part, "stretch").agg(*[F.sum(col).alias(new) for new, col in sums.items()]).select(
        *part, "stretch", *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"{new}_in") for new in sums]
    )
    within = Window.partitionBy(*part, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.join(carried, [*part, "stretch"])
    return out.select(
        *df.columns, *[(F.col(f"{new}_in") + F.sum(col).over(within)).alias(new) for new, col in sums.items()]
    )


def running_last(df: DataFrame, part: list[str], order: str, value: Column, name: str, width: int = STRETCH) -> DataFrame:
    """Add the last non-NULL `value` up to and including each row."""
    cut = _stretches(df.withColumn("_v", value), order, width)
    before = Window.partitionBy(*part).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*part, "stretch").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_end")
    )
    carried = ends.select(*part, "stretch", F.last("_end", ignorenulls=True).over(before).alias("_in"))
    within = Window.partitionBy(*part, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.last("_v", ignorenulls=True).over(within)
    return cut.join(carried, [*part, "stretch"]).select(*df.columns, F.coalesce(here, "_in").alias(name))


def delta_decode(entries: DataFrame, part: list[str], order: str, width: int = STRETCH) -> DataFrame:
    """Absolute ids and offsets of delta-coded entries.

    Ids are the running sum of deltas. An offset code of 0 means "right after the previous
    entry"; any other code is the offset plus one. The first entry has no previous one, so its
    code is always read as written.
    """
    counted = entries.withColumn("one", F.lit(1))
    marked = running_sum(counted, part, order, {"id": "delta", "length_upto": "length", "nth": "one"}, width)
    start = F.col("length_upto") - F.col("length")
    first = F.col("nth") == 1
    anchor = F.when(first | (F.col("offset_code") != 0), F.col("offset_code") - 1 - start)
    anchored = running_last(marked, part, order, anchor, "anchor", width)
    return anchored.select(*part, order, "id", "run", "length", (F.col("anchor") + start).alias("offset"))


def covering_run(entries: DataFrame, keys: DataFrame, part: list[str], width: int = STRETCH) -> DataFrame:
    """The entry that covers each key: greatest id not above it, if the key is within its run.

    A run of 0 is open. Equal ids keep the longest run. Keys without cover get NULLs. Wanted
    keys are made distinct first, so a key asked for a million times is searched once; the
    answer then goes back by an equi join.
    """
    def cut(df: DataFrame, col: str) -> DataFrame:
        return df.withColumn("stretch", F.floor(F.col(col) / width))

    # an open run is the longest of all
    length = F.when(F.col("run") == 0, OPEN).otherwise(F.col("run"))
    longest = entries.groupBy(*part, "id").agg(F.max(length).alias("run"))
    held = longest.withColumn("run", F.when(F.col("run") == OPEN, 0).otherwise(F.col("run")).cast(entries.schema["run"].dataType))
    ends = cut(held, "id").groupBy(*part, "stretch").agg(F.max(F.struct("id", "run")).alias("entry"))
    asked = cut(keys.select(*part, "key").distinct(), "key")
    # last entry of any earlier stretch, for the stretches that are asked about
    before = Window.partitionBy(*part).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    both = ends.unionByName(
        asked.select(*part, "stretch").distinct(), allowMissingColumns=True
    ).groupBy(*part, "stretch").agg(F.max("entry").alias("entry"))
    carried = both.select(*part, "stretch", F.last("entry", ignorenulls=True).over(before).alias("entry_in"))

    entry_rows = cut(held, "id").select(
        *part, "stretch", F.col("id").alias("at"), F.struct("id", "run").alias("entry"),
        F.lit(None).cast("bigint").alias("key"),
    )
    key_rows = asked.select(
        *part, "stretch", F.col("key").alias("at"),
        F.lit(None).cast(entry_rows.schema["entry"].dataType).alias("entry"), "key",
    )
    upto = Window.partitionBy(*part, "stretch").orderBy("at", F.col("key").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    found = (
        entry_rows.unionByName(key_rows)
        .withColumn("near", F.last("entry", ignorenulls=True).over(upto))
        .where(F.col("key").isNotNull())
        .join(carried, [*part, "stretch"])
        .withColumn("near", F.coalesce("near", "entry_in"))
    )
    covers = (F.col("near.run") == 0) | (F.col("key") - F.col("near.id") < F.col("near.run"))
    answers = found.select(
        *part, "key",
        F.when(covers, F.col("near.id")).alias("id"), F.when(covers, F.col("near.run")).alias("run"),
    )
    return keys.join(answers, [*part, "key"], "left")
