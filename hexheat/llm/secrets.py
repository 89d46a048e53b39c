"""Secret scans with corpus-wide ownership, from DataFrame functions only.

Patterns find candidates inside each document; in how many repositories, and with how many owners, the same candidate
stands anywhere in the corpus then tells an example that is copied about from a credential that looks live. Only
hashes of candidates move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexheat.llm.common import stored, text_or_empty

# Kinds in their order: pattern, group that holds the value, least length of the value.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
# Added by the method where the value belongs to few owners: public forms of keys and tokens.
ADDED = {
    "issued": (
        r"gh[oprsu]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}"
        r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        0, 14,
    ),
}
KINDS = {**BASE, **ADDED}
# A candidate is live while it has at most so many owners and stands in at most so many repositories.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 10
# Matches are gathered in blocks of so many, so that a match doesn't copy all those before it.
BLOCK = 128


def spans(text: Column, kind: str) -> Column:
    """The kept matches of one kind: array of (start, rank, end, value), code points, end exclusive, in order.

    The text between the matches gives their places; a text without a match costs one pass. The pattern for
    hex runs is narrowed to runs that are long enough, which finds the same maximal runs.
    """
    pattern, group, least = KINDS[kind]
    if kind == "hex":
        pattern = rf"[0-9a-f]{{{least},}}"
    rank = list(KINDS).index(kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    kind_of = "array<struct<start:int,rank:int,end:int,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value"))
        full = F.size(acc["part"]) >= BLOCK
        part = F.when(full, F.array().cast(kind_of)).otherwise(acc["part"])
        return F.struct(
            end.alias("at"), F.when(full, F.concat(acc["full"], F.array(acc["part"]))).otherwise(acc["full"]).alias("full"),
            F.when(F.length(x["value"]) >= least, F.concat(part, F.array(found))).otherwise(part).alias("part"),
        )

    # split() gives one piece more than there are matches; the last is left out by the pairing with them.
    pairs = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_of}>").alias("full"), F.array().cast(kind_of).alias("part"))
    gathered = F.aggregate(pairs, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["part"]))))
    return F.when(text.rlike(pattern), gathered).otherwise(F.array().cast(kind_of))


def joined(found: Column) -> Column:
    """kind:start:end of each span, by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", names[x["rank"]], x["start"], x["end"])), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """Of (name, repository, owner) rows: name, n_repositories, n_owners. Each step sums before it shuffles."""
    return (
        candidates.select("name", "owner", "repository").distinct()
        .groupBy("name", "owner").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("name").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    )


def scan_secrets(
    docs: DataFrame, owner: str = "source", repository: str = "doc_id", live_owners: int = LIVE_OWNERS,
    live_repositories: int = LIVE_REPOSITORIES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    n_live counts base and added spans whose value at most `live_owners` owners hold in at most `live_repositories`
    repositories, n_copied the others; added spans are listed only where live. NULL text is empty text; a NULL owner or repository is one of its
    own; repeated rows are reported each, and are one repository.
    """
    text = F.col("text")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).alias("owner"),
        F.col(repository).alias("repository"), text_or_empty().alias("text"),
    )
    rows = stored(
        rows.select("row", "doc_id", "owner", "repository", *[spans(text, k).alias(k) for k in KINDS]), "secrets"
    )
    every = rows.select("row", "owner", "repository", F.explode(F.concat(*KINDS)).alias("span"))
    every = every.select("row", "owner", "repository", "span", F.sha2("span.value", 256).alias("name"))
    few = (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)
    live = ownership(every).select("name", few.alias("live"))
    n_base = len(BASE)
    by_row = (
        every.select("row", "name", F.struct("span.start", "span.rank", "span.end").alias("span"))
        .join(live, "name")
        .groupBy("row")
        .agg(
            F.collect_list(F.when(F.col("live") | (F.col("span.rank") < n_base), F.col("span"))).alias("all"),
            F.count_if("live").alias("n_live"),
            F.count_if(~F.col("live")).alias("n_copied"),
        )
    )
    base = joined(F.concat(*BASE))
    counted = rows.select("row", "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"))
    return counted.join(by_row, "row", "left").select(
        "doc_id", *[f"n_{k}" for k in BASE], "base_sha256",
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
