"""Which runs make the film: window requests, stitching, overlaps, and the cost of a read."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexheat import schemas as S
from hexheat.functions import clamp_day, day_count, valid_time

OK, TOO_LONG, NO_RUNS = "ok", "too long", "no runs"


def parse_window(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add `d0, d1` (DATE) from request JSON.

    Unreadable JSON and a missing or empty date mean "no request": both dates NULL. A date
    that is there but is not one is refused with an error.
    """
    parsed = F.from_json(F.col(body), "d0 string, d1 string", {"mode": "PERMISSIVE"})
    given = (F.coalesce(parsed["d0"], F.lit("")) != "") & (F.coalesce(parsed["d1"], F.lit("")) != "")
    return requests.withColumns({
        "d0": F.when(given, parsed["d0"].cast("date")),
        "d1": F.when(given, parsed["d1"].cast("date")),
    })


def run_calendar(runs: DataFrame) -> DataFrame:
    """One row per archive day, gaps filled: runs so far, last init so far, first init from here.

    A few thousand rows for any archive, so its windows over the whole calendar are small.
    """
    daily = runs.groupBy(F.to_date("init_ts").alias("day")).agg(
        F.count("*").alias("n"), F.min("init_ts").alias("first_init"), F.max("init_ts").alias("last_init")
    )
    days = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("day"), "lo", "hi"
    )
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.orderBy("day").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return days.join(daily, "day", "left").select(
        "day", "lo", "hi",
        F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("runs_upto"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.max("last_init").over(upto).alias("last_init"),
        F.min("first_init").over(onward).alias("first_init"),
    )


def resolve_window(
    requests: DataFrame,
    runs: DataFrame,
    default: tuple[str, str] | int = S.DEFAULT_WINDOW,
    max_days: int = S.MAX_WINDOW_DAYS,
    leads: int = S.LEADS_PER_RUN,
) -> DataFrame:
    """Each parsed request as UTC days, hours and a run count, or the reason it is refused.

    Requested days, else the default (two days, or the last N). Clamped to the archive,
    swapped when reversed, refused over `max_days` or with no run inside. The last hour is
    capped at the last valid time there is.
    """
    calendar = run_calendar(runs)
    lo, hi = calendar.agg(F.min("day")).scalar(), calendar.agg(F.max("day")).scalar()
    if isinstance(default, int):
        start, stop = F.date_sub("hi", default - 1), F.col("hi")
    else:
        start, stop = (clamp_day(F.lit(d).cast("date"), F.col("lo"), F.col("hi")) for d in default)
    asked = requests.withColumns({"lo": lo, "hi": hi}).withColumns({
        "a": F.coalesce(clamp_day(F.col("d0"), F.col("lo"), F.col("hi")), start),
        "b": F.coalesce(clamp_day(F.col("d1"), F.col("lo"), F.col("hi")), stop),
    }).withColumns({
        "d0": F.least("a", "b"), "d1": F.greatest("a", "b"),
    }).withColumn("n_days", day_count(F.col("d0"), F.col("d1")))
    opens = calendar.select(
        F.col("day").alias("d0"), (F.col("runs_upto") - F.col("n")).alias("before"), "first_init"
    )
    closes = calendar.select(F.col("day").alias("d1"), "runs_upto", "last_init")
    counted = (
        asked.join(F.broadcast(opens), "d0", "left").join(F.broadcast(closes), "d1", "left")
        .withColumn("n_runs", F.coalesce(F.col("runs_upto") - F.col("before"), F.lit(0)))
    )
    status = (
        F.when(F.col("n_days") > max_days, TOO_LONG).when(F.col("n_runs") == 0, NO_RUNS).otherwise(OK)
    )
    fine = F.col("status") == OK
    last_hour = F.timestamp_add("HOUR", F.lit(23), F.col("d1").cast("timestamp_ntz"))
    last_valid = F.timestamp_add("HOUR", F.lit(leads - 1), F.col("last_init"))
    return counted.withColumn("status", status).select(
        *[c for c in requests.columns if c not in ("d0", "d1")],
        "d0", "d1", "n_days", "status",
        F.when(fine, F.col("n_runs")).alias("n_runs"),
        F.when(fine, F.col("d0").cast("timestamp_ntz")).alias("t0"),
        F.when(fine, F.least(last_hour, last_valid)).alias("t1"),
    )


def require_window(resolved: DataFrame) -> DataFrame:
    """Fail the job on a refused request, for callers that want an error and not a status."""
    refusal = F.concat(F.lit("window refused: "), F.col("status"))
    checked = F.when(F.col("status") == OK, F.col("status")).otherwise(F.raise_error(refusal))
    return resolved.withColumn("status", checked)


def stitch(cube: DataFrame, first_day: date, last_day: date, leads: int = S.LEADS_PER_RUN) -> DataFrame:
    """First `leads` hours of every run whose init is on the days asked for, ends included.

    The day filter prunes stored partitions; the init filter states the exact rule.
    """
    first, last = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    t0 = first.cast("timestamp_ntz")
    t1 = F.timestamp_add("HOUR", F.lit(23), last.cast("timestamp_ntz"))
    kept = cube.where(F.col("init_ts").between(t0, t1) & (F.col("lead_h") < leads))
    if "init_day" in cube.columns:
        kept = kept.where(F.col("init_day").between(first, last))
    return kept


def stitch_union(*cubes: DataFrame) -> DataFrame:
    """Runs kept in separate sources as one cube."""
    whole = cubes[0]
    for cube in cubes[1:]:
        whole = whole.unionByName(cube)
    return whole


def newest_run(cell_runs: DataFrame, values: list[str]) -> DataFrame:
    """One row per (cell, valid hour): the newest init that has one.

    An aggregate and not a rank, so duplicates of a hot hour collapse before the shuffle.
    """
    stamped = cell_runs.withColumn("t", valid_time(F.col("init_ts"), F.col("lead_h")))
    return stamped.groupBy("cell", "t").agg(
        F.max("init_ts").alias("init_ts"),
        *[F.max_by(v, "init_ts").alias(v) for v in values],
    )


def newest(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The greatest key and what stands beside it, as one row."""
    return df.agg(F.max(key).alias(key), *[F.max_by(v, key).alias(v) for v in values])


# ---- fixed values: the cost the reader is told --------------------------------------------
COST_BASE_S, RUNS_PER_DAY, COST_PER_SHARD_S, MINUTES_FROM_S = 6.0, 4, 1.5, 90
# ------------------------------------------------------------------------------------------


def read_cost(windows: DataFrame, n_variables: int) -> DataFrame:
    """Add shards, seconds and the text shown, for windows with `n_days` and `n_runs`."""
    per_day = RUNS_PER_DAY * n_variables * COST_PER_SHARD_S
    seconds = F.rint(COST_BASE_S + per_day * F.col("n_days")).cast("int")
    return windows.withColumns({
        "n_shards": F.col("n_runs") * n_variables,
        "sec_per_day": F.lit(per_day),
        "cost_s": seconds,
        "cost": _cost_text(seconds),
    })


def _cost_text(seconds: Column) -> Column:
    short = F.concat(seconds.cast("string"), F.lit(" s"))
    minutes = F.concat(F.rint(seconds / 60).cast("int").cast("string"), F.lit(" min"))
    return F.when(seconds < MINUTES_FROM_S, short).otherwise(minutes)
