"""Streams that correct, release and close by event time: the hourly fold with late readings, sustained heat by timers,
and landing that holds the newest shard back.

What a batch writes goes to folders of its own number, so a batch that is run again after a failure replaces what it
wrote before and adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hexheat import schemas as S
from hexheat.operators.accumulate import DEFAULTS
from hexheat.sources.landing import shard_numbers
from hexheat.streaming.streams import stream_fold


def _start(stream: DataFrame, checkpoint: str, mode: str, batch: Any) -> None:
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


# ---- hourly fold with corrections -----------------------------------------------------------

def fold_with_corrections(readings: DataFrame, values: list[str], path: str, checkpoint: str, watermark: str = "1 hour") -> None:
    """Hourly means kept up to date in a table: every batch writes the hours that it changed, as they now are.

    Readings that come late but within the watermark change their hour. The table keeps what each batch wrote apart;
    `folded_so_far` reads the newest of each (cell, hour), and `compact` writes that down as one.
    """
    def write(changed: DataFrame, batch: int) -> None:
        # The batch is kept as a column too: the reader orders by it.
        changed.withColumns({"batch": F.lit(batch), "day": F.to_date("t")}).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch", "day").parquet(path)

    _start(stream_fold(readings, values, watermark), checkpoint, "update", write)


def folded_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every (cell, hour): one row each, with partial maxima before the shuffle."""
    written = spark.read.parquet(path)
    rest = [c for c in written.columns if c not in ("cell", "t", "batch", "day")]
    newest = F.max_by(F.struct(*rest), "batch").alias("row")
    return written.groupBy("cell", "t").agg(newest).select("cell", "t", "row.*")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The newest states written as a table of the same layout, all under the last batch's number.

    A stream that goes on writes to the new place with later numbers.
    """
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    folded_so_far(spark, path).withColumns({"batch": F.lit(last), "day": F.to_date("t")}).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("batch", "day").parquet(to)


# ---- sustained heat by event time -----------------------------------------------------------

RELEASED_SCHEMA = "cell bigint, t timestamp, l double"


def _timed_processor(
    half_life: float, threshold: float, flush: float, vent: float, idle_hours: float,
    full_vent: float = S.FULL_VENT_MS, full_flush: float = S.FULL_FLUSH_MM,
) -> StatefulProcessor:
    """Made in a function so that it travels whole: workers need not have this package."""
    a = 2.0 ** (-1.0 / half_life)
    idle_ms = int(idle_hours * 3_600_000)

    class Timed(StatefulProcessor):
        """State of a cell: its load, the last hour released and the timer that is set; and the hours held back."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("load", "l double, last bigint, timer bigint")
            self.held = handle.getListState("held", "t bigint, hi double, ws double, mm double")

        def keep(self, level: float, last: int | None, timer: int | None, wanted: int | None) -> None:
            """Writes the state, with the timer moved where it is wanted."""
            if timer != wanted:
                if timer is not None and timer in set(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                if wanted is not None:
                    self.handle.registerTimer(wanted)
            self.state.update((level, last, wanted))

        def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
            import pandas as pd

            level, last, timer = self.state.get() if self.state.exists() else (0.0, None, None)
            earliest = None
            for part in rows:
                part = part[part["hi"].notna()]
                at = (part["t"].astype("datetime64[ms]").astype("int64")).tolist()
                new = [(t, float(h), float(w), float(m)) for t, h, w, m in zip(at, part["hi"], part["ws"], part["mm"]) if last is None or t > last]
                if new:
                    self.held.appendList(new)
                    least = min(r[0] for r in new)
                    earliest = least if earliest is None else min(earliest, least)
            if earliest is not None:
                # A timer that waits for a held hour is earlier than the one that waits for silence.
                waits = [earliest] + ([timer] if timer is not None and (last is None or timer < last + idle_ms) else [])
                self.keep(level, last, timer, min(waits))
            yield pd.DataFrame({"cell": pd.Series(dtype="int64"), "t": pd.Series(dtype="datetime64[ns]"), "l": pd.Series(dtype="float64")})

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:
            import numpy as np
            import pandas as pd

            mark = timerValues.getCurrentWatermarkInMs()
            level, last, timer = self.state.get() if self.state.exists() else (0.0, None, None)
            queue = sorted(set(self.held.get())) if self.held.exists() else []
            due, later = [r for r in queue if r[0] <= mark], [r for r in queue if r[0] > mark]
            levels, times = [], []
            for t, hi, ws, mm in due:
                if last is not None and t <= last:
                    continue
                left = 1.0 - flush * min(mm / full_flush, 1.0)
                level = (a * level + (1.0 - a) * max(hi - threshold, 0.0) * max(1.0 - vent * ws / full_vent, 0.0)) * left
                last = t
                levels.append(level)
                times.append(t)
            if later:
                self.held.put(later)
                self.keep(level, last, None, later[0][0])
            else:
                self.held.clear()
                if last is None or mark >= last + idle_ms:
                    self.state.clear()  # silent too long: the cell starts anew if it comes back
                else:
                    self.keep(level, last, None, last + idle_ms)
            stamps = pd.Series(np.array(times, "int64").astype("datetime64[ms]").astype("datetime64[ns]"))
            yield pd.DataFrame({"cell": np.full(len(times), key[0], "int64"), "t": stamps, "l": np.array(levels, float)})

        def close(self) -> None:
            pass

    return Timed()


def stream_released(hours: DataFrame, delay: str = "24 hours", idle_hours: float = 24.0 * 60, **params: float) -> DataFrame:
    """The recurrence over a stream of `cell, t, hi, ws, mm`, one row per (cell, hour): `cell, t, l` in order of the hours.

    An hour is held until the watermark, `delay` behind the newest hour of any cell, has passed it; a timer then lets
    go all that is due, in order. So nothing has to follow in the same cell, and rows may come in any order within the
    delay. Later ones are dropped by the watermark. A cell that is silent for `idle_hours` after its last hour loses its
    state, and with it its load.
    """
    processor = _timed_processor(**{**DEFAULTS, **params}, idle_hours=idle_hours)
    return hours.withWatermark("t", delay).groupBy("cell").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=RELEASED_SCHEMA, outputMode="Append", timeMode="EventTime",
    )


# ---- landing that holds the newest shard back -----------------------------------------------

def _drop(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def land_closed_stream(source: DataFrame, path: str, checkpoint: str, shard: str = "run") -> None:
    """Rows of a stream landed by shard (a whole number), the newest shard held back until a newer one has begun.

    Rows wait in `<path>.open` until their shard is closed; a closed shard then lands whole. Rows of a shard that
    has landed before land with the batch that brought them. Both folders are laid out by (shard, batch), and a
    batch replaces its own partitions, so running it again changes nothing.
    """
    waiting = f"{path.rstrip('/')}.open"

    def put(rows: DataFrame, to: str) -> None:
        # Ranges of shards, and of rows in a big one: files are about as many as shards, and not shards times tasks.
        rest = [f.name for f in rows.schema if isinstance(f.dataType, T.AtomicType) and f.name not in (shard, "batch")]
        ranged = rows.repartitionByRange(shard, *rest)
        ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard, "batch").parquet(to)

    def land(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        put(rows.withColumn("batch", F.lit(batch)), waiting)
        held = shard_numbers(spark, waiting, shard)
        newest = max([*held, *shard_numbers(spark, path, shard)], default=None)
        closed = [k for k in held if k < newest]
        if closed:
            schema = rows.withColumn("batch", F.lit(batch)).schema
            put(spark.read.schema(schema).parquet(waiting).where(F.col(shard) < newest), path)
            for k in closed:
                _drop(spark, f"{waiting}/{shard}={k}")

    _start(source, checkpoint, "append", land)


def landed_stream(spark: SparkSession, path: str) -> DataFrame:
    """What has landed; the newest shard is not part of it."""
    return spark.read.parquet(path).drop("batch")
