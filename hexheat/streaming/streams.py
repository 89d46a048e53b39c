"""Hourly fold, sustained heat with state, and landing, as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hexheat import schemas as S
from hexheat.operators.accumulate import DEFAULTS
from hexheat.session import STATE_PROVIDER, work_dir

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

HOUR_SCHEMA = T.StructType([
    T.StructField("cell", T.LongType()),
    T.StructField("t", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("ws", T.DoubleType()),
    T.StructField("mm", T.DoubleType()),
    T.StructField("n", T.LongType()),
])


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def stream_fold(readings: DataFrame, values: list[str], watermark: str = "1 hour") -> DataFrame:
    """Hourly mean per cell, each hour emitted once the watermark has passed its end.

    `readings` has `cell, ts` and the value columns; `ts` may be without a zone. Partial
    averages are formed before the shuffle, so one crowded cell costs one row per task.
    """
    stamped = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    means = stamped.groupBy(F.window("ts", "1 hour").alias("w"), "cell").agg(
        *[F.avg(v).alias(v) for v in values], F.count("*").alias("n")
    )
    return means.select("cell", F.col("w.start").alias("t"), *values, "n")


SUSTAINED_SCHEMA = "cell bigint, t timestamp, l double, late bigint"


def _processor(
    half_life: float, threshold: float, flush: float, vent: float, hold_hours: float,
    full_vent: float = S.FULL_VENT_MS, full_flush: float = S.FULL_FLUSH_MM,
) -> StatefulProcessor:
    """Made in a function so that it travels whole: workers need not have this package."""
    a = 2.0 ** (-1.0 / half_life)

    class Sustained(StatefulProcessor):
        """State of a cell: its load, the last hour released, the newest hour seen, late rows, the first hour held back,
        and the rows held back. Those are added to, and read only once one of them is due."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("load", "l double, last timestamp, top timestamp, late bigint, first timestamp")
            self.held = handle.getListState("held", "t timestamp, hi double, ws double, mm double")

        def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
            import numpy as np
            import pandas as pd

            def stamps(values: Any) -> Any:
                return np.asarray(values, dtype="datetime64[us]")

            level, last, top, late, first = self.state.get() if self.state.exists() else (0.0, None, None, 0, None)
            before = late
            last, top, first = (None if v is None else stamps(v) for v in (last, top, first))
            fresh = []
            for part in rows:  # one Arrow batch after the other; late rows are counted and let go
                t, hi = stamps(part["t"].to_numpy()), part["hi"].to_numpy(float)
                if last is not None:
                    late += int((~(t > last)).sum())
                in_time = np.ones(len(t), dtype=bool) if last is None else t > last
                if in_time.any():
                    newest = t[in_time].max()
                    top = newest if top is None else max(top, newest)
                kept = in_time & ~np.isnan(hi)
                if kept.any():
                    fresh.append((t[kept], hi[kept], *(part[c].to_numpy(float)[kept] for c in ("ws", "mm"))))
                    earliest = t[kept].min()
                    first = earliest if first is None else min(first, earliest)
            limit = None if top is None else top - np.timedelta64(int(hold_hours * 3_600_000_000), "us")
            if first is not None and first <= limit:
                if self.held.exists():
                    columns = list(zip(*self.held.get()))
                    fresh.insert(0, (stamps(columns[0]), *(np.array(c, dtype=float) for c in columns[1:])))
                queue = [np.concatenate(c) for c in zip(*fresh)]
                _, order = np.unique(queue[0], return_index=True)  # in order of the hours, the first row of each
                t, hi, ws, mm = (c[order] for c in queue)
                due = int(np.searchsorted(t, limit, "right"))
                left = 1.0 - flush * np.minimum(mm[:due] / full_flush, 1.0)
                excess = np.maximum(hi[:due] - threshold, 0.0) * np.maximum(1.0 - vent * ws[:due] / full_vent, 0.0)
                A, B = a * left, (1.0 - a) * excess * left
                B[0] += A[0] * level
                A[0] = 0.0
                step = 1
                while step < len(A):  # affine steps composed by doubling
                    B[step:] += A[step:] * B[:-step]
                    A[step:] = A[step:] * A[:-step]
                    step *= 2
                level, last = float(B[-1]), t[due - 1]
                yield pd.DataFrame({"cell": key[0], "t": t[:due].astype("datetime64[ns]"), "l": B, "late": late})
                self.held.clear()
                fresh = [(t[due:], hi[due:], ws[due:], mm[due:])] if due < len(t) else []
                first = t[due] if fresh else None
            elif late > before:
                yield pd.DataFrame({"cell": [key[0]], "t": [pd.NaT], "l": [None], "late": [late]}).astype({"t": "datetime64[ns]", "l": float})
            plain = lambda t: None if t is None else t.item()
            self.state.update((level, plain(last), plain(top), late, plain(first)))
            if fresh:
                self.held.appendList([row for part in fresh for row in zip(*(c.tolist() for c in part))])

        def close(self) -> None:
            pass

    return Sustained()


def stream_sustained(hours: DataFrame, hold_hours: float = 0.0, **params: float) -> DataFrame:
    """The recurrence over a stream of `cell, t, hi, ws, mm`, one row per (cell, hour), in order of the hours.

    Rows may come in any order within `hold_hours`: a cell's hours are held back until one that much
    later has been seen, and then stepped through in order. A row without a heat index only says
    how far time has got, and so lets go what is held. Rows at or before the last hour let go are
    late: counted, not applied. Output has `late`, the cell's count so far; a batch that brought
    late rows and nothing else gives a row with the count alone (`t` NULL).
    """
    processor = _processor(**{**DEFAULTS, **params}, hold_hours=hold_hours)
    return hours.groupBy("cell").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=SUSTAINED_SCHEMA,
        outputMode="Append", timeMode="None",
    )


@contextmanager
def state_provider(spark: SparkSession) -> Iterator[None]:
    """The state store that arbitrary state needs, for the queries started inside."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, STATE_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)


def drain(stream: DataFrame, out: str, checkpoint: str, partition: str | None = None) -> None:
    """Write all there is to Parquet, then stop. Starting again goes on where it ended."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    if partition:
        writer = writer.partitionBy(partition)
    writer.start().awaitTermination()


def stream_land(source: DataFrame, path: str, checkpoint: str, shard: str = "run") -> None:
    """Append shard files that have not been seen before, by the checkpoint's own record."""
    drain(source, path, checkpoint, shard)


def fold_events(spark: SparkSession, readings: DataFrame, values: list[str]) -> DataFrame:
    """Run the hourly fold over a finite stream and read back what it emitted."""
    base = work_dir(spark, "stream-fold")
    drain(stream_fold(readings, values), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")
