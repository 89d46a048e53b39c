"""Streams by event time against plain Python, split into batches in several ways and started again."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hexheat.streaming import streams, timed

START = datetime(2026, 1, 1)


def hour(n: float) -> datetime:
    return START + timedelta(hours=n)


def walk(hours, half_life=12.0, threshold=27.0, flush=0.5, vent=0.3):
    a, level, out = 2 ** (-1 / half_life), 0.0, []
    for t, hi, ws, mm in sorted(hours):
        level = (a * level + (1 - a) * max(hi - threshold, 0) * max(1 - vent * ws / 10, 0)) * (1 - flush * min(mm / 2.5, 1))
        out.append((t, level))
    return out


def test_hours_come_out_by_the_watermark_alone(spark, tmp_path):
    """Held hours need no later row of their cell; each part of the input is a run of its own, from the checkpoint."""
    r = random.Random(1)
    hours = {c: sorted(r.sample(range(200), 60)) for c in range(5)}
    hours[9] = [3, 5]  # silent long before the end
    rows = [(c, hour(h), r.uniform(20, 50), float(r.randint(0, 12)), r.choice([0.0, 1.0, 3.0])) for c, hs in hours.items() for h in hs]
    parts = [[x for x in rows if x[1] < hour(80)], [x for x in rows if hour(80) <= x[1] < hour(150)], [x for x in rows if x[1] >= hour(150)]]
    parts[0], moved = parts[0][::2] + [x for x in parts[0][1::2] if x[1] < hour(70)], [x for x in parts[0][1::2] if x[1] >= hour(70)]
    parts[1] += moved  # out of order, within the delay
    folder = f"{tmp_path}/hours"
    for part in parts:
        r.shuffle(part)
        spark.createDataFrame(part, "cell long, t timestamp, value double, ws double, mm double").withColumn("n", F.lit(1).cast("long")).repartition(2).write.mode("append").parquet(folder)
        stream = streams.read_files(spark, folder, streams.HOUR_SCHEMA).select("cell", "t", F.col("value").alias("hi"), "ws", "mm")
        with streams.state_provider(spark):
            streams.drain(timed.stream_released(stream, "24 hours 30 minutes"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    by_cell, newest = defaultdict(list), max(x[1] for x in rows)
    for c, *rest in rows:
        by_cell[c].append(tuple(rest))
    expected = {(c, t): v for c, hs in by_cell.items() for t, v in walk(hs) if t <= newest - timedelta(hours=24.5)}
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == len(expected)
    assert {(x.cell, x.t): pytest.approx(x.l) for x in out} == expected


def test_a_silent_cell_loses_its_state(spark, tmp_path):
    rows = [(1, hour(0), 60.0), (1, hour(1), 60.0), (2, hour(0), 30.0), (2, hour(300), 30.0)]
    later = [(1, hour(301), 28.0), (2, hour(500), 30.0)]
    folder = f"{tmp_path}/hours"
    for part in (rows, later):
        spark.createDataFrame([(*x, 0.0, 0.0, 1) for x in part], "cell long, t timestamp, value double, ws double, mm double, n long").write.mode("append").parquet(folder)
        stream = streams.read_files(spark, folder, streams.HOUR_SCHEMA).select("cell", "t", F.col("value").alias("hi"), "ws", "mm")
        with streams.state_provider(spark):
            streams.drain(timed.stream_released(stream, "2 hours", idle_hours=48.0), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    out = {(x.cell, x.t): x.l for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out[1, hour(301)] == pytest.approx(walk([(hour(301), 28.0, 0.0, 0.0)])[0][1])
    assert out[1, hour(1)] == pytest.approx(walk([(hour(0), 60.0, 0.0, 0.0), (hour(1), 60.0, 0.0, 0.0)])[1][1])


def test_late_readings_correct_their_hour(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, START + timedelta(minutes=r.randrange(6000)), r.randrange(4), "x", r.uniform(0, 9), None) for i in range(600)]
    folder = f"{tmp_path}/events"
    for k in range(3):
        spark.createDataFrame([x for x in rows if x[0] % 3 == k], streams.EVENT_SCHEMA).write.mode("append").parquet(folder)
        stream = streams.read_files(spark, folder, streams.EVENT_SCHEMA).select(F.col("user_id").alias("cell"), "ts", "value")
        timed.fold_with_corrections(stream, ["value"], f"{tmp_path}/table", f"{tmp_path}/checkpoint", "10 days")
    expected = defaultdict(list)
    for _, ts, cell, _, value, _ in rows:
        expected[cell, ts.replace(minute=0)].append(value)
    expected = {k: (len(v), pytest.approx(sum(v) / len(v))) for k, v in expected.items()}
    table = timed.folded_so_far(spark, f"{tmp_path}/table")
    assert {(x.cell, x.t): (x.n, x.value) for x in table.collect()} == expected
    n_before = spark.read.parquet(f"{tmp_path}/table").count()
    timed.compact(spark, f"{tmp_path}/table", f"{tmp_path}/compact")
    assert spark.read.parquet(f"{tmp_path}/compact").count() == len(expected) < n_before
    assert {(x.cell, x.t): (x.n, x.value) for x in timed.folded_so_far(spark, f"{tmp_path}/compact").collect()} == expected


@pytest.mark.parametrize("seed", range(2))
def test_closed_shards_land_whole_after_any_split(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.randrange(6), i) for i in range(300)]
    folder = f"{tmp_path}/in"
    for k in range(4):
        part = sorted(x for x in rows if x[1] % 4 == k)
        part = [x for x in part if x[0] <= k + 2] if k < 3 else part + [x for x in rows if x[1] % 4 < 3 and x[0] > x[1] % 4 + 2]
        spark.createDataFrame(part, "run int, x int").write.mode("append").parquet(folder)
        source = streams.read_files(spark, folder, spark.createDataFrame([], "run int, x int").schema, per_batch=3)
        timed.land_closed_stream(source, f"{tmp_path}/landed", f"{tmp_path}/checkpoint")
        landed = timed.landed_stream(spark, f"{tmp_path}/landed")
        assert landed.where(F.col("run") >= k + 2).isEmpty() or k == 3
    got = sorted((x.run, x.x) for x in landed.collect())
    assert got == sorted(x for x in rows if x[0] < max(rows)[0])


def test_files_of_a_landing_are_about_as_many_as_its_shards(spark, tmp_path):
    """Not shards times tasks: rows of all shards lie in every file that comes in."""
    rows = spark.range(4000).select((F.col("id") % 20).cast("int").alias("run"), "id", F.array("id").alias("ids"))
    rows.repartition(8, F.xxhash64("id")).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    try:
        timed.land_closed_stream(streams.read_files(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/landed", f"{tmp_path}/checkpoint")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    landed = timed.landed_stream(spark, f"{tmp_path}/landed")
    assert len(landed.inputFiles()) <= 19 + 8
    assert landed.exceptAll(rows.where("run < 19").select(landed.columns)).isEmpty() and landed.count() == 19 * 200
