"""Windows, landing, sinks, streams, and the plans Spark makes of the jobs."""

from __future__ import annotations

import os
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hexheat import functions as H, schemas as S
from hexheat.operators import accumulate, film, fold, regions, windowing
from hexheat.plans import catalogue, mask, week
from hexheat.session import BROADCAST_LIMIT, broadcast_checked, estimated_bytes, work_dir
from hexheat.sources import archive, derived, landing, sinks
from hexheat.streaming import streams

START = datetime(2026, 6, 29)


@pytest.fixture(scope="module", autouse=True)
def whole_metadata(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---- windows ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def runs(spark):
    rows = [(i, datetime(2026, 6, 1) + timedelta(hours=6 * i)) for i in range(160) if not 40 <= i < 60]
    return spark.createDataFrame(rows, "run int, init_ts timestamp_ntz")


def ask(spark, runs, body, **how):
    asked = windowing.parse_window(spark.createDataFrame([(body,)], "body string"))
    return windowing.resolve_window(asked, runs, **how).collect()[0]


def test_request_rules(spark, runs):
    def days(body, **how):
        r = ask(spark, runs, body, **how)
        return r.d0, r.d1, r.status

    inside = (date(2026, 6, 20), date(2026, 6, 22), "ok")
    assert days('{"d0":"2026-06-20","d1":"2026-06-22"}') == inside
    assert days('{"d0":"2026-06-22","d1":"2026-06-20"}') == inside
    default = (date(2026, 6, 29), date(2026, 7, 5), "ok")
    for body in ("{}", "nonsense", '{"d0":"2026-06-20"}', '{"d0":"","d1":"2026-06-22"}', None):
        assert days(body) == default
    assert days("{}", default=7) == (date(2026, 7, 4), date(2026, 7, 10), "ok")
    assert days('{"d0":"2020-01-01","d1":"2026-06-02"}') == (date(2026, 6, 1), date(2026, 6, 2), "ok")
    assert days('{"d0":"2026-06-20","d1":"2026-07-03"}')[2] == "ok"
    assert days('{"d0":"2026-06-20","d1":"2026-07-04"}')[2] == "too long"
    assert days('{"d0":"2026-06-12","d1":"2026-06-14"}')[2] == "no runs"


def test_last_hour_is_capped_at_the_last_valid_time(spark, runs):
    r = ask(spark, runs, '{"d0":"2026-07-09","d1":"2026-07-10"}')
    assert (r.t0, r.t1, r.n_runs) == (datetime(2026, 7, 9), datetime(2026, 7, 10, 23), 8)
    short = runs.where("run < 158")
    assert ask(spark, short, '{"d0":"2026-07-09","d1":"2026-07-10"}').t1 == datetime(2026, 7, 10, 11)


def test_a_malformed_date_is_refused(spark, runs):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        ask(spark, runs, '{"d0":"June","d1":"2026-07-10"}')


def test_require_window_fails_the_job(spark, runs):
    asked = windowing.parse_window(spark.createDataFrame([('{"d0":"2026-06-12","d1":"2026-06-14"}',)], "body string"))
    with pytest.raises(Exception, match="no runs"):
        windowing.require_window(windowing.resolve_window(asked, runs)).collect()


def test_newest_of_a_table(spark, runs):
    assert tuple(windowing.newest(runs, "init_ts", ["run"]).collect()[0]) == (datetime(2026, 7, 10, 18), 159)


# ---- sources and sinks --------------------------------------------------------------------

def test_cached_table_is_built_once(spark):
    base, built = work_dir(spark, "cache"), []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert landing.cached_table(spark, base, {"zoom": 8}, build).count() == 3
    landing.cached_table(spark, base, {"zoom": 9}, build)
    assert len(built) == 2


def test_a_table_cut_off_while_it_was_written_is_built_again(spark):
    base, parts = work_dir(spark, "cache"), {"zoom": 8}
    path = f"{base}/{landing.table_key(parts)}"
    spark.range(1).write.parquet(path)  # files, but no marker after them
    assert landing.cached_table(spark, base, parts, lambda: spark.range(3)).count() == 3
    assert landing.cached_table(spark, base, parts, lambda: spark.range(9)).count() == 3


def test_a_rewritten_film_keeps_no_day_of_the_old_window(spark):
    path = work_dir(spark, "film")
    hours = spark.range(48).selectExpr("timestampadd(HOUR, int(id), TIMESTAMP_NTZ'2026-06-29 00:00:00') AS t", "1L AS cell", "id AS hi_q")
    sinks.write_film(hours, path)
    sinks.write_film(hours.where("t >= TIMESTAMP_NTZ'2026-06-30 00:00:00'"), path)
    assert spark.read.parquet(path).count() == 24


def test_work_folders_are_shared_and_can_be_dropped(spark):
    path = work_dir(spark, "gone")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir"))


def test_stored_runs_are_read_beside_the_cube(spark, sf):
    path = work_dir(spark, "cube")
    cube = derived.pixel_hours(spark, sf)
    archive.write_cube(cube.where("run < 8"), path)
    first = archive.stored_runs(spark, path)
    assert sorted(r.run for r in first.collect()) == list(range(8))
    assert path + ".runs" in plan_of(first) and path + "]" not in plan_of(first)
    # A cube written on without its note: its days are found by their folders.
    cube.where("run >= 8 and run < 12").withColumn("init_day", F.to_date("init_ts")).write.mode("append").partitionBy(*S.CUBE_PARTITIONS).parquet(path)
    assert sorted(r.run for r in archive.stored_runs(spark, path).collect()) == list(range(12))


def test_sql_fold_equals_the_frame_fold_on_odd_readings(spark, sf):
    """NaN humidity, and views of the user's own that stay what they are."""
    from hexheat.plans import sql

    spark.range(3).createOrReplaceTempView("cube")
    sql.register_functions(spark)
    cube = windowing.stitch(derived.pixel_hours(spark, sf), *S.DEFAULT_WINDOW)
    assert cube.where("isnan(rh)").count() > 0
    a = sql.fold_sql(spark, cube, derived.grid(spark, sf), derived.RES).select("cell", "init_ts", "lead_h", "tc", "rh")
    b = fold.fold(cube, catalogue.pixels(spark, sf)).select(a.columns)
    assert b.where("rh IS NULL").count() > 0
    near = a.join(b.withColumnsRenamed({"tc": "tc2", "rh": "rh2"}), ["cell", "init_ts", "lead_h"])
    assert near.where("abs(tc - tc2) < 1e-4 AND (rh IS NULL AND rh2 IS NULL OR abs(rh - rh2) < 1e-4)").count() == a.count() == b.count()
    assert spark.table("cube").count() == 3
    spark.catalog.dropTempView("cube")


def test_a_parameter_table(spark, sf):
    heat = catalogue.heat(spark, sf)
    table = spark.createDataFrame([(7, 48.0, None), (3, None, 1.0)], "param int, half_life double, flush double")
    got = {r.param: r.s for r in accumulate.sweep(heat, table).groupBy("param").agg(F.sum("l").alias("s")).collect()}
    want = [accumulate.sustained_heat(heat, **p).agg(F.sum("l")).first()[0] for p in ({"half_life": 48.0}, {"flush": 1.0})]
    assert got[7] == pytest.approx(want[0]) and got[3] == pytest.approx(want[1])


def test_memo_keeps_only_the_last_answer(spark):
    memo = landing.FoldMemo()
    first = memo.get({"k": 1}, lambda: spark.range(3))
    assert memo.get({"k": 1}, lambda: spark.range(9)) is first
    assert memo.get({"k": 2}, lambda: spark.range(9)).count() == 9
    assert not first.storageLevel.useMemory
    memo.release()


def test_keys_asked_and_landed_meet_in_one_aggregate(spark):
    """No join after two distincts; a key with a NULL is asked for and never a hit."""
    asked = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 1), ("c", None)], "key string, part int")
    landed = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("z", 1), (None, 1), ("c", None)], "key string, part int")
    split = landing.split_landed(asked, landed, ["key", "part"])
    assert {tuple(r) for r in split.collect()} == {("a", 1, True), ("b", 1, False), (None, 1, False), ("c", None, False)}
    assert split.count() == 4 and "Join" not in plan_of(split)


def test_newest_shard_never_lands_and_landing_is_repeatable(spark):
    path = work_dir(spark, "landing")
    source = spark.range(100).select(F.floor(F.col("id") / 10).cast("int").alias("run"), F.col("id").alias("yi"), F.col("id").alias("xi"))
    early = source.where("run <= 5")
    for _ in range(2):
        landing.land_closed(spark, early, path)
    landed = landing.landed_table(spark, path, source)
    assert landed.count() == 50 and landed.agg(F.max("run")).first()[0] == 4
    # run 5 grew after the first landing saw it; what it has now is what is read
    landing.land_closed(spark, source, path)
    seen = landing.mirrored(spark, source, path)
    assert seen.count() == 100 and seen.where("from_landing").count() == 90


def test_release_rules(spark):
    listing = spark.createDataFrame([("tiles/2026-07-22.0/",), ("tiles/2026-08-19.0/",)], "prefix string")
    assert archive.latest_release(listing).first()[0] == "2026-08-19.0"
    assert archive.latest_release(listing, pin="x").first()[0] == "x"
    assert archive.latest_release(listing.limit(0), fallback="f").first()[0] == "f"


def test_film_is_stored_in_frame_order(spark, sf):
    path = work_dir(spark, "film")
    sinks.write_film(catalogue.heat(spark, sf), path)
    stored = spark.read.parquet(path)
    assert stored.count() == catalogue.heat(spark, sf).count()
    from hexheat.operators.film import frame_snapshot
    assert re.search(r"PartitionFilters: \[.*day", plan_of(frame_snapshot(stored, catalogue.SHOWN_HOUR)))


def test_observed_statistics(spark, sf):
    watched, stats = sinks.observed(catalogue.heat(spark, sf), "film", ["hi_q"])
    n = watched.count()
    assert stats.get["n_rows"] == n and stats.get["max_hi_q"] <= 254


def test_properties_map(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "y"], [1, 0, 0, 1]), (["a"], ["x"], [])], "k array<string>, v array<string>, t array<int>")
    got = [r[0] for r in df.select(archive.properties(F.col("k"), F.col("v"), F.col("t"))).collect()]
    assert got == [{"b": "x", "a": "y"}, None]


def test_shard_keys(spark):
    df = spark.createDataFrame([("tc/c/12/0/0",), ("tc/zarr.json",), ("tc/c/x/0/0",), ("q/c/3/0/0",)], "key string")
    assert [r[0] for r in df.select(H.shard_index(F.col("key"), ("tc",))).collect()] == [12, None, None, None]


# ---- mask and whole jobs ------------------------------------------------------------------

def test_mask_tables(spark, sf):
    cells = mask.cell_table(catalogue.counties(spark, sf), 4)
    rows = cells.orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows)))
    assert [r.cell for r in rows] == sorted(r.cell for r in rows)
    assert all(r.readout == f"cell in {r.label}" for r in rows)


def test_two_pieces_dissolve_to_the_whole(spark, sf):
    def filled(pieces):
        cells = regions.polyfill_cells(regions.ring_edges(pieces), 5)
        return {tuple(r) for r in regions.dissolve(cells, ["cell"]).collect()}

    assert filled(derived.pieces(spark, sf)) == filled(derived.divisions(spark, sf))


def test_a_third_of_all_readings_on_one_pixel(spark, sf):
    """Skew changes where the work is, not the answer."""
    cube = derived.pixel_hours(spark, sf)
    hot = cube.unionByName(cube.withColumns({"yi": F.lit(0), "xi": F.lit(0)}))
    hours = fold.cell_hours(fold.fold(windowing.stitch(hot, *S.DEFAULT_WINDOW), catalogue.pixels(spark, sf)))
    assert hours.count() == hours.select("cell", "t").distinct().count()
    one_cell = hours.join(catalogue.pixels(spark, sf).where("yi = 0 AND xi = 0").select("cell"), "cell")
    assert one_cell.count() == 168


# ---- plans --------------------------------------------------------------------------------

def test_fold_plan(spark, sf):
    plan = plan_of(catalogue.heat(spark, sf))
    assert "BroadcastHashJoin" in plan and "partial_avg" in plan
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    read = re.search(r"ReadSchema: struct<([^>]*l_orderkey[^>]*)>", plan).group(1)
    assert "l_discount" in read and "l_shipdate" not in read and "l_extendedprice" not in read


def test_no_nested_loops_in_joins(spark, sf):
    for name in ("polyfill_center", "polyfill_counties", "covering_run", "densified_film", "resolve_window", "pick_points"):
        plan = plan_of(catalogue.QUERIES[name](spark, sf))
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_sweep_shuffles_the_film_once(spark, sf):
    few, many = (plan_of(accumulate.sweep(catalogue.heat(spark, sf), p)) for p in ([{}], derived.parameters()))
    assert few.count("Exchange hashpartitioning") == many.count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def stored(spark, sf):
    path = work_dir(spark, "cube")
    archive.write_cube(derived.pixel_hours(spark, sf).where("yb < 4 AND xb < 4"), path)
    return path


def test_blocks_and_days_are_pruned(spark, sf, stored):
    cube = archive.scan_cube(spark, stored, ["tc", "rh"])
    blocks = spark.read.schema("yb int, xb int").parquet(stored).where("yb = 1").select("yb", "xb").distinct()
    pruned = plan_of(fold.prune_blocks(windowing.stitch(cube, "2026-06-30", "2026-07-01"), blocks))
    assert "dynamicpruning" in pruned
    assert re.search(r"PartitionFilters: \[[^\]]*init_day", pruned)
    assert "wind" not in pruned and "rain" not in re.findall(r"ReadSchema: (.*)", pruned)[0]
    assert fold.in_spans(cube, fold.block_spans(blocks)).count() == fold.prune_blocks(cube, blocks).count() > 0


def test_pruning_holds_however_large_the_lookup_seems(spark, sf, stored):
    """Blocks that follow from a plan estimated far above the broadcast limit still prune the scan."""
    ids = spark.range(20_000)
    huge = ids.join(ids.withColumnRenamed("id", "k"), F.col("id") == F.col("k")).select((F.col("id") % 2).cast("int").alias("yb"), F.lit(1).alias("xb"))
    assert estimated_bytes(huge) > 10 * BROADCAST_LIMIT
    kept = fold.prune_blocks(archive.scan_cube(spark, stored, ["tc"]), huge)
    assert kept.count() > 0
    kept.collect()
    assert re.search(r"dynamicpruningexpression\([xy]b", plan_of(kept))


def test_a_cube_of_many_blocks_has_a_folder_a_day(spark, sf, tmp_path):
    """Folders grow with the days and not with days times blocks; blocks are pruned by what row groups hold."""
    readings = derived.pixel_hours(spark, sf).withColumns({"yb": F.col("yi"), "xb": F.col("xi")})
    path = f"{tmp_path}/cube"
    for half in (F.col("run") < 8, F.col("run") >= 8):  # the second is written on, into the folders that are there
        archive.write_cube(readings.where(half), path)
    assert readings.select("yb", "xb").distinct().count() > S.MOST_BLOCK_FOLDERS
    assert len([d for d, _, files in os.walk(path) if any(f.endswith(".parquet") for f in files)]) == 7
    cube = archive.scan_cube(spark, path)
    assert cube.exceptAll(readings.select(cube.columns)).count() == 0 and cube.count() == readings.count()
    blocks = spark.createDataFrame([(1, 2), (1, 9), (17, 4)], "yb int, xb int")
    kept = fold.prune_blocks(cube, blocks)
    assert re.search(r"PushedFilters: \[[^\]]*yb", kept._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert kept.count() == readings.join(blocks, ["yb", "xb"], "left_semi").count() > 0
    assert fold.prune_blocks(cube, blocks.where("false")).count() == 0


def test_the_film_is_not_shuffled_by_hour(spark, sf):
    heat = catalogue.heat(spark, sf)
    for df in (
        film.index_film(heat, film.frames(heat), catalogue.cells(spark, sf)),
        film.densify(heat, catalogue.cells(spark, sf), catalogue.T0, catalogue.T1),
    ):
        assert not re.search(r"Exchange hashpartitioning\(t#\d+, ", plan_of(df))


def test_queries_cover_an_archive_of_several_weeks(spark, sf, monkeypatch):
    monkeypatch.setattr(derived, "ORDERS_A_WEEK", 500)
    monkeypatch.setattr(catalogue, "CUBES", {})
    n_runs = derived.shape(spark, sf).runs
    assert n_runs > derived.RUNS_A_WEEK
    q = catalogue.QUERIES
    read = derived.pixel_hours(spark, sf).where("lead_h < 6 AND NOT isnan(tc)").join(catalogue.pixels(spark, sf), ["yi", "xi"])
    held = read.select("cell", "run", "lead_h").distinct().count()
    for name in ("fold_cell_hour", "fold_by_sql", "fold_two_fields"):
        assert q[name](spark, sf).count() == held
    film_rows = q["heat_index_film"](spark, sf)
    assert film_rows.count() == catalogue.cell_hour(spark, sf).where("rh IS NOT NULL").count()
    last = START + timedelta(hours=6 * n_runs - 1)
    assert film_rows.agg(F.max("t")).first()[0] == last
    for name in ("densified_film", "pick_points", "masked_fold"):
        assert q[name](spark, sf).agg(F.max("t")).first()[0] == last
    frames = film_rows.select("t").distinct().count()
    assert q["densified_film"](spark, sf).count() == q["write_dense_film"](spark, sf).count() == frames * catalogue.cells(spark, sf).count()


def test_a_cell_is_taken_before_the_recurrence(spark, sf):
    plan = plan_of(catalogue.QUERIES["cell_series"](spark, sf))
    below = plan[plan.index("MapInArrow"):]
    assert re.search(r"Filter.*cell#\d+L? =|cell_at|= \d{6,}", below)


def test_codes_come_out_of_the_recurrence_without_a_join(spark, sf):
    heat = catalogue.heat(spark, sf)
    assert plan_of(week.heat_and_load(heat)).count("Join") == plan_of(heat).count("Join")


def test_positions_without_one_task(spark):
    keys = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).where("k <> 5")
    placed = film.positions(keys, "k")
    got = sorted((r.k, r.pos) for r in placed.collect())
    assert [p for _, p in got] == list(range(len(got)))
    assert film.positions(keys.limit(0), "k").count() == 0


def test_broadcast_only_below_the_limit(spark, sf):
    small = spark.range(10)
    assert estimated_bytes(small) <= 80
    big = spark.range(1000)
    joined = big.join(broadcast_checked(small, limit=10), "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(big.join(broadcast_checked(small, limit=10), "id"))
        assert "BroadcastHashJoin" in plan_of(big.join(broadcast_checked(small), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == 10


def test_masked_job_reads_the_same_as_the_unstored_one(spark, sf, stored):
    lookup = catalogue.land_lookup(spark, sf)
    cube = archive.scan_cube(spark, stored)
    a = week.load_window(fold.prune_blocks(cube, fold.land_blocks(lookup)), lookup)
    b = week.load_window(derived.pixel_hours(spark, sf).where("yb < 4 AND xb < 4"), lookup)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# ---- streams ------------------------------------------------------------------------------

def hours_frame(spark, rows):
    return spark.createDataFrame(rows, "cell bigint, t timestamp, hi double, ws double, mm double").coalesce(1)


def test_stream_equals_batch_and_late_rows_change_nothing(spark):
    base = work_dir(spark, "sustained")
    t0 = datetime(2026, 6, 29)
    series = [(c, t0 + timedelta(hours=h), 27.5 + (h * c) % 11, float(h % 6), 0.5 * (h % 4)) for c in (1, 2, 3) for h in range(48)]
    batches = [[r for r in series if b * 16 <= (r[1] - t0).total_seconds() / 3600 < (b + 1) * 16] for b in range(3)]
    late = [(1, t0 + timedelta(hours=3), 90.0, 0.0, 0.0)]
    schema = hours_frame(spark, series).schema
    with streams.state_provider(spark):
        for rows in [*batches, late]:
            hours_frame(spark, rows).write.mode("append").parquet(f"{base}/in")
            source = streams.read_files(spark, f"{base}/in", schema, per_batch=1)
            streams.drain(streams.stream_sustained(source), f"{base}/out", f"{base}/checkpoint")
    out = spark.read.parquet(f"{base}/out").collect()
    assert [(r.cell, r.late) for r in out if r.t is None] == [(1, 1)]  # the late batch gave its count
    got = {(r.cell, r.t): r.l for r in out if r.t is not None}
    film = hours_frame(spark, series).withColumn("hi", F.col("hi").cast("double"))
    want = {(r.cell, r.t): r.l for r in accumulate.sustained_heat(film, quantised=False).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_hours_that_come_in_the_wrong_order_are_held_back(spark):
    """The later day's file first, a file a batch: all hours come out, in order, once time has gone on."""
    base = work_dir(spark, "held")
    t0 = datetime(2026, 6, 29)
    series = [(1, t0 + timedelta(hours=h), 27.5 + h % 9, 1.0, 0.5 * (h % 3)) for h in range(48)]
    flush = [(1, t0 + timedelta(days=90), None, None, None)]
    for rows in (series[24:], series[:24], flush):
        hours_frame(spark, rows).write.mode("append").parquet(f"{base}/in")
    source = streams.read_files(spark, f"{base}/in", hours_frame(spark, series).schema, per_batch=1)
    with streams.state_provider(spark):
        streams.drain(streams.stream_sustained(source, hold_hours=48), f"{base}/out", f"{base}/checkpoint")
    got = {(r.cell, r.t): r.l for r in spark.read.parquet(f"{base}/out").collect()}
    want = {(r.cell, r.t): r.l for r in accumulate.sustained_heat(hours_frame(spark, series), quantised=False).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_what_is_held_is_added_to_and_read_only_when_due():
    """The processor alone, its state counted: three batches of hours, then one that lets all but its own go."""
    import pandas as pd

    class Kept:
        def __init__(self):
            self.value, self.read, self.added = None, 0, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.read += 1
            return iter(self.value) if isinstance(self.value, list) else self.value

        def update(self, value):
            self.value = value

        def put(self, rows):
            self.value, self.added = list(rows), self.added + len(rows)

        def appendList(self, rows):
            self.put([*(self.value or []), *rows])
            self.added -= len(self.value) - len(rows)

        def clear(self):
            self.value = None

    class Handle:
        def __init__(self):
            self.state, self.held = Kept(), Kept()

        def getValueState(self, *_):
            return self.state

        def getListState(self, *_):
            return self.held

    t0 = pd.Timestamp("2026-06-29")
    batch = lambda hours: pd.DataFrame({"t": [t0 + pd.Timedelta(hours=h) for h in hours], "hi": 40.0, "ws": 0.0, "mm": 0.0})
    handle, processor = Handle(), streams._processor(12.0, 27.0, 0.5, 0.3, hold_hours=48.0)
    processor.init(handle)
    for hours in ([3, 4], [0, 1, 1], [2, 5]):
        assert list(processor.handleInputRows((7,), iter([batch(hours)]), None)) == []
    assert handle.held.read == 0 and handle.held.added == 7
    (out,) = processor.handleInputRows((7,), iter([batch([200])]), None)
    assert list(out["t"]) == [t0 + pd.Timedelta(hours=h) for h in range(6)] and list(out["late"]) == [0] * 6
    assert handle.held.read == 1 and len(handle.held.value) == 1
    (none,) = processor.handleInputRows((7,), iter([batch([5])]), None)
    assert list(none["late"]) == [1] and none["t"].isna().all()


def test_stream_landing_lands_nothing_twice(spark):
    base = work_dir(spark, "land")
    frame = spark.range(20).select((F.col("id") % 4).cast("int").alias("run"), F.col("id").alias("v"))
    for n in (1, 2):
        frame.coalesce(1).write.mode("append").parquet(f"{base}/in")
        for _ in range(2):
            source = streams.read_files(spark, f"{base}/in", frame.schema)
            streams.stream_land(source, f"{base}/out", f"{base}/checkpoint")
        assert spark.read.parquet(f"{base}/out").count() == 20 * n


def test_stream_landing_of_a_cube_of_many_blocks_has_few_files(spark):
    """Files that come in hold a day and not a day and block, so what lands grows with the runs and not with blocks."""
    base = work_dir(spark, "land-blocks")
    readings = spark.range(6000).selectExpr(
        "int(id % 28) AS run", "timestampadd(HOUR, 6 * int(id % 28), TIMESTAMP_NTZ'2026-06-29 00:00:00') AS init_ts",
        "int(id % 7) AS lead_h", "int(id % 20) AS yi", "int(id div 20 % 10) AS xi",
        *[f"double(id) AS {v}" for v in S.CUBE_VARIABLES], "int(id % 20) AS yb", "int(id div 20 % 10) AS xb",
    )
    assert readings.select("yb", "xb").distinct().count() > S.MOST_BLOCK_FOLDERS
    archive.write_cube(readings, f"{base}/in")
    for _ in range(2):
        streams.stream_land(streams.read_files(spark, f"{base}/in", S.CUBE), f"{base}/out", f"{base}/checkpoint")
    landed = spark.read.parquet(f"{base}/out")
    assert len(landed.inputFiles()) <= 4 * (7 + 8)  # the four runs of a day, from a file a day and a few cut in two
    assert landed.select(readings.columns).exceptAll(readings).isEmpty() and landed.count() == 6000
