"""Heat index, codes, and the recurrence: closed forms, properties, traps."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexheat import functions as H
from hexheat.operators import accumulate, film, fold, windowing

START = datetime(2026, 6, 29)


def one(df):
    return df.collect()[0][0]


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def make_film(spark, cells):
    """`cells` maps id -> list of (hour, heat index, wind, rain)."""
    rows = [
        (c, START + timedelta(hours=h), hi, ws, mm) for c, hours in cells.items() for h, hi, ws, mm in hours
    ]
    raw = spark.createDataFrame(rows, "cell bigint, t timestamp_ntz, hi double, ws double, mm double")
    return raw.select(
        "cell", "t", H.quantise_hi(F.col("hi")).alias("hi_q"), H.pack_wx(F.col("ws"), F.col("mm")).alias("wx_q")
    )


def loop(hours, half_life=12.0, threshold=27.0, flush=0.5, vent=0.3):
    """The recurrence as plain Python over decoded codes."""
    a, level, out = 2 ** (-1 / half_life), 0.0, {}
    for h, hi, ws, mm in sorted(hours):
        if hi is None:
            continue
        hi = np.clip(np.rint((hi + 40) * 2), 0, 254) / 2 - 40
        ws, mm = min(np.rint(ws), 15), min(np.rint(mm * 2), 15) / 2
        e = max(0, hi - threshold) * max(0, 1 - vent * ws / 10)
        level = (a * level + (1 - a) * e) * (1 - flush * min(1, mm / 2.5))
        out[START + timedelta(hours=h)] = level
    return out


@pytest.mark.parametrize("fahrenheit, humidity, expected", [
    (80, 40, 80), (90, 60, 100), (100, 50, 118), (86, 90, 105), (96, 65, 121), (110, 40, 136),
])
def test_heat_index_matches_the_published_chart(spark, fahrenheit, humidity, expected):
    hi = H.c_to_f(H.heat_index_c(F.lit((fahrenheit - 32) * 5 / 9), F.lit(float(humidity))))
    assert abs(one(spark.range(1).select(hi)) - expected) < 1.1


def test_heat_index_adjustments_and_mild_branch(spark):
    def hi_f(t, rh):
        return one(spark.range(1).select(H.c_to_f(H.heat_index_c(H.f_to_c(F.lit(float(t))), F.lit(float(rh))))))

    assert abs(hi_f(60, 50) - 0.5 * (60 + 61 + (60 - 68) * 1.2 + 50 * 0.094)) < 1e-9
    # both adjustments vanish at their edges
    assert abs(hi_f(112, 12.9999999) - hi_f(112, 13)) < 1e-5
    assert abs(hi_f(87, 85.0000001) - hi_f(87, 85)) < 1e-5
    assert hi_f(100, 5) < hi_f(100, 13)


def test_heat_index_of_missing_input_is_null(spark):
    nan = float("nan")
    df = spark.createDataFrame([(30.0, nan), (nan, 50.0), (None, 50.0), (30.0, None), (float("inf"), 5.0)], "t double, r double")
    assert [r[0] for r in df.select(H.heat_index_c(F.col("t"), F.col("r"))).collect()] == [None] * 5


def test_missing_filter_drops_nan_although_nan_equals_itself(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "tc double")
    assert df.where("tc = tc").count() == 2
    assert fold.drop_missing(df).count() == 1


def test_codes_round_half_to_even_and_saturate(spark):
    got = column(spark, [-40.0, -39.75, -39.25, 87.0, 500.0, -90.0]).select(H.quantise_hi(F.col("x"))).collect()
    assert [r[0] for r in got] == [0, 0, 2, 254, 254, 0]
    load = column(spark, [0.05, 0.04, 25.4, 99.0, 0.15]).select(H.quantise_load(F.col("x"))).collect()
    assert [r[0] for r in load] == [1, 0, 254, 254, 2]


def test_code_error_is_at_most_a_quarter_degree(spark):
    rng = np.random.default_rng(7)
    df = column(spark, [float(v) for v in rng.uniform(-40, 87, 2000)])
    worst = df.select(F.max(F.abs(H.dequantise_hi(H.quantise_hi(F.col("x"))) - F.col("x"))))
    assert one(worst) <= 0.25 + 1e-5


def test_weather_byte_is_its_own_inverse(spark):
    df = spark.range(256).select(
        F.floor(F.col("id") / 16).cast("double").alias("w"), (F.col("id") % 16 / 2.0).alias("m")
    ).withColumn("b", H.pack_wx(F.col("w"), F.col("m")))
    assert df.where((H.unpack_wind(F.col("b")) != F.col("w")) | (H.unpack_rain(F.col("b")) != F.col("m"))).count() == 0
    assert df.select("b").distinct().count() == 256


def test_weather_byte_of_missing_is_zero_and_saturates(spark):
    df = spark.createDataFrame([(float("nan"), None), (99.0, 99.0)], "w double, m double")
    assert [r[0] for r in df.select(H.pack_wx(F.col("w"), F.col("m"))).collect()] == [0, 255]


def test_wind_is_the_mean_of_speeds(spark):
    rows = [(START, 0, 0, x, 30.0, 50.0, 0.0, u, 0.0) for x, u in ((0, 5.0), (1, -5.0))]
    cube = spark.createDataFrame(
        rows, "init_ts timestamp_ntz, lead_h int, yi int, xi int, tc double, rh double, rain double, u double, v double"
    )
    pix = spark.createDataFrame([(0, 0, 1), (0, 1, 1)], "yi int, xi int, cell bigint")
    assert fold.fold(cube, pix).collect()[0]["ws"] == 5.0


def test_nan_humidity_means_no_data_and_nan_rain_means_none(spark):
    nan = float("nan")
    cube = spark.createDataFrame(
        [(START, 0, 0, 0, 30.0, nan, 0.0, 1.0, 0.0), (START, 1, 0, 0, 30.0, 50.0, nan, nan, 0.0)],
        "init_ts timestamp_ntz, lead_h int, yi int, xi int, tc double, rh double, rain double, u double, v double",
    )
    pix = spark.createDataFrame([(0, 0, 1)], "yi int, xi int, cell bigint")
    hours = fold.cell_hours(fold.fold(cube, pix))
    assert hours.count() == 2
    (row,) = film.heat_film(hours).collect()
    assert (row.t.hour, row.wx_q) == (1, 0)


def test_optional_fields(spark, sf):
    from hexheat.plans import catalogue

    hours = catalogue.fold_two_fields(spark, sf)
    assert hours.columns == ["cell", "t", "tc", "rh"]
    assert film.heat_film(hours).where("wx_q <> 0").count() == 0


SERIES = {
    1: [(h, 30.0 + (h * 7) % 13, float(h % 9), 3.0 if h % 5 == 0 else 0.0) for h in range(200)],
    2: [(h, None if h % 4 == 0 else 41.0, 0.0, 0.0) for h in range(60)],
    3: [(0, 50.0, 0.0, 0.0)],
    4: [(h, 10.0, 0.0, 0.0) for h in range(30)],
}
SETS = [{}, {"half_life": 1.0, "flush": 1.0}, {"half_life": 72.0, "threshold": 15.0, "vent": 1.0}]


@pytest.mark.parametrize("solve", [accumulate.sweep, accumulate.sweep_by_blocks])
def test_recurrence_equals_a_plain_loop(spark, solve):
    got = {(r.param, r.cell, r.t): r.l for r in solve(make_film(spark, SERIES), SETS).collect()}
    want = {(p, c, t): v for p, s in enumerate(SETS) for c, hours in SERIES.items() for t, v in loop(hours, **s).items()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_state_crosses_arrow_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_recurrence_equals_a_plain_loop(spark, accumulate.sweep)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_block_length_does_not_matter(spark):
    f = make_film(spark, SERIES)
    a = accumulate.sweep_by_blocks(f, [{}], block_hours=5)
    b = accumulate.sweep_by_blocks(f, [{}], block_hours=500)
    assert a.join(b, ["cell", "t"]).where(F.abs(a.l - b.l) > 1e-12).count() == 0


def test_constant_excess_has_the_closed_form(spark):
    hours = [(h, 37.0, 0.0, 0.0) for h in range(100)]
    rows = accumulate.sustained_heat(make_film(spark, {9: hours})).orderBy("t").collect()
    a = 2 ** (-1 / 12)
    assert max(abs(r.l - 10 * (1 - a ** (i + 1))) for i, r in enumerate(rows)) < 1e-12


def test_load_halves_in_a_half_life(spark):
    hours = [(h, 37.0 if h < 50 else 0.0, 0.0, 0.0) for h in range(80)]
    rows = [r.l for r in accumulate.sustained_heat(make_film(spark, {9: hours})).orderBy("t").collect()]
    assert abs(rows[61] / rows[49] - 0.5) < 1e-12


def test_missing_hours_freeze_the_state(spark):
    gap = [(0, 40.0, 0.0, 0.0), (1, None, 9.0, 9.0), (50, 20.0, 0.0, 0.0)]
    near = [(0, 40.0, 0.0, 0.0), (1, 20.0, 0.0, 0.0)]
    rows = accumulate.sustained_heat(make_film(spark, {1: gap, 2: near})).orderBy("cell", "t").collect()
    assert [r.cell for r in rows] == [1, 1, 2, 2]
    assert rows[1].l == rows[3].l


def test_full_flush_empties_the_load(spark):
    hours = [(0, 45.0, 0.0, 0.0), (1, 45.0, 0.0, 2.5), (2, 45.0, 0.0, 0.0)]
    rows = accumulate.sustained_heat(make_film(spark, {1: hours}), flush=1.0).orderBy("t").collect()
    assert rows[1].l == 0.0 and rows[2].l == pytest.approx(rows[0].l)


def test_ramp_top_of_an_empty_load_is_one_degree(spark):
    f = make_film(spark, {4: SERIES[4]})
    assert one(accumulate.load_ramp_top(accumulate.sustained_heat(f))) == 1.0


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(30, 15, 997), np.array([5.0]), np.repeat(12.5, 40), np.arange(4.0)):
        df = column(spark, [float(v) for v in values])
        got = {r.share: r.quantile for r in film.exact_quantiles(df, "x", [0.02, 0.5, 0.98]).collect()}
        for share in (0.02, 0.5, 0.98):
            assert got[share] == pytest.approx(np.percentile(values, share * 100), abs=1e-9)


def test_newest_run_wins_is_decided_by_init(spark):
    rows = [(START, 6, 1, 10.0), (START + timedelta(hours=6), 0, 1, 20.0), (START, 2, 1, 30.0)]
    df = spark.createDataFrame(rows, "init_ts timestamp_ntz, lead_h int, cell bigint, tc double")
    got = {r.t.hour: r.tc for r in windowing.newest_run(df, ["tc"]).collect()}
    assert got == {6: 20.0, 2: 30.0}


def test_value_labels(spark):
    df = column(spark, [1.25, -0.5, None, float("nan")])
    assert [r[0] for r in df.select(H.value_label(F.col("x"))).collect()] == ["1.3°C", "-0.5°C", "no data", "no data"]


def test_line_segments_split_at_gaps(spark):
    rows = [(1, START + timedelta(hours=h), v) for h, v in enumerate([1, 2, None, None, 3, None, 4])]
    df = spark.createDataFrame(rows, "cell bigint, t timestamp_ntz, v int")
    got = film.line_segments(df, "v").groupBy("segment").count().orderBy("segment").collect()
    assert [r["count"] for r in got] == [2, 1, 1]


def test_extent_is_at_least_a_degree(spark):
    df = column(spark, [3.0, 3.4])
    assert tuple(film.extent(df, "x").collect()[0]) == (2.5, pytest.approx(3.9))
    assert tuple(film.extent(df, "x", from_zero=True).collect()[0]) == (0.0, 3.4)
    assert film.extent(df.where("x > 9"), "x").count() == 0


def test_fine_resolutions_are_refused():
    fold.guard_resolution(6)
    with pytest.raises(ValueError):
        fold.guard_resolution(7)
    with pytest.raises(ValueError):
        fold.guard_resolution(5, pixel_area_km2=300.0)
