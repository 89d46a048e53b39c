"""Windows from days already folded, quantiles from day counts, and packed frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hexheat.operators import film, fold, windowing
from hexheat.plans import catalogue as C
from hexheat.sources import derived as D, partials, sinks

COLUMNS = ["init_ts", "lead_h", "cell", "tc", "rh", "mm", "ws"]


def rows(df):
    return sorted(tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in df.select(*COLUMNS).collect())


def fresh(spark, sf, first, last, leads=6):
    return rows(fold.fold(windowing.stitch(D.pixel_hours(spark, sf), first, last, leads), C.pixels(spark, sf)))


def test_any_window_equals_a_fresh_fold(spark, sf, tmp_path):
    cube, lookup, path = D.pixel_hours(spark, sf), C.pixels(spark, sf), f"{tmp_path}/p"
    for first, last, leads in (("2026-06-30", "2026-07-01", 6), ("2026-07-03", "2026-07-03", 6), ("2026-06-29", "2026-07-04", 7), ("2026-07-01", "2026-07-01", 3)):
        got = rows(partials.fold_from_partials(cube, lookup, path, first, last, leads))
        assert got and got == fresh(spark, sf, first, last, leads)
    assert len(partials.held_days(spark, path)) == 6


def test_held_days_are_not_read_again(spark, sf, tmp_path):
    """The cube has lost the days that are held, and days without runs are held too."""
    cube, lookup, path = D.pixel_hours(spark, sf), C.pixels(spark, sf), f"{tmp_path}/p"
    partials.fold_from_partials(cube, lookup, path, "2026-06-27", "2026-07-01")
    rest = cube.where(F.col("init_day") > F.lit("2026-07-01").cast("date"))
    got = partials.fold_from_partials(rest, lookup, path, "2026-06-27", "2026-07-05")
    assert rows(got) == fresh(spark, sf, "2026-06-27", "2026-07-05")
    nothing = cube.where(F.raise_error(F.lit("the cube was read")).isNotNull())
    assert rows(partials.fold_from_partials(nothing, lookup, path, "2026-06-28", "2026-07-02")) == fresh(spark, sf, "2026-06-28", "2026-07-02")


def test_notes_are_read_once_a_question(spark, sf, tmp_path, monkeypatch):
    cube, lookup, path, asked = D.pixel_hours(spark, sf), C.pixels(spark, sf), f"{tmp_path}/p", []
    partials.fold_from_partials(cube, lookup, path, "2026-06-29", "2026-06-30")
    held = partials.held_days
    monkeypatch.setattr(partials, "held_days", lambda *at: asked.append(at) or held(*at))
    partials.fold_from_partials(cube, lookup, path, "2026-06-29", "2026-07-05")
    assert len(asked) == 1


def test_a_day_that_was_cut_off_is_folded_again(spark, sf, tmp_path):
    cube, lookup, path = D.pixel_hours(spark, sf), C.pixels(spark, sf), f"{tmp_path}/p"
    half = partials.partial_means(windowing.stitch(cube, "2026-06-30", "2026-06-30", 3), lookup)
    half.write.partitionBy("init_day").parquet(path)  # data without a note
    assert rows(partials.fold_from_partials(cube, lookup, path, "2026-06-30", "2026-06-30")) == fresh(spark, sf, "2026-06-30", "2026-06-30")


def test_ramp_of_days_is_near_the_exact_one(spark, sf, tmp_path):
    heat, path = C.heat(spark, sf), f"{tmp_path}/counts"
    partials.write_day_counts(heat, path)
    for first, last in (("2026-06-29", "2026-07-05"), ("2026-07-02", "2026-07-03")):
        day = F.to_date("t")
        cut = heat.where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        exact = {r.share: r.quantile for r in film.exact_quantiles(cut, "hi", [0.02, 0.5, 0.98]).collect()}
        got = {r.share: r.quantile for r in partials.quantiles_of_days(spark, path, first, last, [0.02, 0.5, 0.98]).collect()}
        values = sorted(r.hi for r in cut.select("hi").collect())
        for share, q in got.items():
            k = int(share * (len(values) - 1))
            assert abs(q - values[k]) <= 1 / 128 + 1e-9 and values[k] - 1 / 64 <= exact[share] <= values[min(k + 1, len(values) - 1)] + 1e-6
    ramp = partials.ramp_of_days(spark, path, "2026-07-02", "2026-07-03").first()
    assert ramp.mid == pytest.approx(got[0.5]) and ramp.hi - ramp.mid == pytest.approx(ramp.mid - ramp.lo)


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_packed_frames_are_the_dense_film(spark, width):
    n = 23
    dense = spark.createDataFrame([(f, p, (f * 31 + p * 7) % 256, p % 256) for f in range(4) for p in range(n)], "frame int, pos int, hi_q int, wx_q int")
    got = {r.frame: r for r in sinks.packed_frames(dense.repartition(5), width=width).collect()}
    for f in range(4):
        assert got[f].n_cells == n and bytes(got[f].hi_q) == bytes((f * 31 + p * 7) % 256 for p in range(n)) and bytes(got[f].wx_q) == bytes(range(n))
