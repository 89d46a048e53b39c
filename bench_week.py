"""One full-size week, to set beside the published fold: 28 runs x 6 leads over a 3 km grid.

The readings are the line items again and again, laid on a 1060 x 1800 grid by arithmetic
until (run, lead, pixel) is covered. Prints one JSON line.

    python bench_week.py [share of the grid rows, default 0.25]
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import SparkSession, functions as F

from hexheat import schemas as S
from hexheat.operators import accumulate, film, fold, windowing
from hexheat.session import build_session, drop_work, work_dir
from hexheat.sources import derived

ROWS, COLS, RES = 1060, 1800, 6


def measure(spark: SparkSession, sf: str, share: float) -> dict:
    """Builds a share of a full-size week from the line items, and times the fold and the recurrence on it."""
    base = work_dir(spark, "week")
    ny = int(ROWS * share)
    grid = spark.range(ny * COLS).selectExpr(
        f"int(id div {COLS}) AS yi", f"int(id % {COLS}) AS xi",
        f"24.4D + 25.1D * (id div {COLS}) / {ROWS} AS lat", f"-124.8D + 57.9D * (id % {COLS}) / {COLS} AS lon",
    )
    readings = derived.table(spark, sf, "lineitem").selectExpr(
        "row_number() OVER (PARTITION BY l_orderkey % 256 ORDER BY l_orderkey, l_linenumber, l_partkey) AS n",
        "int(l_orderkey % 256) AS g", "float(10D + 0.6D * l_quantity) AS tc", "float(10D + 900D * l_discount) AS rh",
        "float(greatest(l_tax - 0.04D, 0D) / 40D) AS rain", "float(l_suppkey % 17 - 8) AS u", "float(l_orderkey % 13 - 6) AS v",
    ).where("n <= 2048")
    # every (hour, pixel) takes the values of one line item
    places = spark.range(0, 168 * ny * COLS, numPartitions=64).selectExpr(
        f"int(id div {ny * COLS}) AS h", f"int(id % {ny * COLS} div {COLS}) AS yi", f"int(id % {COLS}) AS xi",
        "int(pmod(id * 48271, 256)) AS g", "int(pmod(id * 69621 div 256, 2048)) + 1 AS n",
    )
    cube = places.join(F.broadcast(readings), ["g", "n"]).selectExpr(
        f"timestampadd(HOUR, h - h % 6, TIMESTAMP_NTZ'{derived.FIRST_INIT}') AS init_ts", "h % 6 AS lead_h",
        "yi", "xi", "tc", "rh", "rain", "u", "v",
    )
    start = time.perf_counter()
    cube.write.mode("overwrite").parquet(f"{base}/cube")
    written = time.perf_counter() - start
    stored = spark.read.parquet(f"{base}/cube")
    lookup = fold.label_pixels(grid, RES)

    times = {}

    def timed(name: str, df, path: str | None = None) -> None:
        start = time.perf_counter()
        if path:
            df.write.mode("overwrite").parquet(path)
        else:
            df.write.mode("overwrite").format("noop").save()
        times[name] = round(time.perf_counter() - start, 2)

    two = fold.fold(windowing.stitch(stored, *S.DEFAULT_WINDOW), lookup, rain=False, wind=False)
    four = fold.fold(windowing.stitch(stored, *S.DEFAULT_WINDOW), lookup)
    timed("fold_two_fields", two)
    timed("fold_four_fields", four)
    timed("film_stored", film.heat_film(fold.cell_hours(four)), f"{base}/film")
    heat = spark.read.parquet(f"{base}/film")
    timed("sustained_heat", accumulate.sustained_heat(heat))
    timed("sweep_16", accumulate.sweep(heat, derived.parameters()[:16]))
    timed("frame_means", film.frame_means(heat))
    timed("index_ramp", film.index_ramp(heat))
    answers = heat.count()
    return {
        "pixel_hours": 168 * ny * COLS, "answers": answers, "cube_written_s": round(written, 1), "seconds": times,
        "answers_per_s": round(answers / times["fold_four_fields"]),
    }


def main() -> None:
    share = float(sys.argv[1]) if len(sys.argv) > 1 else 0.25
    spark = build_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "32", "spark.driver.memory": "20g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    measured = measure(spark, "/root/testdata/sf0.1", share)
    drop_work(spark)
    spark.stop()
    print(json.dumps(measured))


if __name__ == "__main__":
    main()
