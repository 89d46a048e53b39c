"""Times the headline queries on the test tables and prints one JSON line.

`BENCH_SF_DIR` and `BENCH_CPUS` choose tables and cores. Each query runs once to warm up and is
then timed once, end to end: building the plan, planning, and computing every row and column.
`rows` has how many rows each gave, and `week` the fold and the recurrence on a share of a
full-size week (BENCH_WEEK_SHARE of its grid rows; see bench_week.py).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import bench_week  # noqa: E402
from hexheat.plans.catalogue import QUERIES  # noqa: E402
from hexheat.session import build_session, drop_work  # noqa: E402

HEADLINE = (
    "fold_cell_hour", "fold_by_sql", "heat_index_film", "sustained_heat", "frame_means", "index_ramp",
    "load_ramp_top", "param_sweep", "film_pair", "densified_film", "newest_run_wins", "polyfill_center",
    "polyfill_cells", "cell_county", "resolve_window", "pick_points", "covering_run", "delta_decode",
    "films_of_requests", "prune_blocks", "cell_series",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.mode("overwrite").format("noop").save()
        return time.perf_counter() - start

    seconds, rows = {}, {}
    for name in HEADLINE:
        rows[name] = QUERIES[name](spark, sf).count()
        run(name)
        seconds[name] = round(run(name), 3)
    week = bench_week.measure(spark, sf, float(os.environ.get("BENCH_WEEK_SHARE", "0.05")))
    drop_work(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows": rows, "week": week, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
