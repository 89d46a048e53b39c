"""ANSI SQL with the same answers as the catalogue, for another engine on the same tables.

Written from the definitions and not from the Spark plans: polygon tests compare every point
with every edge, recurrences step row by row, runs are searched by a plain range condition.
"""

from __future__ import annotations

import math

from hexheat import schemas as S
from hexheat.functions.cells import AXIS_BITS, AXIS_MASK, COS0, EARTH_KM, HALF_AXIS, ROOT3, edge_km
from hexheat.functions.tiles import MERCATOR_LAT
from hexheat.sources import derived as D

CHECKS: dict[str, str] = {}
FILL_RES = 5


def d(value: float) -> str:
    """A DOUBLE literal; plain decimals would be read as DECIMAL."""
    return f"({value!r}e0)" if "e" not in repr(float(value)) else f"({float(value)!r})"


def r6(sql: str, name: str | None = None) -> str:
    return f"floor(({sql})::DOUBLE * 1e6 + 4142e-4) / 1e6 AS {name or sql}"


# ---- common table expressions, each with the ones it needs --------------------------------

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def check(name: str, needs: list[str], body: str) -> None:
    order: list[str] = []

    def visit(n: str) -> None:
        for need in CTES[n][0]:
            visit(need)
        if n not in order:
            order.append(n)

    for need in needs:
        visit(need)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    CHECKS[name] = f"WITH RECURSIVE {head}\n{body}" if head else body


def pixel_columns(key: str) -> str:
    at = f"(({key} * {D.SPREAD}) % (2 * cols * cols))"
    return (f"({at} // cols)::INT AS yi, ({at} % cols)::INT AS xi, "
            f"({at} // cols // greatest(1, least({D.BLOCK_ROWS}, cols // 5)))::INT AS yb, "
            f"({at} % cols // greatest(1, least({D.BLOCK_COLS}, cols // 10)))::INT AS xb")


START = f"TIMESTAMP '{D.FIRST_INIT}'"
cte("shape", [], f"""
    SELECT greatest(4, floor(sqrt((SELECT count(*) // 2 FROM part))))::BIGINT AS cols,
           {D.RUNS_A_WEEK} * greatest(1, (SELECT count(*) // {D.ORDERS_A_WEEK} FROM orders)) AS runs""")
cte("pixel_hours", ["shape"], f"""
    SELECT (l_orderkey % runs)::INT AS run, {START} + to_hours((l_orderkey % runs)::INT * 6) AS init_ts,
           (l_linenumber - 1)::INT AS lead_h, {pixel_columns("l_partkey")},
           CASE WHEN l_orderkey % 97 = 0 THEN 'NaN'::DOUBLE ELSE 10e0 + 6e-1 * l_quantity END AS tc,
           CASE WHEN l_orderkey % 89 = 0 THEN 'NaN'::DOUBLE ELSE 10e0 + 900e0 * l_discount END AS rh, greatest(l_tax - 4e-2, 0e0) / 40e0 AS rain,
           (l_suppkey % 17 - 8)::DOUBLE AS u, (l_orderkey % 13 - 6)::DOUBLE AS v
    FROM lineitem CROSS JOIN shape""")
cte("runs", ["pixel_hours"], "SELECT DISTINCT run, init_ts FROM pixel_hours")
cte("archive", ["runs"], "SELECT min(init_ts)::DATE AS lo, max(init_ts)::DATE AS hi FROM runs")
cte("grid", ["shape"], f"""
    SELECT yi, xi, yb, xb, {d(D.SOUTH)} + {d(D.HEIGHT)} * yi / (2 * cols) AS lat, {d(D.WEST_END)} + {d(D.WIDTH)} * xi / cols AS lon
    FROM (SELECT DISTINCT cols, {pixel_columns("p_partkey")} FROM part CROSS JOIN shape)""")


def hexed(source: str, res: int, keep: str, lat: str = "lat", lon: str = "lon") -> str:
    """Rows of `source` with their cell."""
    s = edge_km(res)
    return f"""
    SELECT {keep}, ((CASE WHEN dq > dr AND dq > dt THEN -rr - rt ELSE rq END)::BIGINT + {HALF_AXIS}) * {1 << AXIS_BITS}
           + (CASE WHEN NOT (dq > dr AND dq > dt) AND dr > dt THEN -rq - rt ELSE rr END)::BIGINT + {HALF_AXIS} AS cell
    FROM (SELECT *, abs(rq - q_) AS dq, abs(rr - r_) AS dr, abs(rt - t_) AS dt
          FROM (SELECT *, round_even(q_, 0) AS rq, round_even(r_, 0) AS rr, round_even(t_, 0) AS rt
                FROM (SELECT *, -q_ - r_ AS t_
                      FROM (SELECT *, (x_ * {d(ROOT3 / 3)} - y_ / 3e0) / {d(s)} AS q_, y_ * {d(2 / 3)} / {d(s)} AS r_
                            FROM (SELECT *, radians({lon}) * {d(EARTH_KM * COS0)} AS x_,
                                         sin(radians({lat})) * {d(EARTH_KM / COS0)} AS y_ FROM {source})))))"""


cte("pix", ["grid"], hexed("grid", D.RES, "yi, xi, yb, xb, lat, lon"))
cte("cells", ["pix"], "SELECT cell, (row_number() OVER (ORDER BY cell) - 1)::INT AS pos FROM (SELECT DISTINCT cell FROM pix)")


# The default window; all else folds the archive from end to end.
WEEK = "AND init_ts >= TIMESTAMP '2026-06-29' AND init_ts < TIMESTAMP '2026-07-06'"


def fold(leads: int, pixels: str = "pix", window: str = "") -> str:
    return f"""
    SELECT init_ts, lead_h, cell, init_ts + to_hours(lead_h) AS t, avg(tc)::FLOAT AS tc, nullif(avg(rh), 'NaN'::DOUBLE)::FLOAT AS rh,
           (avg(rain) * 3600)::FLOAT AS mm, avg(sqrt(u * u + v * v))::FLOAT AS ws
    FROM pixel_hours JOIN {pixels} USING (yi, xi)
    WHERE NOT isnan(tc) AND lead_h < {leads} {window} GROUP BY init_ts, lead_h, cell"""


cte("cell_hour", ["pixel_hours", "pix"], fold(6))
cte("cell_hour7", ["pixel_hours", "pix"], fold(7))


def film_of(source: str) -> str:
    """The published heat index, in its published order of terms."""
    return f"""
    SELECT *, least(greatest(round_even(((hi + 40::FLOAT) * 2::FLOAT)::DOUBLE, 0), 0), 254)::SMALLINT AS hi_q,
           ((least(round_even(ws::DOUBLE, 0), 15)::INT << 4) | least(round_even(mm::DOUBLE * 2, 0), 15)::INT)::SMALLINT AS wx_q
    FROM (SELECT cell, t, tc, rh, mm, ws,
                 ((CASE WHEN (s + f) / 2 < 80 THEN s
                        WHEN r < 13 AND f BETWEEN 80 AND 112 THEN h - (13 - r) / 4 * sqrt((17 - abs(f - 95)) / 17)
                        WHEN r > 85 AND f BETWEEN 80 AND 87 THEN h + (r - 85) / 10 * ((87 - f) / 5)
                        ELSE h END - 32) * 5 / 9)::FLOAT AS hi
          FROM (SELECT *, 5e-1 * (f + 61 + (f - 68) * 12e-1 + r * 94e-3) AS s,
                       -42.379e0 + 2.04901523e0 * f + 10.14333127e0 * r - 0.22475541e0 * f * r - 0.00683783e0 * f * f
                       - 0.05481717e0 * r * r + 0.00122874e0 * f * f * r + 0.00085282e0 * f * r * r
                       - 0.00000199e0 * f * f * r * r AS h
                FROM (SELECT *, tc::DOUBLE * 9 / 5 + 32 AS f, rh::DOUBLE AS r FROM {source} WHERE rh IS NOT NULL)))"""


cte("film", ["cell_hour"], film_of("cell_hour"))
cte("week_hour", ["pixel_hours", "pix"], fold(6, window=WEEK))
cte("week_film", ["week_hour"], film_of("week_hour"))


def steps_of(hi: str, ws: str, mm: str, source: str = "film") -> str:
    return f"""
    SELECT cell, t, {hi} AS hi, {ws} AS ws, {mm} AS mm, row_number() OVER (PARTITION BY cell ORDER BY t) AS n
    FROM {source} WHERE hi IS NOT NULL"""


def walk_of(steps: str, params: str) -> str:
    """The recurrence, a row at a time; `params` has one row per parameter set."""
    def step(before: str) -> str:
        return (f"(a * {before} + (1 - a) * greatest(s.hi - threshold, 0e0) * greatest(1 - vent * s.ws / 10, 0e0))"
                " * (1 - flush * least(s.mm / 25e-1, 1e0))")

    return f"""
    SELECT param, s.cell, s.t, s.n, {step("0e0")} AS l
    FROM {steps} s CROSS JOIN {params} WHERE s.n = 1
    UNION ALL
    SELECT w.param, s.cell, s.t, s.n, {step("w.l")} AS l
    FROM {{name}} w JOIN {steps} s ON s.cell = w.cell AND s.n = w.n + 1 JOIN {params} p ON p.param = w.param"""


def param_rows(rows: list[dict]) -> str:
    values = ", ".join(
        f"({i}, {d(r['half_life'])}, {d(r['threshold'])}, {d(r['flush'])}, {d(r['vent'])})" for i, r in enumerate(rows)
    )
    return (f"SELECT param, pow(2e0, -1 / h) AS a, threshold, flush, vent "
            f"FROM (VALUES {values}) AS v(param, h, threshold, flush, vent)")


DEFAULT = [{"half_life": S.HALF_LIFE_H, "threshold": S.THRESHOLD_C, "flush": S.RAIN_FLUSH, "vent": S.WIND_VENT}]
LOAD_Q = "least(floor(l * 10 + 5e-1), 254)::SMALLINT AS load_q"
cte("one", [], param_rows(DEFAULT))
cte("many", [], param_rows(D.parameters()))
cte("steps", ["film"], steps_of("hi_q / 2e0 - 40", "(wx_q >> 4)::DOUBLE", "(wx_q & 15) / 2e0"))
cte("raw_steps", ["film"], steps_of("hi::DOUBLE", "ws::DOUBLE", "mm::DOUBLE"))
cte("walk", ["steps", "one"], walk_of("steps", "one").replace("{name}", "walk"))
cte("raw_walk", ["raw_steps", "one"], walk_of("raw_steps", "one").replace("{name}", "raw_walk"))
cte("sweep", ["steps", "many"], walk_of("steps", "many").replace("{name}", "sweep"))
cte("load", ["walk"], f"SELECT cell, t, l, {LOAD_Q} FROM walk")
cte("frames", ["film"], "SELECT t, (row_number() OVER (ORDER BY t) - 1)::INT AS frame FROM (SELECT DISTINCT t FROM film)")
cte("dense", ["film", "cells", "frames"],
    "SELECT c.cell, f.t, film.hi_q FROM cells c CROSS JOIN frames f LEFT JOIN film ON film.cell = c.cell AND film.t = f.t")

# ---- fold and film ------------------------------------------------------------------------

HOURS = f"SELECT cell, t, {r6('tc')}, {r6('rh')}, {r6('mm')}, {r6('ws')} FROM cell_hour"
check("fold_cell_hour", ["cell_hour"], HOURS)
check("fold_by_sql", ["cell_hour"], HOURS)
check("fold_two_fields", ["cell_hour"], f"SELECT cell, t, {r6('tc')}, {r6('rh')} FROM cell_hour")
check("heat_index_film", ["film"], f"SELECT cell, t, {r6('hi')} FROM film")
check("quantised_film", ["film"], "SELECT cell, t, hi_q FROM film")
check("packed_weather", ["film"], "SELECT cell, t, wx_q, (wx_q >> 4)::DOUBLE AS ws, (wx_q & 15) / 2e0 AS mm FROM film")
check("sustained_heat", ["load"], f"SELECT cell, t, {r6('l')}, load_q FROM load")
check("sustained_heat_by_blocks", ["load"], f"SELECT cell, t, {r6('l')}, load_q FROM load")
check("sustained_heat_raw", ["raw_walk"], f"SELECT cell, t, {r6('l')}, {LOAD_Q} FROM raw_walk")
check("frame_means", ["film", "load"], f"""
    SELECT t, {r6('avg(hi_q / 2e0 - 40)', 'mean_hi')}, count(*) AS n_cells, {r6('avg(l)', 'mean_load')}
    FROM film JOIN load USING (cell, t) GROUP BY t""")
check("load_histogram", ["load"], "SELECT load_q, count(*) AS n FROM load GROUP BY load_q")
check("load_ramp_top", ["load"], """
    SELECT greatest(1e0, coalesce(percentile_disc(98e-2) WITHIN GROUP (ORDER BY load_q) / 10e0, 1e0)) AS top
    FROM load WHERE load_q BETWEEN 1 AND 254""")
RAMP = "max(m) AS mid, max(greatest(m - p2, p98 - m)) AS w"
for _name, _film in (("quantiles", "film"), ("week_quantiles", "week_film")):
    cte(_name, [_film], f"""
    SELECT quantile_cont(hi::DOUBLE, 5e-1) AS p50, quantile_cont(hi::DOUBLE, 2e-2) AS p2, quantile_cont(hi::DOUBLE, 98e-2) AS p98
    FROM {_film}""")


def ramp(mid: str, quantiles: str = "quantiles") -> str:
    return (f"SELECT {r6('m - w', 'lo')}, {r6('m', 'mid')}, {r6('m + w', 'hi')} "
            f"FROM (SELECT m, greatest(m - p2, p98 - m) AS w FROM (SELECT *, {mid} AS m FROM {quantiles}))")


check("index_ramp", ["quantiles"], ramp("p50"))
check("index_ramp_pinned", ["quantiles"], ramp("27e0"))
check("film_extent", ["film"], f"""
    SELECT {r6('CASE WHEN b - a < 1 THEN a - 5e-1 ELSE a END', 'lo')}, {r6('CASE WHEN b - a < 1 THEN b + 5e-1 ELSE b END', 'hi')}
    FROM (SELECT min(hi)::DOUBLE AS a, max(hi)::DOUBLE AS b FROM film)""")
check("cell_extents", ["load"], """
    SELECT cell, 0e0 AS lo, CASE WHEN b < 1 THEN b + 5e-1 ELSE b END AS hi
    FROM (SELECT cell, max(load_q) / 10e0 AS b FROM load GROUP BY cell)""")
check("param_sweep", ["sweep"], f"SELECT param, t, {r6('avg(l)', 'mean_load')}, count(*) AS n_cells FROM sweep GROUP BY param, t")
check("sweep_ramp_tops", ["sweep"], f"""
    SELECT param, greatest(1e0, coalesce(percentile_disc(98e-2) WITHIN GROUP (ORDER BY load_q)
                                         FILTER (load_q BETWEEN 1 AND 254) / 10e0, 1e0)) AS top
    FROM (SELECT param, {LOAD_Q} FROM sweep) GROUP BY param""")
check("film_pair", ["film", "load"], """
    SELECT cell, t, hi_q, load_q, hi_q / 2e0 - 40 AS hi_shown, load_q / 10e0 AS load_shown FROM film JOIN load USING (cell, t)""")
check("densified_film", ["dense"], "SELECT cell, t, hi_q FROM dense")
check("indexed_film", ["film", "cells", "frames"],
      "SELECT frame, pos, hi_q, wx_q FROM film JOIN cells USING (cell) JOIN frames USING (t)")
check("line_segments", ["dense"], """
    SELECT cell, segment, min(t) AS t_first, max(t) AS t_last, count(*) AS n
    FROM (SELECT *, sum((hi_q IS NULL)::INT) OVER (PARTITION BY cell ORDER BY t)::BIGINT AS segment FROM dense)
    WHERE hi_q IS NOT NULL GROUP BY cell, segment""")
check("day_breaks", ["frames"], """
    SELECT t, frame FROM (SELECT *, lag(t::DATE) OVER (ORDER BY t) AS b FROM frames) WHERE b <> t::DATE""")
check("cell_series", ["film", "load", "cells"],
      "SELECT cell, t, hi_q, load_q FROM film JOIN load USING (cell, t) WHERE cell = (SELECT min(cell) FROM cells)")
check("frame_snapshot", ["film"], "SELECT cell, t, hi_q, wx_q FROM film WHERE t = TIMESTAMP '2026-07-01 21:00:00'")
check("write_film", ["film"], "SELECT cell, t, hi_q, wx_q FROM film WHERE t = TIMESTAMP '2026-07-01 21:00:00'")
check("write_dense_film", ["film", "cells", "frames"], """
    SELECT frame, pos, coalesce(hi_q, 255)::SMALLINT AS hi_q, coalesce(wx_q, 0)::SMALLINT AS wx_q
    FROM cells c CROSS JOIN frames f LEFT JOIN film ON film.cell = c.cell AND film.t = f.t""")
cte("clicks", ["archive"], f"""
    SELECT o_orderkey, 24.4e0 + (o_custkey * {D.SPREAD} % 2500) / 100e0 AS lat,
           -124.8e0 + (o_orderkey * 104729 % 5790) / 100e0 AS lon, lo::TIMESTAMP + to_hours((o_orderkey % (24 * (hi - lo + 1)))::INT) AS t
    FROM orders CROSS JOIN archive""")
cte("placed_clicks", ["clicks"], hexed("clicks", D.RES, "o_orderkey, t"))
check("pick_points", ["film", "placed_clicks"],
      "SELECT o_orderkey, p.cell, p.t, hi_q FROM placed_clicks p LEFT JOIN film ON film.cell = p.cell AND film.t = p.t")


def ramp_channels(prefix: str, place: str, stops: tuple[str, ...]) -> str:
    """r, g, b of a place on a ramp: the 256-step table worked out in place."""
    step = f"(floor({place} * 255 + 5e-1) / 255e0 * {len(stops) - 1})"
    left = f"least({len(stops) - 2}, floor({step}))::INT"
    out = []
    for k, name in enumerate("rgb"):
        values = "[" + ", ".join(str(bytes.fromhex(s[1:])[k]) for s in stops) + "]"
        share = f"({step} - {left})"
        out.append(f"floor({values}[{left} + 1] * (1 - {share}) + {values}[{left} + 2] * {share} + 5e-1)::INT AS {prefix}_{name}")
    return ", ".join(out)


check("ramp_rgb", ["film", "load"], f"""
    SELECT cell, t, {ramp_channels("i", "pi", S.INDEX_STOPS)}, 225 AS i_a,
           {ramp_channels("l", "pl", S.LOAD_STOPS)}, (60 + floor(175 * pl + 5e-1))::INT AS l_a
    FROM (SELECT cell, t, greatest(0e0, least(1e0, (hi_q / 2e0 - 40 - 10e0) / 66.5e0)) AS pi,
                 greatest(0e0, least(1e0, load_q / 10e0 / 3.8e0)) AS pl FROM film JOIN load USING (cell, t))""")
check("value_labels", ["film", "load"], """
    SELECT cell, t, strftime(t, '%Y-%m-%d %H:%MZ') AS hour, printf('%.1f°C', hi_q / 2e0 - 40) AS hi_label,
           printf('+%.1f°C', load_q / 10e0) AS load_label FROM film JOIN load USING (cell, t)""")
check("code_round_trip", ["film", "load"], f"""
    SELECT cell, t, hi_q AS hi_again, load_q AS load_again, {r6('hi_q / 2e0 - 40', 'hi_back')} FROM film JOIN load USING (cell, t)""")
check("stage_stats", ["film", "cell_hour"], f"""
    SELECT 'film' AS stage, count(*) AS n_rows, {r6('min(hi)', 'min_hi')}, {r6('max(hi)', 'max_hi')}, min(t) AS min_t, max(t) AS max_t FROM film
    UNION ALL SELECT 'cell_hour', count(*), {r6('min(tc)', 'a')}, {r6('max(tc)', 'b')}, min(t), max(t) FROM cell_hour""")
check("packed_frames", ["film", "cells", "frames"], """
    SELECT frame, count(*) AS n_cells, sha256(unhex(string_agg(printf('%02X', coalesce(hi_q, 255)), '' ORDER BY pos))) AS hi_sha256,
           sha256(unhex(string_agg(printf('%02X', coalesce(wx_q, 0)), '' ORDER BY pos))) AS wx_sha256
    FROM cells c CROSS JOIN frames f LEFT JOIN film ON film.cell = c.cell AND film.t = f.t GROUP BY frame""")
check("fold_from_partials", ["cell_hour"], HOURS)
cte("middles", ["film"], """
    SELECT (floor(hi::DOUBLE * 64) + 5e-1) / 64 AS middle, row_number() OVER (ORDER BY hi) - 1 AS rank, count(*) OVER () AS n FROM film""")
check("ramp_of_days", ["middles"], f"""
    SELECT {r6('p50 - w', 'lo')}, {r6('p50', 'mid')}, {r6('p50 + w', 'hi')}
    FROM (SELECT *, greatest(p50 - p2, p98 - p50) AS w FROM (
          SELECT max(middle) FILTER (rank = floor(2e-2 * (n - 1))) AS p2, max(middle) FILTER (rank = floor(5e-1 * (n - 1))) AS p50,
                 max(middle) FILTER (rank = floor(98e-2 * (n - 1))) AS p98 FROM middles))""")
check("memo_fold", ["cell_hour"], "SELECT t, count(*) AS n FROM cell_hour GROUP BY t")

# ---- window -------------------------------------------------------------------------------

cte("week_frames", ["week_film"], "SELECT t, (row_number() OVER (ORDER BY t) - 1)::INT AS frame FROM (SELECT DISTINCT t FROM week_film)")
check("film_config", ["week_quantiles", "week_frames", "archive"], f"""
    SELECT r.lo, r.mid, r.hi, 12e0 AS half_life, {D.RES} AS res, true AS has_rain, true AS has_wind,
           strftime(a.lo, '%Y-%m-%d') AS first_day, strftime(a.hi, '%Y-%m-%d') AS last_day, '2026-06-29' AS d0,
           strftime(least(a.hi, DATE '2026-07-05'), '%Y-%m-%d') AS d1, 14 AS max_days,
           round_even((6 + 30 * (least(a.hi, DATE '2026-07-05') - DATE '2026-06-29' + 1)) / 60e0, 0)::INT || ' min' AS cost,
           30e0 AS sec_per_day, 6 AS leads, frame, strftime(t, '%Y-%m-%d %H:%MZ') AS label
    FROM week_frames CROSS JOIN archive a CROSS JOIN ({ramp("p50", "week_quantiles")}) r""")
cte("requests", [], """
    SELECT req, CASE k WHEN 0 THEN '{"d0":"' || a || '","d1":"' || b || '"}' WHEN 1 THEN '{"d0":"' || b || '","d1":"' || a || '"}'
                       WHEN 2 THEN '{"d0":"' || a || '"}' WHEN 3 THEN 'not json'
                       WHEN 4 THEN '{"d0":"2019-01-01","d1":"' || b || '"}'
                       WHEN 5 THEN '{"d0":"' || a || '","d1":"' || (a + 13) || '"}'
                       WHEN 6 THEN '{"d0":"' || (a - 40) || '","d1":"' || (a + 40) || '"}' ELSE '{}' END AS body
    FROM (SELECT o_orderkey AS req, o_orderkey // 4 % 8 AS k, DATE '2026-06-20' + (o_orderkey % 25)::INT AS a,
                 DATE '2026-06-20' + (o_orderkey % 25)::INT + (o_orderkey % 7)::INT AS b FROM orders)""")


def resolved(start: str, stop: str) -> str:
    return f"""
    SELECT req, d0, d1, n_days, CASE WHEN n_days > 14 THEN 'too long' WHEN n = 0 THEN 'no runs' ELSE 'ok' END AS status,
           CASE WHEN n_days <= 14 AND n > 0 THEN n END AS n_runs,
           CASE WHEN n_days <= 14 AND n > 0 THEN d0::TIMESTAMP END AS t0,
           CASE WHEN n_days <= 14 AND n > 0 THEN least(d1 + INTERVAL 23 HOUR, newest + INTERVAL 5 HOUR) END AS t1
    FROM (SELECT req, d0, d1, (d1 - d0 + 1)::INT AS n_days, count(init_ts) AS n, max(init_ts) AS newest
          FROM (SELECT req, least(a, b) AS d0, greatest(a, b) AS d1
                FROM (SELECT req, coalesce(greatest(lo, least(hi, r0)), {start}) AS a, coalesce(greatest(lo, least(hi, r1)), {stop}) AS b, lo, hi
                      FROM (SELECT req, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x::DATE END AS r0,
                                   CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y::DATE END AS r1
                            FROM (SELECT req, nullif(regexp_extract(body, '"d0":"([^"]*)"', 1), '') AS x,
                                         nullif(regexp_extract(body, '"d1":"([^"]*)"', 1), '') AS y FROM requests))
                      CROSS JOIN archive))
          LEFT JOIN runs ON init_ts BETWEEN d0 AND d1 + INTERVAL 23 HOUR GROUP BY req, d0, d1)"""


# least/greatest skip NULLs in this engine, so the clamp is guarded
RESOLVED = resolved("greatest(lo, least(hi, DATE '2026-06-29'))", "greatest(lo, least(hi, DATE '2026-07-05'))")
GUARD = ("coalesce(greatest(lo, least(hi, r0)),", "coalesce(CASE WHEN r0 IS NOT NULL THEN greatest(lo, least(hi, r0)) END,")
GUARD1 = ("coalesce(greatest(lo, least(hi, r1)),", "coalesce(CASE WHEN r1 IS NOT NULL THEN greatest(lo, least(hi, r1)) END,")
LAST_DAYS = resolved("hi - 4", "hi")
RESOLVED, LAST_DAYS = (q.replace(*GUARD).replace(*GUARD1) for q in (RESOLVED, LAST_DAYS))
cte("resolved", ["requests", "runs", "archive"], RESOLVED)
check("resolve_window", ["resolved"], "SELECT * FROM resolved")
check("resolve_last_days", ["requests", "runs", "archive"], LAST_DAYS)
check("films_of_requests", ["resolved", "film"], """
    SELECT req, d0, d1, n_days, status, n_rows, first_t, last_t, sum_hi_q, sum_wx_q
    FROM resolved LEFT JOIN (
        SELECT d0, d1, count(*) AS n_rows, min(t) AS first_t, max(t) AS last_t, sum(hi_q)::BIGINT AS sum_hi_q, sum(wx_q)::BIGINT AS sum_wx_q
        FROM (SELECT DISTINCT d0, d1, t1 FROM resolved WHERE status = 'ok') JOIN film ON t::DATE BETWEEN d0 AND d1 AND t <= t1
        GROUP BY d0, d1) USING (d0, d1)""")
check("read_cost", ["resolved"], """
    SELECT req, n_days, n_runs * 5 AS n_shards, 30e0 AS sec_per_day, (6 + 30 * n_days)::INT AS cost_s,
           CASE WHEN 6 + 30 * n_days < 90 THEN (6 + 30 * n_days) || ' s'
                ELSE round_even((6 + 30 * n_days) / 60e0, 0)::INT || ' min' END AS cost FROM resolved""")
check("stitched_hours", ["pixel_hours"], """
    SELECT init_ts + to_hours(lead_h) AS t, count(*) AS n, min(run) AS run FROM pixel_hours
    WHERE init_ts >= TIMESTAMP '2026-06-30' AND init_ts < TIMESTAMP '2026-07-04' AND lead_h < 6 GROUP BY 1""")
check("stitch_union", ["pixel_hours"], "SELECT run, lead_h, count(*) AS n FROM pixel_hours GROUP BY run, lead_h")
check("scan_runs", ["runs"], "SELECT run, init_ts FROM runs")
check("run_extent", ["runs"], """
    SELECT count(*) AS n_runs, min(init_ts)::DATE AS first_day, max(init_ts)::DATE AS last_day, max(init_ts) AS newest FROM runs""")
check("last_days", ["pixel_hours", "archive"],
      "SELECT run, count(*) AS n FROM pixel_hours, archive WHERE init_ts >= hi - 2 GROUP BY run")
check("newest_reading", ["cell_hour"], f"SELECT cell, max(t) AS t, {r6('max_by(tc, t)', 'tc')} FROM cell_hour GROUP BY cell")
check("newest_run_wins", ["cell_hour7"], f"""
    SELECT cell, t, init_ts, {r6('tc')}, {r6('rh')}, {r6('mm')}, {r6('ws')} FROM cell_hour7
    QUALIFY row_number() OVER (PARTITION BY cell, t ORDER BY init_ts DESC) = 1""")

# ---- mask ---------------------------------------------------------------------------------

def ring(x0: str, y0: str, corners: list[tuple[str, str]]) -> str:
    points = [*corners, corners[0]]
    return "[" + ", ".join(f"{{'x': {x0} + {x}, 'y': {y0} + {y}}}" for x, y in points) + "]"


def nation_rings(corners: tuple) -> str:
    text = [(d(x), d(y)) for x, y in corners]
    return "[" + ring("(-124.8e0 + 11.58e0 * (n_nationkey % 5))", "(24.4e0 + 5.02e0 * (n_nationkey // 5))", text) + "]"


def nation_part(part: str, corners: tuple) -> str:
    return f"""
    SELECT 'div-' || lpad(n_nationkey::VARCHAR, 2, '0') AS id, n_name AS name, 'US-' || upper(substr(r_name, 1, 2)) AS region,
           '{part}' AS part, {nation_rings(corners)} AS rings
    FROM nation JOIN region ON n_regionkey = r_regionkey"""


cte("divisions", [], nation_part("whole", D.WHOLE))
cte("pieces", [], nation_part("w", D.WEST) + " UNION ALL " + nation_part("e", D.EAST))
SHELL = ring("x0", "y0", [("0e0", "0e0"), ("w", "13e-2"), ("w * 9e-1", "h"), ("1e-1", "h * 8e-1")])
HOLE = ring("x0", "y0", [("w * 3e-1", "h * 3e-1"), ("w * 3e-1", "h * 6e-1"), ("w * 6e-1", "h * 6e-1"), ("w * 6e-1", "h * 3e-1")])
cte("features", [], f"""
    SELECT CASE WHEN k % 13 = 0 THEN '' WHEN k % 17 <> 0 THEN 'div-' || (k % 997) END AS division_id, 'area-' || k AS id,
           c_name AS name, CASE WHEN k % 19 = 0 THEN 'region' ELSE 'county' END AS subtype,
           CASE WHEN k % 23 = 0 THEN NULL ELSE k % 29 <> 0 END AS is_land,
           CASE WHEN k % 37 = 0 THEN 'CA' ELSE 'US' END AS country,
           CASE WHEN k % 41 = 0 THEN 'US-AK' WHEN k % 43 <> 0 THEN 'US-' || substr(c_mktsegment, 1, 2) END AS region,
           'p' || k AS part,
           CASE WHEN k % 31 = 0 THEN [] WHEN k % 9 = 0 THEN [{SHELL}, {HOLE}] ELSE [{SHELL}] END AS rings
    FROM (SELECT *, c_custkey AS k, -124e0 + (c_custkey * {D.SPREAD} % 5500) / 100e0 AS x0, 25e0 + (c_custkey * 104729 % 2200) / 100e0 AS y0,
                 61e-2 + (c_custkey % 7) * 15e-2 AS w, 53e-2 + (c_custkey % 5) * 17e-2 AS h FROM customer)""")
cte("counties", ["features"], """
    SELECT coalesce(nullif(division_id, ''), id) AS id, name, coalesce(substr(region, 4), '') AS region, part, rings
    FROM features
    WHERE subtype = 'county' AND is_land AND country = 'US' AND len(rings) > 0 AND coalesce(substr(region, 4), '') NOT IN ('AK', 'HI')""")


def edges_of(source: str) -> str:
    return f"""
    SELECT id, part, ring[i].x AS x0, ring[i].y AS y0, ring[i + 1].x AS x1, ring[i + 1].y AS y1
    FROM (SELECT id, part, ring, unnest(range(1, len(ring))) AS i FROM (SELECT id, part, unnest(rings) AS ring FROM {source}))"""


cte("county_edges", ["counties"], edges_of("counties"))
cte("areas", ["features"], "SELECT coalesce(nullif(division_id, ''), id) AS id, part, rings FROM features WHERE len(rings) > 0")
cte("area_edges", ["areas"], edges_of("areas"))
cte("division_edges", ["divisions"], edges_of("divisions"))
cte("piece_edges", ["pieces"], edges_of("pieces"))
cte("mask_points", ["grid"], f"SELECT *, lon + {d(D.NUDGE_LON)} AS px, lat + {d(D.NUDGE_LAT)} AS py FROM grid")


def inside(edges: str, points: str, keys: str, lon: str, lat: str) -> str:
    """Odd number of edges to the right, every point against every edge."""
    return f"""
    SELECT {keys}, id, part FROM {points} JOIN {edges}
      ON (y0 > {lat}) <> (y1 > {lat}) AND x0 + ({lat} - y0) / (y1 - y0) * (x1 - x0) > {lon}
    GROUP BY {keys}, id, part HAVING count(*) % 2 = 1"""


def centres(name: str, edges: str, res: int) -> None:
    """Every cell centre of the rectangle around some edges."""
    s = edge_km(res)
    y = f"sin(radians({{}})) * {d(EARTH_KM / COS0)} / {d(1.5 * s)}"
    x = f"radians({{}}) * {d(EARTH_KM * COS0)} / {d(s * ROOT3)}"
    cte(name, [edges], f"""
    SELECT cell, degrees(asin(yy * {d(COS0 / EARTH_KM)})) AS lat, degrees(xx / {d(EARTH_KM * COS0)}) AS lon
    FROM (SELECT (q + {HALF_AXIS}) * {1 << AXIS_BITS} + r + {HALF_AXIS} AS cell, (q + r / 2e0) * {d(s * ROOT3)} AS xx, r * {d(s * 1.5)} AS yy
          FROM (SELECT r, unnest(range((w - r / 2e0)::BIGINT - 2, (e - r / 2e0)::BIGINT + 3)) AS q
                FROM (SELECT w, e, unnest(range(s::BIGINT - 1, n::BIGINT + 2)) AS r
                      FROM (SELECT {x.format('min(x0)')} AS w, {x.format('max(x0)')} AS e,
                                   {y.format('min(y0)')} AS s, {y.format('max(y0)')} AS n FROM {edges}))))""")


centres("fill_centres", "county_edges", FILL_RES)
centres("coarse_centres", "county_edges", D.RES)
centres("land_centres", "division_edges", D.RES)
cte("filled", ["county_edges", "fill_centres"], inside("county_edges", "fill_centres", "cell", "lon", "lat"))
cte("filled_coarse", ["county_edges", "coarse_centres"], inside("county_edges", "coarse_centres", "cell", "lon", "lat"))
cte("filled_land", ["division_edges", "land_centres"], inside("division_edges", "land_centres", "cell", "lon", "lat"))
cte("land_pix", ["pix", "filled_land"], "SELECT * FROM pix WHERE cell IN (SELECT cell FROM filled_land)")

check("filter_divisions", ["counties"], "SELECT id, name, region, part, len(rings)::INT AS n_rings FROM counties")
check("all_pieces", ["pieces", "divisions", "counties"], " UNION ALL ".join(
    f"SELECT id, part, region, len(rings)::INT AS n_rings FROM {t}" for t in ("pieces", "divisions", "counties")))
check("ring_edges", ["county_edges"], f"SELECT id, part, {r6('x0')}, {r6('y0')}, {r6('x1')}, {r6('y1')} FROM county_edges")
check("explode_parts", ["counties"], """
    SELECT part AS id, 0 AS part, len(rings)::INT AS n_rings FROM counties UNION ALL SELECT part, 1, 1 FROM counties""")
check("polyfill_center", ["division_edges", "mask_points"],
      f"SELECT yi, xi, id FROM ({inside('division_edges', 'mask_points', 'yi, xi, px, py', 'px', 'py')})")
check("polyfill_counties", ["county_edges", "mask_points"],
      f"SELECT yi, xi, id, part FROM ({inside('county_edges', 'mask_points', 'yi, xi, px, py', 'px', 'py')})")
check("dissolve_divisions", ["piece_edges", "mask_points"],
      f"SELECT DISTINCT id, yi, xi FROM ({inside('piece_edges', 'mask_points', 'yi, xi, px, py', 'px', 'py')})")
cte("polygons", ["counties"], """
    SELECT part AS id, 0 AS part, rings FROM counties UNION ALL SELECT part, 1, rings[1:1] FROM counties""")
cte("polygon_edges", ["polygons"], edges_of("polygons"))
check("polyfill_by_sql", ["polygon_edges", "fill_centres"],
      f"SELECT id, part, cell FROM ({inside('polygon_edges', 'fill_centres', 'cell', 'lon', 'lat')})")
check("outline_divisions", ["divisions"], f"""
    SELECT id, {r6('p.x', 'x')}, {r6('p.y', 'y')}
    FROM (SELECT id, unnest(ring[1:len(ring) - 1]) AS p FROM (SELECT id, unnest(rings) AS ring FROM divisions))""")
# Cells of a parcel, their corners in thirds of the axes; what two cells share is dropped, and rings are walked corner by
# corner from their least edge.
CORNERS = ((-1, 2), (-2, 1), (-1, -1), (1, -2), (2, -1), (1, 1))
SIDES = ", ".join(
    f"({a}, {b}, {c}, {e})" for (a, b), (c, e) in zip(CORNERS, [*CORNERS[1:], CORNERS[0]])
)
cte("sides", ["filled"], f"""
    SELECT part, 3 * q + da AS x0, 3 * r + db AS y0, 3 * q + dc AS x1, 3 * r + de AS y1
    FROM (SELECT DISTINCT part, (cell >> {AXIS_BITS}) - {HALF_AXIS} AS q, (cell & {AXIS_MASK}) - {HALF_AXIS} AS r FROM filled)
    CROSS JOIN (VALUES {SIDES}) AS v(da, db, dc, de)""")
cte("rim", ["sides"], """
    SELECT *, row_number() OVER (ORDER BY part, x0, y0, x1, y1) AS e FROM sides s
    WHERE NOT EXISTS (SELECT 1 FROM sides o WHERE o.part = s.part AND o.x0 = s.x1 AND o.y0 = s.y1 AND o.x1 = s.x0 AND o.y1 = s.y0)""")
cte("linked", ["rim"], """
    SELECT a.part, a.e, b.e AS next, a.x0 * a.y1 - a.x1 * a.y0 AS twice FROM rim a JOIN rim b ON b.part = a.part AND b.x0 = a.x1 AND b.y0 = a.y1""")
cte("rounds", ["linked"], """
    SELECT part, e AS first, e, next, twice FROM linked
    UNION ALL
    SELECT w.part, w.first, l.e, l.next, l.twice FROM rounds w JOIN linked l ON l.e = w.next WHERE w.next > w.first""")
check("outline_cells", ["rounds"], f"""
    SELECT part, count(*) AS n_corners, (sum(twice) // {sum(a * e - c * b for (a, b), (c, e) in zip(CORNERS, [*CORNERS[1:], CORNERS[0]]))})::BIGINT AS n_cells,
           sum(twice) < 0 AS is_hole
    FROM rounds GROUP BY part, first HAVING bool_or(next = first)""")
check("geometry_commands", ["features"], """
    SELECT id, n_words::INT AS n_words, ord::INT AS ord, len(ring)::INT AS n_points,
           list_sum(list_transform(range(1, len(ring)), lambda i: ring[i].x * ring[i + 1].y - ring[i + 1].x * ring[i].y))::BIGINT AS area2,
           ring[1].x AS x, ring[1].y AS y
    FROM (SELECT id, list_sum(list_transform(grid, lambda r: 3 + 2 * (len(r) - 1))) AS n_words, unnest(range(len(grid))) AS ord, unnest(grid) AS ring
          FROM (SELECT id, list_transform(rings, lambda r: list_transform(r, lambda p: {'x': round_even(p.x * 10000, 0)::BIGINT, 'y': round_even(p.y * 10000, 0)::BIGINT})) AS grid
                FROM features))""")
check("polyfill_cells", ["filled"], "SELECT id, part, cell FROM filled")
check("distinct_cells", ["filled"], "SELECT cell, min(id) AS id FROM filled GROUP BY cell")
DIVISION_TABLE = """
    SELECT *, (row_number() OVER (ORDER BY id) - 1)::INT AS county_idx, name || ', ' || region AS label
    FROM (SELECT id, min_by(name, part) AS name, min_by(region, part) AS region FROM {} GROUP BY id)"""
check("division_table", ["counties"], DIVISION_TABLE.format("counties"))
centres("area_centres", "area_edges", FILL_RES)
cte("filled_areas", ["area_edges", "area_centres"], inside("area_edges", "area_centres", "cell", "lon", "lat"))
check("cell_county", ["filled_areas", "counties"], f"""
    SELECT cell, pos, id, county_idx, coalesce(county_idx, 65535) AS county_code, label,
           coalesce('cell in ' || label, 'cell ' || printf('%x', cell)) AS readout
    FROM (SELECT cell, min(id) AS id, (row_number() OVER (ORDER BY cell) - 1)::INT AS pos FROM filled_areas GROUP BY cell)
    LEFT JOIN ({DIVISION_TABLE.format("counties")}) USING (id)""")
check("land_pixels", ["land_pix"], "SELECT yi, xi, cell FROM land_pix")
check("land_blocks", ["land_pix"], "SELECT yb, xb, count(*) AS n_pixels FROM land_pix GROUP BY yb, xb")
check("block_islands", ["land_pix"], """
    SELECT yb, min(xb) AS xb0, max(xb) AS xb1
    FROM (SELECT yb, xb, xb - row_number() OVER (PARTITION BY yb ORDER BY xb) AS g FROM (SELECT DISTINCT yb, xb FROM land_pix))
    GROUP BY yb, g""")
check("block_of", ["pixel_hours"], "SELECT (yi // 26)::INT AS block_y, (xi // 30)::INT AS block_x, count(*) AS n FROM pixel_hours GROUP BY 1, 2")
check("prune_blocks", ["pixel_hours", "land_pix"], """
    SELECT yb, xb, count(*) AS n FROM pixel_hours WHERE (yb, xb) IN (SELECT (yb, xb) FROM land_pix) GROUP BY yb, xb""")
cte("land_hour", ["pixel_hours", "land_pix"], fold(6, "land_pix"))
cte("land_film", ["land_hour"], film_of("land_hour"))
check("masked_fold", ["land_film"], "SELECT cell, t, hi_q, wx_q FROM land_film")
for _res in range(1, S.FINEST_RESOLUTION + 1):
    centres(f"guard_centres{_res}", "division_edges", _res)
    cte(f"guard_filled{_res}", ["division_edges", f"guard_centres{_res}"], inside("division_edges", f"guard_centres{_res}", "cell", "lon", "lat"))
    cte(f"guard_pix{_res}", ["grid"], hexed("grid", _res, "yi, xi"))
check("guard_resolution", [f"guard_{x}{r}" for r in range(1, S.FINEST_RESOLUTION + 1) for x in ("filled", "pix")], " UNION ALL ".join(f"""
    SELECT {r} AS res, count(*) AS n_cells, count(*) FILTER (n = 0) AS n_empty
    FROM (SELECT cell, count(yi) AS n FROM (SELECT DISTINCT cell FROM guard_filled{r}) LEFT JOIN guard_pix{r} USING (cell) GROUP BY cell)"""
    for r in range(1, S.FINEST_RESOLUTION + 1)))
check("scan_grid", ["grid"], f"SELECT yi, xi, yb, xb, {r6('lat')}, {r6('lon')} FROM grid")
check("scan_pieces", ["counties"], "SELECT id, name, region, part, len(rings)::INT AS n_rings FROM counties")
check("fold_coverage", ["filled_coarse", "pix"], """
    SELECT cell, count(yi) AS n_pixels FROM (SELECT DISTINCT cell FROM filled_coarse) LEFT JOIN pix USING (cell) GROUP BY cell""")
S3 = edge_km(D.RES)
check("cell_centres", ["cells"], f"""
    SELECT cell, pos, {r6(f'degrees(asin(r * {d(S3 * 1.5)} * {d(COS0 / EARTH_KM)}))', 'lat')},
           {r6(f'degrees((q + r / 2e0) * {d(S3 * ROOT3)} / {d(EARTH_KM * COS0)})', 'lon')},
           cell AS again, printf('%x', cell) AS hex, cell AS from_hex
    FROM (SELECT *, (cell >> {AXIS_BITS}) - {HALF_AXIS} AS q, (cell & {AXIS_MASK}) - {HALF_AXIS} AS r FROM cells)""")
cte("raw_rings", [], """
    SELECT id, x, y, s, unnest(range(0, CASE WHEN id % 2 = 1 THEN 4 ELSE 2 END)) AS ord
    FROM (SELECT c_custkey AS id, (c_custkey * 7919 % 4096)::DOUBLE AS x, (c_custkey * 104729 % 4096)::DOUBLE AS y, 20e0 + c_custkey % 30 AS s
          FROM customer)""")
AREA = "2 * pow(s * CASE ord WHEN 0 THEN 1e0 WHEN 1 THEN 25e-2 WHEN 2 THEN 5e-1 ELSE 125e-3 END, 2) * CASE WHEN ord % 2 = 0 THEN 1 ELSE -1 END"
check("ring_area", ["raw_rings"], f"SELECT id, ord::INT AS ord, {AREA} AS area2, ord % 2 = 0 AS is_exterior FROM raw_rings")
check("ring_nesting", ["raw_rings"],
      "SELECT id, ord::INT AS ord, (ord - ord % 2)::INT AS polygon, ord % 2 = 1 AS is_hole FROM raw_rings")

# ---- tiles and directories ----------------------------------------------------------------

def tile(lon: str, lat: str, z: str) -> tuple[str, str]:
    phi = f"radians(least(greatest({lat}, {d(-MERCATOR_LAT)}), {d(MERCATOR_LAT)}))"
    n = f"pow(2e0, {z})"
    x = f"least(greatest(floor(({lon} + 180) / 360 * {n}), 0), {n} - 1)::INT"
    y = f"least(greatest(floor((1 - ln(tan({phi}) + 1 / cos({phi})) / {d(math.pi)}) / 2 * {n}), 0), {n} - 1)::INT"
    return x, y


cte("zoomed", ["grid"], "SELECT yi, xi, lon, CASE WHEN (yi * 100 + xi) % 7 = 0 THEN lat + 61.5e0 ELSE lat END AS lat, unnest(range(0, 9))::INT AS z FROM grid")
TX, TY = tile("lon", "lat", "z")
cte("tiles", ["zoomed"], f"SELECT yi, xi, z, {TX} AS x, {TY} AS y FROM zoomed")
check("tile_points", ["tiles"], "SELECT yi, xi, z, x, y FROM tiles")
check("tile_lonlat", ["tiles"], f"""
    SELECT yi, xi, z, {r6('(x + yi / 4096e0) / pow(2e0, z) * 360 - 180', 'lon')},
           {r6(f'degrees(atan(sinh({d(math.pi)} * (1 - 2 * (y + xi / 4096e0) / pow(2e0, z)))))', 'lat')} FROM tiles""")
BW, BN = tile("west", "north", "z")
BE, BS = tile("east", "south", "z")
check("box_tiles", [], f"""
    SELECT box, z, x, unnest(range(n, s + 1))::INT AS y
    FROM (SELECT box, z, n, s, unnest(range(w, e + 1))::INT AS x
          FROM (SELECT box, z, {BW} AS w, {BE} AS e, {BN} AS n, {BS} AS s
                FROM (SELECT *, west + 2 + box % 3 AS east, south + 15e-1 + box % 2 AS north
                      FROM (SELECT c_custkey AS box, (c_custkey % 5 + 4)::INT AS z, -124.8e0 + (c_custkey * {D.SPREAD} % 5500) / 100e0 AS west,
                                   24.4e0 + (c_custkey * 104729 % 2200) / 100e0 AS south FROM customer))))""")
cte("boxes", [], f"""
    SELECT *, west + 2 + box % 3 AS east, south + 15e-1 + box % 2 AS north
    FROM (SELECT c_custkey AS box, -124.8e0 + (c_custkey * {D.SPREAD} % 5500) / 100e0 AS west,
                 24.4e0 + (c_custkey * 104729 % 2200) / 100e0 AS south FROM customer)""")
check("box_of_readings", ["pixel_hours", "grid"], """
    SELECT yi, xi, count(*) AS n FROM pixel_hours JOIN grid USING (yi, xi)
    WHERE lon BETWEEN -105.03e0 AND -92.97e0 AND lat BETWEEN 31.02e0 AND 39.98e0 GROUP BY yi, xi""")
check("pixels_in_boxes", ["grid", "boxes"], """
    SELECT box, count(*) AS n, sum(yi)::BIGINT AS sum_yi, sum(xi)::BIGINT AS sum_xi
    FROM grid JOIN boxes ON lon BETWEEN west AND east AND lat BETWEEN south AND north GROUP BY box""")


def descent(source: str, keys: str) -> str:
    """Tiles `x, y` at zoom `z` of a table, walked down the curve a level a step; the last has its place in `d`."""
    return f"""
    SELECT {keys}, z, z AS level, x::BIGINT AS x, y::BIGINT AS y, 0::BIGINT AS d FROM {source}
    UNION ALL
    SELECT {keys}, z, level - 1, CASE WHEN sy = 0 THEN CASE WHEN sx = 1 THEN h - 1 - y ELSE y END ELSE x END,
           CASE WHEN sy = 0 THEN CASE WHEN sx = 1 THEN h - 1 - x ELSE x END ELSE y END, d + h * h * xor(3 * sx, sy)
    FROM (SELECT *, x % (2 * h) // h AS sx, y % (2 * h) // h AS sy
          FROM (SELECT {keys}, z, level, d, h, ((x % (2 * h)) + 2 * h) % (2 * h) AS x, ((y % (2 * h)) + 2 * h) % (2 * h) AS y
                FROM (SELECT *, (1::BIGINT << (level - 1)) AS h FROM {{name}} WHERE level > 0)))"""


BW6, BN6 = tile("west", "north", "6")
BE6, BS6 = tile("east", "south", "6")
cte("six_tiles", ["boxes"], f"""
    SELECT box, 6 AS z, x, unnest(range(n, s + 1))::INT AS y
    FROM (SELECT box, n, s, unnest(range(w, e + 1))::INT AS x FROM (SELECT box, {BW6} AS w, {BE6} AS e, {BN6} AS n, {BS6} AS s FROM boxes))""")
cte("six_descent", ["six_tiles"], descent("six_tiles", "box").replace("{name}", "six_descent"))
check("box_intervals", ["six_descent"], """
    SELECT box, min(place) AS lo, max(place) AS hi
    FROM (SELECT box, place, place - row_number() OVER (PARTITION BY box ORDER BY place) AS island
          FROM (SELECT box, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS place FROM six_descent WHERE level = 0)) GROUP BY box, island""")
cte("descent", ["tiles"], descent("tiles", "yi, xi").replace("{name}", "descent"))
check("hilbert_ids", ["descent"], """
    SELECT yi, xi, z, ((1::BIGINT << (2 * z)) - 1) // 3 + d AS tile_id FROM descent WHERE level = 0""")
cte("directory", [], """
    SELECT (o_orderkey % 50)::INT AS dir, o_orderkey AS ord, 1 + o_custkey % 5 AS delta, (o_custkey % 4)::INT AS run,
           100 + o_custkey % 50 AS length, CASE WHEN o_custkey % 3 = 0 THEN 1 + o_custkey * 10 ELSE 0 END AS code FROM orders""")
cte("entries", ["directory"], """
    SELECT dir, ord, id, run, length,
           last_value(CASE WHEN n = 1 OR code <> 0 THEN code - 1 - before END IGNORE NULLS) OVER (PARTITION BY dir ORDER BY ord) + before AS offset
    FROM (SELECT *, sum(delta) OVER (PARTITION BY dir ORDER BY ord)::BIGINT AS id, row_number() OVER (PARTITION BY dir ORDER BY ord) AS n,
                 (sum(length) OVER (PARTITION BY dir ORDER BY ord) - length)::BIGINT AS before FROM directory)""")
check("delta_decode", ["entries"], 'SELECT dir, ord, id, run, length, "offset" FROM entries')
check("covering_run", ["entries"], f"""
    SELECT dir, key, CASE WHEN run = 0 OR key - id < run THEN id END AS id, CASE WHEN run = 0 OR key - id < run THEN run END AS run, n
    FROM (SELECT k.dir, k.key, e.id, e.run, k.n, row_number() OVER (PARTITION BY k.dir, k.key ORDER BY e.id DESC) AS nth
          FROM (SELECT dir, (l_partkey * {D.SPREAD} + l_orderkey) % (top + 8) AS key, count(*) AS n
                FROM lineitem JOIN (SELECT dir, max(id) AS top FROM entries GROUP BY dir) ON dir = l_orderkey % 50 GROUP BY 1, 2) k
          LEFT JOIN entries e ON e.dir = k.dir AND e.id <= k.key)
    WHERE nth = 1""")
check("zigzag_moves", ["directory"], """
    SELECT dir, ord, dx, sum(dx) OVER (PARTITION BY dir ORDER BY ord)::BIGINT AS x
    FROM (SELECT dir, ord, CASE WHEN length % 2 = 0 THEN length // 2 ELSE -(length + 1) // 2 END AS dx FROM directory)""")
check("feature_properties", ["features"], "SELECT id, subtype, country, name FROM features")

# ---- landing and text ---------------------------------------------------------------------

cte("shards", ["pixel_hours"], f"""
    SELECT DISTINCT run, variable, variable || '/c/' || run || '/' || yb || '/' || xb AS key
    FROM pixel_hours CROSS JOIN (SELECT unnest([{", ".join(repr(v) for v in S.CUBE_VARIABLES)}]) AS variable)""")
check("landed_split", ["shards"], "SELECT key, run < 20 AS hit FROM shards")
check("to_fetch", ["shards"], "SELECT key, run, variable FROM shards WHERE run >= 20")
check("already_landed", ["shards"], "SELECT key, run, variable FROM shards WHERE run < 20")
check("shard_names", ["shards"], """
    SELECT key, regexp_extract(key, '[^/]*$') AS tail, run AS index, replace(key, '/', '__') || '.all' AS whole,
           replace(key, '/', '__') || '.x' || substr(sha1(variable), 1, 12) AS ranged FROM shards""")
check("latest_release", [], "SELECT strftime(max(o_orderdate), '%Y-%m-%d') || '.0' AS release FROM orders")
check("land_incremental", ["pixel_hours"], """
    SELECT run, run < (SELECT max(run) FROM pixel_hours) AS from_landing, count(*) AS n, sum(xi)::BIGINT AS sum_xi FROM pixel_hours GROUP BY run""")
check("cached_table", ["counties"], "SELECT id, name, region, part FROM counties")
check("division_labels", ["features"], """
    SELECT id AS own_id, coalesce(substr(region, 4), '') AS suffix, coalesce(nullif(division_id, ''), id) AS key,
           name || ', ' || coalesce(substr(region, 4), '') AS label FROM features""")
check("hex_rgb", [], f"""
    SELECT o_orderkey, (c // 65536)::INT AS r, (c // 256 % 256)::INT AS g, (c % 256)::INT AS b
    FROM (SELECT o_orderkey, o_orderkey * {D.SPREAD} % 16777216 AS c FROM orders)""")

# ---- streams: the batch answer over the hours that the watermark has closed ----------------

cte("closed_hours", [], """
    SELECT user_id AS cell, date_trunc('hour', ts) AS t, avg(value) AS value, avg(event_id % 11) AS ws, avg(event_id % 7 * 5e-1) AS mm, count(*) AS n FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
cte("event_steps", ["closed_hours"], """
    SELECT cell, t, value AS hi, ws, mm, row_number() OVER (PARTITION BY cell ORDER BY t) AS n FROM closed_hours""")
cte("event_walk", ["event_steps", "one"], walk_of("event_steps", "one").replace("{name}", "event_walk"))
check("stream_fold", ["closed_hours"], f"SELECT cell, t, {r6('value')}, n FROM closed_hours")
check("stream_sustained", ["event_walk"], f"SELECT cell, t, {r6('l')}, 1::BIGINT AS late FROM event_walk")
check("stream_land", ["pixel_hours"], "SELECT run, count(*) AS n, sum(xi)::BIGINT AS sum_xi FROM pixel_hours GROUP BY run")
check("stream_released", ["event_walk"], f"""
    SELECT cell, t, {r6('l')} FROM event_walk WHERE t <= (SELECT max(t) FROM event_walk) - INTERVAL 24 HOUR - INTERVAL 30 MINUTE""")
check("stream_corrections", [], f"""
    SELECT user_id AS cell, date_trunc('hour', ts) AS t, {r6('avg(value)', 'value')}, count(*) AS n FROM events GROUP BY 1, 2""")
check("stream_land_closed", ["pixel_hours"], """
    SELECT run, count(*) AS n, sum(xi)::BIGINT AS sum_xi FROM pixel_hours WHERE run < (SELECT max(run) FROM pixel_hours) GROUP BY run""")
