"""The SQL surface: views and SQL functions, so that the jobs can be written as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hexheat.functions.cells import AXIS_BITS, COS0, EARTH_KM, HALF_AXIS, RES6_AREA_KM2, ROOT3, APERTURE

# SQL functions are expanded into the plan, so a call costs what the expression costs.
_EDGE = f"sqrt(2e0 * {RES6_AREA_KM2}D * pow({APERTURE}D, 6 - res) / {3 * ROOT3!r}D)"
_X = f"(radians(lon) * {EARTH_KM * COS0!r}D)"
_Y = f"(sin(radians(lat)) * {EARTH_KM / COS0!r}D)"
_Q = f"(({_X} * {ROOT3 / 3!r}D - {_Y} / 3e0) / {_EDGE})"
_R = f"({_Y} * {2 / 3!r}D / {_EDGE})"

FUNCTIONS = {
    "cell_of_axes(q DOUBLE, r DOUBLE) RETURNS BIGINT": f"""
        CASE WHEN abs(q - rint(q)) >= abs(r - rint(r))
             THEN shiftleft(CAST(rint(q) + rint(q - rint(q) + (r - rint(r)) / 2e0) AS BIGINT) + {HALF_AXIS}, {AXIS_BITS})
                  + CAST(rint(r) AS BIGINT)
             ELSE shiftleft(CAST(rint(q) AS BIGINT) + {HALF_AXIS}, {AXIS_BITS})
                  + CAST(rint(r) + rint(r - rint(r) + (q - rint(q)) / 2e0) AS BIGINT)
        END + {HALF_AXIS}""",
    "cell_of(lat DOUBLE, lon DOUBLE, res INT) RETURNS BIGINT": f"cell_of_axes({_Q}, {_R})",
    "wind_speed(u DOUBLE, v DOUBLE) RETURNS DOUBLE": "sqrt(u * u + v * v)",
    "rain_mm(rate DOUBLE) RETURNS DOUBLE": "rate * 3600e0",
    "valid_time(init_ts TIMESTAMP_NTZ, lead_h INT) RETURNS TIMESTAMP_NTZ": "timestampadd(HOUR, lead_h, init_ts)",
    "decay(half_life DOUBLE) RETURNS DOUBLE": "pow(2e0, -1e0 / half_life)",
}

# Functions that return tables, for use with LATERAL. A polygon is filled by rows of cell centres: what a row's latitude
# cuts is ordered and paired, and the centres between are listed. Each body is one generator, so that LATERAL becomes
# that generator. Of more than one Spark makes a join of the polygons with what they give, broadcast by a guessed size.
# A row therefore holds the cells of one polygon: of the whole Earth at the finest resolution some 14 million.
_RINGS = "ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
_ROW = f"(sin(radians({{}})) * {EARTH_KM / COS0!r}D / (1.5D * p.s))"
_COLUMN = f"(radians({{}}) * {EARTH_KM * COS0!r}D / (p.s * {ROOT3!r}D) - r / 2D)"
_LON = f"degrees((q + r / 2D) * p.s * {ROOT3!r}D / {EARTH_KM * COS0!r}D)"
_LAT = f"degrees(asin(r * 1.5D * p.s * {COS0 / EARTH_KM!r}D))"
_EDGES = """flatten(transform(rings, ring -> zip_with(
    slice(ring, 1, greatest(size(ring) - 1, 0)), slice(ring, 2, greatest(size(ring) - 1, 0)),
    (a, b) -> struct(a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1))))"""
_CUTS = """array_sort(transform(
    filter(p.edges, e -> (e.y0 > lat) <> (e.y1 > lat)), e -> e.x0 + (lat - e.y0) / (e.y1 - e.y0) * (e.x1 - e.x0)))"""
_SPANS = "if(size(xs) > 1, transform(sequence(0, size(xs) DIV 2 - 1), k -> struct(xs[2 * k] AS x0, xs[2 * k + 1] AS x1)), array())"
_COLUMNS = f"sequence(CAST(floor({_COLUMN.format('span.x0')}) AS BIGINT), CAST(ceil({_COLUMN.format('span.x1')}) AS BIGINT))"
_SPAN_CELLS = f"""transform(filter({_COLUMNS}, q -> {_LON} >= span.x0 AND {_LON} < span.x1),
    q -> shiftleft(q + {HALF_AXIS}, {AXIS_BITS}) + r + {HALF_AXIS})"""
_ROWS = f"""if(size(p.edges) > 0, sequence(
    CAST(floor({_ROW.format('array_min(transform(p.edges, e -> least(e.y0, e.y1)))')}) AS BIGINT),
    CAST(ceil({_ROW.format('array_max(transform(p.edges, e -> greatest(e.y0, e.y1)))')}) AS BIGINT)), array())"""


def _each(values: str, name: str, inner: str) -> str:
    """All that `inner` lists for each of `values`; a value for which it is NULL gives nothing."""
    return f"flatten(transform({values}, {name} -> coalesce({inner}, array())))"


# An array of one value, gone through, names that value: it is worked out once.
_CELLS = _each(f"array(struct({_EDGE} AS s, {_EDGES} AS edges))", "p", _each(_ROWS, "r", _each(
    f"array({_LAT})", "lat", _each(f"array({_CUTS})", "xs", _each(_SPANS, "span", _SPAN_CELLS)))))
TABLE_FUNCTIONS = {
    f"parts(polygons ARRAY<{_RINGS}>) RETURNS TABLE (part INT, rings {_RINGS})": """
        SELECT posexplode(polygons) AS (part, rings)""",
    f"polyfill(rings {_RINGS}, res INT) RETURNS TABLE (cell BIGINT)": f"""
        SELECT explode({_CELLS}) AS cell""",
}

FOLD_SQL = """
    WITH labelled AS (
        SELECT yi, xi, cell_of(lat, lon, :res) AS cell FROM {pixels}
    )
    SELECT init_ts, lead_h, cell,
           CAST(avg(tc) AS FLOAT) AS tc,
           CAST(nullif(avg(rh), double('NaN')) AS FLOAT) AS rh,
           CAST(rain_mm(avg(rain)) AS FLOAT) AS mm,
           CAST(avg(wind_speed(u, v)) AS FLOAT) AS ws
    FROM {cube} JOIN labelled USING (yi, xi)
    WHERE tc IS NOT NULL AND NOT isnan(tc)
    GROUP BY init_ts, lead_h, cell
"""


def register_functions(spark: SparkSession) -> None:
    """Define the SQL functions in the session, replacing older definitions."""
    for signature, body in (FUNCTIONS | TABLE_FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def fold_sql(spark: SparkSession, cube: DataFrame, pixels: DataFrame, res: int) -> DataFrame:
    """The fold as SQL text over two frames, resolution as a parameter; no view is made or replaced."""
    return spark.sql(FOLD_SQL, args={"res": res}, cube=cube, pixels=pixels)


