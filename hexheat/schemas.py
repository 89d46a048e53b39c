"""Table schemas and the constants every module shares."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: defaults and limits of the published product -------------------------
LEADS_PER_RUN = 6
RUN_SPACING_HOURS = 6
MAX_WINDOW_DAYS = 14
DEFAULT_WINDOW = ("2026-06-29", "2026-07-05")
BLOCK_Y, BLOCK_X = 265, 300
FINEST_RESOLUTION = 6
EXCLUDED_REGIONS = ("AK", "HI")
CONUS_BOX = (-124.8, 24.4, -66.9, 49.5)
DIVISION_ZOOM = 8
FALLBACK_RELEASE = "2026-08-19.0"

HALF_LIFE_H = 12.0
THRESHOLD_C = 27.0
RAIN_FLUSH = 0.5
WIND_VENT = 0.3
FULL_FLUSH_MM = 2.5
FULL_VENT_MS = 10.0

NO_DATA = 255
NO_COUNTY = 65535
HI_OFFSET_C = 40.0
HI_STEPS_PER_C = 2.0
LOAD_STEPS_PER_C = 10.0
TOP_CODE = 254

INDEX_STOPS = ("#08306b", "#2f79b5", "#9ecae1", "#f2f0e6", "#fee391", "#fdb034", "#d94801")
LOAD_STOPS = ("#000004", "#1b0c41", "#4a0c6b", "#781c6d", "#a52c60",
              "#cf4446", "#ed6925", "#fb9b06", "#f7d13d", "#fcffa4")
NO_DATA_RGBA = (40, 44, 50, 60)
INDEX_ALPHA = 225
LOAD_ALPHA_BASE, LOAD_ALPHA_SPAN = 60, 175
# -----------------------------------------------------------------------------------------

# Series are UTC wall time without a zone, so no session setting can shift them.
TS = T.TimestampNTZType()

CUBE_VARIABLES = ("tc", "rh", "rain", "u", "v")

# Stored partitioned by (init_day, yb, xb): a day of runs per directory keeps files near
# 100 MB at the full grid, and a block of pixels per directory is what the land mask prunes.
CUBE_PARTITIONS = ("init_day", "yb", "xb")
# The full grid has 24 blocks. A cube of more blocks than this gets a directory a day: one a day and block would be
# days times blocks, however few rows each holds. Its blocks are pruned by the statistics of row groups.
MOST_BLOCK_FOLDERS = 128
ROW_GROUP_ROWS = 20_000

CUBE = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("init_ts", TS),
    T.StructField("lead_h", T.IntegerType()),
    T.StructField("yi", T.IntegerType()),
    T.StructField("xi", T.IntegerType()),
    T.StructField("tc", T.DoubleType()),
    T.StructField("rh", T.DoubleType()),
    T.StructField("rain", T.DoubleType()),
    T.StructField("u", T.DoubleType()),
    T.StructField("v", T.DoubleType()),
    T.StructField("init_day", T.DateType()),
    T.StructField("yb", T.IntegerType()),
    T.StructField("xb", T.IntegerType()),
])

GRID = T.StructType([
    T.StructField("yi", T.IntegerType()),
    T.StructField("xi", T.IntegerType()),
    T.StructField("yb", T.IntegerType()),
    T.StructField("xb", T.IntegerType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

RINGS = T.ArrayType(T.ArrayType(T.StructType([
    T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
])))

PIECES = T.StructType([
    T.StructField("division_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("subtype", T.StringType()),
    T.StructField("is_land", T.BooleanType()),
    T.StructField("country", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("part", T.StringType()),
    T.StructField("rings", RINGS),
])

RUN_NOTES = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("init_ts", TS),
    T.StructField("init_day", T.DateType()),
])
