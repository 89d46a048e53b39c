"""Sustained heat: a first-order recurrence per cell through the hours that have data.

    L = (a L' + (1 - a) e) g       a decay, e vented excess over a threshold, g what rain leaves

Rows without a heat index are left out, which freezes the state: the step is a row, not an hour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from hexheat import schemas as S
from hexheat.functions import (
    decay, dequantise_hi, flush_factor, or_zero, quantise_load, unpack_rain, unpack_wind, vented_excess,
)

DEFAULTS = {
    "half_life": S.HALF_LIFE_H, "threshold": S.THRESHOLD_C, "flush": S.RAIN_FLUSH, "vent": S.WIND_VENT,
}
PARAMETERS = tuple(DEFAULTS)


def present(film: DataFrame, quantised: bool = True) -> DataFrame:
    """Rows with a heat index, in the columns the recurrence reads."""
    code = "hi_q" if quantised else "hi"
    return film.where(F.col(code).isNotNull()).select("cell", "t", code, *(["wx_q"] if quantised else ["ws", "mm"]))


def drivers(rows: DataFrame, quantised: bool = True) -> DataFrame:
    """What drives the recurrence: `cell, t, hi, ws, mm`.

    By default from the film's codes, as the published product does; `quantised=False` takes
    the raw columns of a film that kept `hi, ws, mm`.
    """
    if quantised:
        values = {
            "hi": dequantise_hi(F.col("hi_q")), "ws": unpack_wind(F.col("wx_q")), "mm": unpack_rain(F.col("wx_q")),
        }
    else:
        values = {"hi": F.col("hi").cast("double"), **{c: or_zero(F.col(c).cast("double")) for c in ("ws", "mm")}}
    return rows.select("cell", "t", *[v.alias(k) for k, v in values.items()])


def sustained_heat(film: DataFrame, quantised: bool = True, **params: float) -> DataFrame:
    """`cell, t, l, load_q` for one set of parameters, with the codes `hi_q, wx_q` it came from."""
    return sweep(film, [{**DEFAULTS, **params}], quantised).drop("param")


MOST_PARAMETERS = 100_000


def parameter_rows(params: DataFrame | list[dict]) -> list[tuple]:
    """(param, half_life, threshold, flush, vent) of a parameter table or list.

    A table has its own `param` numbers; columns that it lacks, and NULLs, are the defaults. Every
    task holds all rows, so a table of more than MOST_PARAMETERS is an error.
    """
    if isinstance(params, DataFrame):
        held = params.select("param", *[c for c in PARAMETERS if c in params.columns]).limit(MOST_PARAMETERS + 1).collect()
        if len(held) > MOST_PARAMETERS:
            raise ValueError("too many parameter rows for one sweep; split the table")
        given = [(r.param, {k: v for k, v in r.asDict().items() if v is not None}) for r in held]
    else:
        given = list(enumerate(params))
    return [(int(i), *[float({**DEFAULTS, **p}[name]) for name in PARAMETERS]) for i, p in given]


def _scanned(film: DataFrame, params: DataFrame | list[dict], quantised: bool, gather: str, columns: str) -> DataFrame:
    ordered = present(film, quantised).repartition("cell").sortWithinPartitions("t")
    if not quantised:
        ordered = drivers(ordered, quantised=False)
    scanner = _scanner(
        parameter_rows(params), quantised, (S.HI_STEPS_PER_C, S.HI_OFFSET_C), S.FULL_VENT_MS, S.FULL_FLUSH_MM,
        gather, (S.LOAD_STEPS_PER_C, S.TOP_CODE),
    )
    return ordered.mapInArrow(scanner, f"param int, {columns}")


def sweep(film: DataFrame, params: DataFrame | list[dict], quantised: bool = True) -> DataFrame:
    """`param, cell, t, l, load_q`, and the film's codes, for every row of `params`.

    `params` is a table with a number `param` and any of the four parameters, or a list, numbered
    from 0. The film is shuffled and sorted once whatever the number of parameter rows: cells are
    spread by hash, and each partition is put in time order, a sort on one number. Rows then
    stream past, and all that is kept is one number per (parameter row, cell of the partition),
    however long the series is.
    """
    t_type = film.schema["t"].dataType.simpleString()
    codes = ", hi_q smallint, wx_q smallint" if quantised else ""
    swept = _scanned(film, params, quantised, "rows", f"cell bigint, t {t_type}, l double{codes}")
    return swept.withColumn("load_q", quantise_load(F.col("l")))


def sweep_means(film: DataFrame, params: DataFrame | list[dict], quantised: bool = True) -> DataFrame:
    """`param, t, mean_load, n_cells`: what `load_means` gives for a sweep, summed where the rows are made.

    A batch sends a row for each parameter row and hour that it holds, and never one for each cell.
    """
    t_type = film.schema["t"].dataType.simpleString()
    sums = _scanned(film, params, quantised, "means", f"t {t_type}, s double, n bigint")
    total = F.sum("n")
    return sums.groupBy("param", "t").agg((F.sum("s") / total).alias("mean_load"), total.alias("n_cells"))


def sweep_histogram(film: DataFrame, params: DataFrame | list[dict], quantised: bool = True) -> DataFrame:
    """`param, load_q, n`: the load histogram of every row of `params`, counted where the rows are made."""
    counts = _scanned(film, params, quantised, "histogram", "load_q smallint, n bigint")
    return counts.groupBy("param", "load_q").agg(F.sum("n").alias("n"))


def _scanner(
    params: list[tuple], quantised: bool, hi_code: tuple[float, float], full_vent: float, full_flush: float,
    gather: str, load_code: tuple[float, int],
) -> Callable[[Iterator], Iterator]:
    """The recurrence over Arrow batches in time order, as rows, as sums by hour, or as counts by load code.

    Every step is an affine map L -> A L + B. Maps compose, so a batch, its rows gathered by
    cell, is solved by doubling: after k rounds each row holds the composition of its last 2^k
    steps. A cell's first row starts from the carried state and has A = 0, which keeps cells
    apart.

    The function is self-contained, so workers need numpy and pyarrow but not this package.
    """

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def columns(batch: pa.RecordBatch, order: np.ndarray) -> list[np.ndarray]:
            if not quantised:
                return [batch.column(c).to_numpy()[order] for c in ("hi", "ws", "mm")]
            hi = batch.column("hi_q").to_numpy()[order] / hi_code[0] - hi_code[1]
            wx = batch.column("wx_q").to_numpy()[order]
            return [hi, (wx >> 4).astype(float), (wx & 15) / 2.0]

        known, carried = np.empty(0, dtype=np.int64), np.empty((len(params), 0))
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            cell = batch.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            ends = np.append(starts[1:], n) - 1
            longest = int((ends - starts).max()) + 1
            seen = np.union1d(known, cell[starts])
            if len(seen) > len(known):
                wider = np.zeros((len(params), len(seen)))
                wider[:, np.searchsorted(seen, known)] = carried
                known, carried = seen, wider
            place = np.searchsorted(known, cell[starts])
            hi, ws, mm = columns(batch, order)
            times = batch.column("t").take(pa.array(order))
            if gather == "rows":
                cells, kept = pa.array(cell), ["hi_q", "wx_q"] if quantised else []
                codes = [batch.column(c).take(pa.array(order)) for c in kept]
            elif gather == "means":
                hours, hour = np.unique(times.cast(pa.int64()).to_numpy(), return_inverse=True)
                hours, per_hour = pa.array(hours).cast(times.type), np.bincount(hour)
            for number, (param, half_life, threshold, flush, vent) in enumerate(params):
                a = 2.0 ** (-1.0 / half_life)
                excess = np.maximum(hi - threshold, 0.0) * np.maximum(1.0 - vent * ws / full_vent, 0.0)
                left = 1.0 - flush * np.minimum(mm / full_flush, 1.0)
                A, B = a * left, (1.0 - a) * excess * left
                B[starts] += A[starts] * carried[number, place]
                A[starts] = 0.0
                step = 1
                while step < longest:
                    B[step:] += A[step:] * B[:-step]
                    A[step:] = A[step:] * A[:-step]
                    step *= 2
                carried[number, place] = B[ends]
                if gather == "rows":
                    names, out = ["cell", "t", "l", *kept], [cells, times, pa.array(B), *codes]
                elif gather == "means":
                    names, out = ["t", "s", "n"], [hours, pa.array(np.bincount(hour, B)), pa.array(per_hour)]
                else:
                    code, count = np.unique(np.minimum(np.floor(B * load_code[0] + 0.5), load_code[1]), return_counts=True)
                    names, out = ["load_q", "n"], [pa.array(code.astype(np.int16)), pa.array(count)]
                number_of = pa.array(np.full(len(out[0]), param, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([number_of, *out], names=["param", *names])

    return scan


def sweep_by_blocks(film: DataFrame, params: list[dict], quantised: bool = True, block_hours: int = 96) -> DataFrame:
    """The same answer from built-in expressions only, for clusters without Python workers.

    A cell's hours are cut into blocks; a block's steps compose into one affine map. A cell's maps,
    one a block, are gathered once and walked once for the state each block starts from; the block
    is then replayed from there. So the work grows with the length of a series and not its square.
    """
    hour = F.floor(F.unix_seconds(F.col("t").cast("timestamp")) / 3600)
    steps = (
        drivers(present(film, quantised), quantised).withColumn("block", F.floor(hour / block_hours))
        .repartition("cell")
        .groupBy("cell", "block").agg(F.sort_array(F.collect_list(F.struct("t", "hi", "ws", "mm"))).alias("raw"))
    )
    sets = F.array(*[
        F.struct(F.lit(i).alias("param"), *[F.lit(float({**DEFAULTS, **p}[name])).alias(name) for name in PARAMETERS])
        for i, p in enumerate(params)
    ])
    each = steps.select("cell", "block", "raw", F.explode(sets).alias("p")).select(
        "cell", "block", "p.param", decay(F.col("p.half_life")).alias("a"),
        F.transform("raw", lambda s: F.struct(
            s["t"].alias("t"),
            vented_excess(s["hi"], F.col("p.threshold"), s["ws"], F.col("p.vent")).alias("e"),
            flush_factor(s["mm"], F.col("p.flush")).alias("g"),
        )).alias("steps"),
    )

    def replay(start: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            level = (F.col("a") * acc["l"] + (1.0 - F.col("a")) * s["e"]) * s["g"]
            return F.struct(level.alias("l"), F.concat(acc["ls"], F.array(level)).alias("ls"))

        seed = F.struct(start.alias("l"), F.array().cast("array<double>").alias("ls"))
        return F.aggregate("steps", seed, step, lambda acc: acc["ls"])

    scale = F.aggregate("steps", F.lit(1.0), lambda acc, s: acc * F.col("a") * s["g"])
    shift = F.aggregate(
        "steps", F.lit(0.0), lambda acc, s: (F.col("a") * acc + (1.0 - F.col("a")) * s["e"]) * s["g"]
    )
    maps = each.groupBy("cell", "param").agg(
        F.sort_array(F.collect_list(F.struct("block", scale.alias("mul"), shift.alias("add"), "steps", "a"))).alias("blocks")
    )

    def onward(acc: Column, m: Column) -> Column:
        """The level after the block, and the levels before each block so far."""
        return F.struct((m["mul"] * acc["l"] + m["add"]).alias("l"), F.concat(acc["ls"], F.array(acc["l"])).alias("ls"))

    seed = F.struct(F.lit(0.0).alias("l"), F.array().cast("array<double>").alias("ls"))
    starts = F.aggregate("blocks", seed, onward, lambda acc: acc["ls"])
    solved = maps.select("cell", "param", F.explode(F.arrays_zip("blocks", starts.alias("starts"))).alias("b")).select(
        "cell", "param", F.col("b.blocks.steps").alias("steps"), F.col("b.blocks.a").alias("a"), F.col("b.starts").alias("start")
    ).withColumn("levels", replay(F.col("start")))
    zipped = F.explode(F.arrays_zip(F.col("steps.t").alias("t"), F.col("levels").alias("l")))
    return solved.select("param", "cell", zipped.alias("row")).select(
        "param", "cell", "row.t", "row.l"
    ).withColumn("load_q", quantise_load(F.col("l")))


def load_means(load: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the unquantised load over the cells with data, hour by hour."""
    return load.groupBy(*(by or []), "t").agg(*means(), F.count("*").alias("n_cells"))


def means() -> list[Column]:
    """Mean of the unquantised load for a group of rows."""
    return [F.avg("l").alias("mean_load")]


def load_histogram(load: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows per load code."""
    return load.groupBy(*(by or []), "load_q").agg(F.count("*").alias("n"))


RAMP_SHARE = 0.98


def load_ramp_top(load: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Top of the load ramp in degrees: where 98 % of the non-zero codes lie, at least 1.

    From the histogram, so at most 254 rows a group are ordered.
    """
    return ramp_top(load_histogram(load, by), by)


def ramp_top(histogram: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or []
    upto = Window.partitionBy(*keys).orderBy("load_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = histogram.withColumn(
        "counted", F.when(F.col("load_q").between(1, S.TOP_CODE), F.col("n")).otherwise(0)
    )
    walked = bins.withColumns({
        "upto": F.sum("counted").over(upto),
        "total": F.sum("counted").over(Window.partitionBy(*keys)),
    })
    reached = F.min(F.when(
        (F.col("counted") > 0) & (F.col("upto") >= F.col("total") * RAMP_SHARE), F.col("load_q")
    ))
    grouped = walked.groupBy(*keys) if keys else walked
    return grouped.agg(F.greatest(F.lit(1.0), F.coalesce(reached / S.LOAD_STEPS_PER_C, F.lit(1.0))).alias("top"))
