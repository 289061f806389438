"""Trend lines, densities, bootstrap bands and serial statistics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, DoubleType, StructField, StructType

from shelfcast.operators.ordered import join_keys, position
from shelfcast.operators.spectrum import squared_spectrum
from shelfcast.operators.windows import make_lags, zscore
from shelfcast.sources.scratch import stored


def ols_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and r2 of y on x; a date counts as its day number."""
    xs = F.unix_date(x) if isinstance(df.schema[x].dataType, DateType) else F.col(x)
    xs, ys = xs.cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
        F.regr_count(ys, xs).alias("n"),
    )


def kde(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian density on an even grid, bandwidth std * n^(-1/5), three bandwidths past either end.

    Equal values are counted first.  Each distinct value then adds to every grid
    point inside its own task; only one sum per grid point is shuffled.
    """
    counts = (
        df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    )
    values = df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL")
    shape = values.agg(
        F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).select("n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"), "lo", "hi")
    shape = shape.select(
        F.struct(
            "n", "h", (F.col("lo") - 3 * F.col("h")).alias("lo"), ((F.col("hi") - F.col("lo") + 6 * F.col("h")) / (grid - 1)).alias("step")
        )
    )
    spread = counts.withColumn("s", shape.scalar()).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    at = F.col("s.lo") + F.col("s.step") * F.col("i")
    z = (at - F.col("v")) / F.col("s.h")
    term = F.col("c") * F.exp(-0.5 * z * z) / (F.col("s.n") * F.col("s.h") * math.sqrt(2 * math.pi))
    return spread.groupBy("i").agg(F.max(at).alias("x"), F.sum(term).alias("density")).withColumn("i", F.col("i").cast("bigint"))


HELD_GROUPS = 256  # groups whose replicate sums a task holds before it passes them on
BLOCK_VALUES = 8192  # values of a group drawn together
HEAVY = 16  # from so many rows on a value is drawn by itself
AT_ONCE = 65_536  # drawn rows held at a time, few enough for a processor's cache


def _drawn(values: np.ndarray, rows: np.ndarray, reps: int, rng: np.random.Generator) -> np.ndarray:
    """Sum and number of the values drawn in each replicate, every row Poisson(1) times.

    The rows of a heavy value come Poisson(rows) times; the others together come Poisson(their number) times, each
    time any of them.  Both are what single rows drawn Poisson(1) times add up to.
    """
    out, heavy = np.zeros((2, reps)), rows >= HEAVY
    for value, n in zip(values[heavy], rows[heavy]):
        times = rng.poisson(n, reps)
        out += (times * value, times)
    single = np.repeat(values[~heavy], rows[~heavy])
    if len(single):
        times = rng.poisson(len(single), reps)
        out[1] += times
        step = max(1, AT_ONCE // len(single))
        for first in range(0, reps, step):
            n = times[first : first + step]
            some = np.flatnonzero(n)
            if len(some):
                picked = single.take(rng.integers(0, len(single), n.sum()))
                out[0, first + some] += np.add.reduceat(picked, (np.cumsum(n) - n)[some])
    return out


def _replicates(groups: Sequence[str], reps: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per group the sum and the number of the values drawn in each replicate, as two arrays that add up over tasks.

    Rows come in blocks of one ``_h``, which seeds their draws.
    """
    groups = list(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        open_block: list[pd.DataFrame] = []

        def passed_on() -> pd.DataFrame:
            out = pd.DataFrame(list(held), columns=groups)
            out["_s"], out["_n"] = [a[0] for a in held.values()], [a[1] for a in held.values()]
            held.clear()
            return out

        def close() -> Iterator[pd.DataFrame]:
            block = pd.concat(open_block)
            open_block.clear()
            key, seed = tuple(block[g].iloc[0] for g in groups), int(block["_h"].iloc[0]) % (1 << 64)
            if key not in held and len(held) >= HELD_GROUPS:
                yield passed_on()
            rng = np.random.Generator(np.random.SFC64(seed))
            made = _drawn(block["_v"].to_numpy(), block["_c"].to_numpy(), reps, rng)
            held[key] = held[key] + made if key in held else made

        for pdf in (b for b in batches if len(b)):
            seeds = pdf["_h"].to_numpy()
            ends = [0, *(np.flatnonzero(seeds[1:] != seeds[:-1]) + 1), len(pdf)]
            for at, end in zip(ends, ends[1:]):
                if open_block and open_block[-1]["_h"].iloc[-1] != seeds[at]:
                    yield from close()
                open_block.append(pdf.iloc[at:end])
        if open_block:
            yield from close()
        if held:
            yield passed_on()

    return run


def mean_ci(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    reps: int = 1000,
    seed: int = 0,
    level: float = 0.95,
) -> DataFrame:
    """Group mean with a bootstrap band over single rows.

    Equal values of a group are counted first.  The values of a group are dealt by hash over blocks, whose rows are
    drawn together, every row Poisson(1) times in a replicate (see ``_drawn``).  Draws are seeded by group and block,
    so the band depends neither on the partitioning nor on retries, but for the order of adding doubles.  A task
    holds one sum and one count per replicate and group, and what is shuffled are these.  Rows with a null in a
    group or in ``y`` are left out; a group of one row, or of equal values only, has a band of no width.
    """
    groups = [x, *by]
    counts = (
        df.select(*groups, F.col(y).cast("double").alias("_v"))
        .dropna(how="any")
        .groupBy(*groups, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    counts = stored(counts, "counted-values")
    per_group = counts.groupBy(*groups).agg(
        (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.ceil(F.count("_v") / BLOCK_VALUES).alias("_blocks")
    )
    per_group = stored(per_group, "groups")
    block = F.pmod(F.xxhash64("_v", F.lit("block")), F.col("_blocks"))
    dealt = (
        join_keys(counts, per_group.select(*groups, "_blocks"), groups)
        .select(*groups, block.alias("_b"), "_v", "_c")
        .repartition(*groups, "_b")
        .sortWithinPartitions(*groups, "_b", "_v")
        .select(*groups, "_v", "_c", F.xxhash64(*groups, "_b", F.lit(seed)).alias("_h"))
    )
    schema = StructType(
        [*dealt.select(*groups).schema.fields, StructField("_s", ArrayType(DoubleType())), StructField("_n", ArrayType(DoubleType()))]
    )
    drawn = dealt.mapInPandas(_replicates(groups, reps), schema).select(
        *groups, F.posexplode(F.arrays_zip("_s", "_n")).alias("_rep", "_d")
    )
    mean = F.sum("_d._s") / F.nullif(F.sum("_d._n"), F.lit(0.0))
    tail = (1 - level) / 2
    band = (
        drawn.groupBy(*groups, "_rep").agg(mean.alias("_m"))
        .groupBy(*groups).agg(F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q"))
    )
    return per_group.join(band, groups).select(
        *groups, "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high")
    )


def pacf(df: DataFrame, order: str, val: str, nlags: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Partial autocorrelation by the Yule-Walker equations, and the 95% band.

    One aggregate gives the autocorrelations of a series; the recursion from lag
    to lag folds over that short array.
    """
    by = list(by)
    z = zscore(df.select(*by, order, val).filter(F.col(val).isNotNull()), val, by, "_z")
    lagged = make_lags(z, order, "_z", nlags, by, "_z")
    power = F.nullif(F.sum(F.col("_z") * F.col("_z")), F.lit(0.0))
    series = lagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("_z") * F.col(f"_z_lag_{k}")) / power for k in range(1, nlags + 1)]).alias("r"),
    )

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    def step(state, k):
        phi, known = state["phi"], F.slice("r", F.lit(1), k - 1)
        top = F.try_element_at(F.col("r"), k) - dot(phi, F.reverse(known))
        new = top / F.nullif(F.lit(1.0) - dot(phi, known), F.lit(0.0))
        older = F.zip_with(phi, F.reverse(phi), lambda p, q: p - new * q)
        return F.struct(F.concat(older, F.array(new)).alias("phi"), F.concat(state["out"], F.array(new)).alias("out"))

    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), none.alias("out"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(nlags)), start, step)["out"]
    found = series.select(*by, "n", F.posexplode(folded).alias("i", "pacf"))
    return found.select(
        *by, (F.col("i") + 1).cast("bigint").alias("lag"), "pacf", (1.96 / F.sqrt("n")).alias("band")
    )


def periodogram(df: DataFrame, order: str, val: str, by: Sequence[str] = (), per_year: float = 365.0) -> DataFrame:
    """One-sided power spectrum of a series with its linear trend removed, frequencies per year.

    The transform is distributed, so a series may have any length.
    """
    by = list(by)
    series = position(df.select(*by, order, F.col(val).cast("double").alias("_y")).filter("_y IS NOT NULL"), order, by, "_t")
    series = stored(series, "series")
    t = F.col("_t").cast("double")
    line = F.struct(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", t).alias("b"), F.regr_intercept("_y", t).alias("a")
    ).alias("_line")
    if by:
        lined = join_keys(series, series.groupBy(*by).agg(line), by)
    else:
        lined = series.withColumn("_line", series.agg(line).scalar())
    # A series of one point has no slope; its line is the point.
    rest = F.coalesce(F.col("_y") - F.col("_line.a") - F.col("_line.b") * t, F.lit(0.0))
    keys = [f"_by_{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    squares = squared_spectrum(lined.select(*named, F.col("_line.n").alias("n"), F.col("_t").alias("t"), rest.alias("e")), keys)
    k, n = F.col("k"), F.col("n")
    sides = F.when((k == 0) | (2 * k == n), 1.0).otherwise(2.0)
    return squares.select(
        *[F.col(x).alias(c) for c, x in zip(by, keys)],
        "k",
        (k * per_year / n).alias("frequency"),
        (sides * F.col("square") / (n * n)).alias("power"),
    )
