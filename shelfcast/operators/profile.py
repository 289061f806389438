"""Counts, summaries, distributions and correlation of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.ordered import join_keys, running_totals
from shelfcast.operators.quantiles import mode, quantiles
from shelfcast.sources.scratch import stored


def group_agg(df: DataFrame, by: str | Sequence[str], *aggs: Column) -> DataFrame:
    """Grouped aggregate without the rows that lack a key."""
    by = [by] if isinstance(by, str) else list(by)
    return df.dropna(how="any", subset=by).groupBy(*by).agg(*aggs)


def pivot_mean(df: DataFrame, rows: str, cols: str, val: str, col_values: Sequence, row_order: Sequence[str]) -> DataFrame:
    """Mean of ``val`` as a table, rows in the given order."""
    wide = df.groupBy(rows).pivot(cols, list(col_values)).agg(F.avg(val))
    return wide.orderBy(F.array_position(F.lit(list(row_order)), F.col(rows)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    counts = group_agg(df, col, F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(col))


def share(df: DataFrame, predicate: Column, out: str = "percent") -> DataFrame:
    """Percent of rows that meet a predicate."""
    return df.agg((100 * F.avg(F.coalesce(predicate, F.lit(False)).cast("double"))).alias(out))


def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls, percent) from one pass over the table."""
    cols = list(cols or df.columns)
    rows = [
        F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n"))
        for c in cols
    ]
    long = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return long.select("column", "nulls", (F.lit(100.0) * F.col("nulls") / F.nullif("n", F.lit(0))).alias("percent"))


def duplicate_rows(df: DataFrame, out: str = "duplicates") -> DataFrame:
    """Rows equal to an earlier one, nulls being equal."""
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(out))


def column_summary(df: DataFrame) -> DataFrame:
    """Per column: type, non-null, distinct and null counts, and the table's duplicate rows.

    Values are counted in long form, so the distinct counts of all columns take
    one narrow shuffle of pre-aggregated counts.
    """
    texts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns]
    cells = df.select(F.explode(F.array(*texts)).alias("c")).select("c.*")
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    per_column = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("instances"),
        F.count("value").alias("unique"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("sum_null"),
    )
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return per_column.select(
        "column",
        F.try_element_at(kinds, F.col("column")).alias("dtype"),
        "instances",
        "unique",
        "sum_null",
        duplicate_rows(df).scalar().alias("duplicates"),
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quarts = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"])
    return basic.join(quarts, "column", "left")


def non_null_counts(df: DataFrame) -> DataFrame:
    """(column, dtype, rows, non_null) of a table."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(kind).alias("dtype"),
            F.count(F.lit(1)).alias("rows"),
            F.count(F.col(c)).alias("non_null"),
        )
        for c, kind in df.dtypes
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


COMPILED_PAIRS = 16  # six sums each, of the 100 that an aggregate may have to be compiled


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over the rows where both are known.

    The result is long: (a, b, corr).  ``COMPILED_PAIRS`` are taken in one pass; Spark does not compile an aggregate of
    many more, and a slow one costs more than to store the columns and to read them once for each part of the pairs.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    if len(pairs) > COMPILED_PAIRS:
        df = stored(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), "columns")
    parts = [_correlations(df, pairs[i : i + COMPILED_PAIRS]) for i in range(0, len(pairs), COMPILED_PAIRS)]
    return reduce(DataFrame.unionByName, parts)


def _correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    rows = []
    for a, b in pairs:
        r = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("corr")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r.alias("corr")))
    return df.agg(F.array(*rows).alias("p")).select(F.explode("p").alias("p")).select("p.*")


HEAVY_VALUES = 1000  # a value is heavy if it holds more than this part of the rows, so there are fewer of them


def _average_ranks(pairs: DataFrame, col: str, points) -> DataFrame:
    counts = pairs.groupBy(col).agg(F.sum("_n").alias("_c"))
    ranked = running_totals(counts, col, {"_below": F.col("_c")}, (), points)
    return ranked.select(col, "_c", (F.col("_below") + (F.col("_c") + 1) / 2).alias(f"_rank_{col}"))


def _with_ranks(pairs: DataFrame, ranks: DataFrame, col: str, rows: int) -> DataFrame:
    """Add the rank; heavy values get theirs from a broadcast of fewer than ``HEAVY_VALUES`` rows, so none is shuffled."""
    rank = f"_rank_{col}"
    is_heavy = F.col("_c") * HEAVY_VALUES > rows
    heavy, light = (ranks.filter(c).drop("_c") for c in (is_heavy, ~is_heavy))
    marked = pairs.join(F.broadcast(heavy), col, "left")
    rest = marked.filter(F.col(rank).isNull()).drop(rank).join(light, col)
    return marked.filter(F.col(rank).isNotNull()).unionByName(rest)


def corr_spearman(df: DataFrame, a: str, b: str, points: Sequence[float] | None = None) -> DataFrame:
    """Correlation of average ranks.

    Equal pairs are counted first; ranks come from running counts over distinct
    values, so no task sorts the whole column.  A value that holds many rows meets
    its rank without moving them.
    """
    pairs = stored(df.dropna(how="any", subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("_n")), "pairs")
    rows = pairs.agg(F.sum("_n")).first()[0] or 0
    ranked = pairs
    for col in (a, b):
        ranked = _with_ranks(ranked, stored(_average_ranks(pairs, col, points), "ranks"), col, rows)
    x, y, n = F.col(f"_rank_{a}"), F.col(f"_rank_{b}"), F.col("_n")
    # Every rank column has mean (N + 1) / 2.
    mid = (rows + 1) / 2
    centred = ranked.select((x - mid).alias("x"), (y - mid).alias("y"), n.cast("double").alias("n"))
    sums = centred.agg(F.sum(F.expr("n*x*y")).alias("xy"), F.sum(F.expr("n*x*x")).alias("xx"), F.sum(F.expr("n*y*y")).alias("yy"))
    return sums.select((F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("corr"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Rows per equal-width bin; the last bin takes the maximum.  Bins count from 1, empty ones included."""
    values = df.select(F.col(col).cast("double").alias("v")).filter("v IS NOT NULL")
    span = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s"))
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    inside = F.when(width == 0, F.lit(1)).otherwise(F.least(F.floor((F.col("v") - F.col("s.lo")) / F.nullif(width, F.lit(0.0))) + 1, F.lit(bins)))
    counts = values.withColumn("s", span.scalar()).groupBy(inside.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = span.select("s", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.col("s.lo") + width * (F.col("bin") - 1)).alias("lo"),
        (F.col("s.lo") + width * F.col("bin")).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whisker ends within 1.5 box lengths, outliers and the mean."""
    by = list(by)
    quarts = quantiles(df, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    if by:
        marked = join_keys(df.select(*by, col), stored(quarts, "quartiles"), by)
    else:
        marked = df.select(col).withColumn("q", quarts.select(F.struct("*")).scalar()).select(col, "q.*")
    inside = F.col(col).between(F.col("q1") - reach, F.col("q3") + reach)
    return marked.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(col))).alias("low"),
        F.max(F.when(inside, F.col(col))).alias("high"),
        F.count_if(~inside).alias("outliers"),
        F.avg(col).alias("mean"),
    )


def impute(
    df: DataFrame,
    modes: Sequence[str] = (),
    medians: Sequence[str] = (),
    floor_medians: Sequence[str] = (),
    constants: dict | None = None,
) -> DataFrame:
    """Fill nulls by the column's mode, median, floored median, or a constant.

    The fill values are subqueries of the same plan; nothing comes to the driver.
    Each reads one column of ``df``, so pass a table that is stored in columns
    rather than a long join.
    """
    fills = {c: F.coalesce(F.col(c), mode(df, c).scalar()) for c in modes}
    wanted = [*medians, *floor_medians]
    if wanted:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in wanted]).unpivot([], wanted, "column", "value")
        found = quantiles(long, "value", {"median": 0.5}, ["column"])
        for c in wanted:
            middle = found.filter(F.col("column") == c).select("median").scalar()
            fills[c] = F.coalesce(F.col(c), F.floor(middle).cast("double") if c in floor_medians else middle)
    for c, v in (constants or {}).items():
        fills[c] = F.coalesce(F.col(c), F.lit(v))
    return df.withColumns(fills)
