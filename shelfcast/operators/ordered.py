"""Ordered work that does not put a whole order, or a whole key, into one task.

A window over a key sends all rows of the key to one task.  That is fine for a
short series and wrong for anything longer.
Here a long order is cut at split points taken from its own quantiles.  Each
block is worked on alone and one small row per block carries what the next
blocks need.  The split points are plain numbers by the time a plan is built,
so a task that runs again puts its rows into the same blocks.

The order must be unique within a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType

from shelfcast.sources.scratch import stored

ROWS_PER_BLOCK = 200_000  # most rows of a block; tables that fill fewer are cut by the session's partitions
LEAST_ROWS = 10_000  # smaller orders stay in one block
SAMPLED = 200  # whole values looked at for each cut of a text order


def order_key(df: DataFrame, order: str) -> Column:
    """A number that never decreases along an order that is not text; ties are allowed."""
    kind = df.schema[order].dataType
    if isinstance(kind, DateType):
        return F.unix_date(order).cast("double")
    if isinstance(kind, NumericType):
        return F.col(order).cast("double")
    return F.unix_micros(F.col(order).cast("timestamp")).cast("double")


def _text_cuts(df: DataFrame, order: str, blocks: int, rows: int) -> list[str]:
    """Cuts of a text order at whole values, from a sample chosen by hash."""
    share = min(1.0, SAMPLED * (blocks + 1) / max(rows, 1))
    space = 1 << 31
    chosen = df.select(order).filter(F.col(order).isNotNull() & (F.pmod(F.xxhash64(order), F.lit(space)) < int(share * space)))
    seen = sorted((r["v"], r["n"]) for r in chosen.groupBy(F.col(order).alias("v")).agg(F.count("*").alias("n")).collect())
    total, cuts, below = sum(n for _, n in seen), [], 0
    for value, n in seen:
        if below and below * (blocks + 1) >= total * (len(cuts) + 1):
            cuts.append(value)
        below += n
    return cuts


def split_points(df: DataFrame, order: str, rows_per_block: int | None = None) -> list:
    """Where to cut the order, as values on the driver; empty when one block is enough.

    Days that are unique within each of a few keys could be left whole, but nothing tells this
    without a look at the rows, so every order is counted and cut alike.
    """
    rows = df.filter(F.col(order).isNotNull()).count()
    if rows_per_block is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows_per_block = min(ROWS_PER_BLOCK, max(LEAST_ROWS, rows // parts))
    blocks = rows // rows_per_block
    if blocks < 1:
        return []
    if isinstance(df.schema[order].dataType, StringType):
        return _text_cuts(df, order, blocks, rows)
    keys = df.select(order_key(df, order).alias("k")).filter("k IS NOT NULL")
    shares = [i / (blocks + 1) for i in range(1, blocks + 1)]
    # A finer sketch than this would not fit the driver; beyond it blocks grow a little uneven.
    return sorted(set(keys.approxQuantile("k", shares, max(0.25 / (blocks + 1), 1e-5))))


def placed(df: DataFrame, order: str, points: Sequence | None) -> tuple[DataFrame, Sequence]:
    """The table and where to cut it.

    A table whose order has to be looked at is stored first, so that counting it,
    placing the cuts, summing the blocks and the work itself do not each compute it anew.
    """
    if points is not None:
        return df, points
    df = stored(df, "ordered")
    return df, split_points(df, order)


def _above(value: Column, points: Sequence[str], first: int = 0) -> Column:
    """How many of the sorted points are at or below the value, by halving."""
    if not points:
        return F.lit(first)
    mid = len(points) // 2
    return F.when(value < points[mid], _above(value, points[:mid], first)).otherwise(
        _above(value, points[mid + 1 :], first + mid + 1)
    )


def with_block(df: DataFrame, order: str, points: Sequence) -> DataFrame:
    """Add ``_block``, the number of the block a row falls in; rows without an order come first, in block -1."""
    if not points:
        return df.withColumn("_block", F.lit(0))
    if isinstance(points[0], str):
        return df.withColumn("_block", F.when(F.col(order).isNull(), -1).otherwise(_above(F.col(order), list(points))))
    cuts = Bucketizer(
        splits=[float("-inf"), *points, float("inf")], inputCol="_key", outputCol="_cut", handleInvalid="keep"
    )
    keyed = df.withColumn("_key", order_key(df, order))
    block = F.when(F.col("_key").isNull(), -1).otherwise(F.col("_cut").cast("int"))
    return cuts.transform(keyed).withColumn("_block", block).drop("_key", "_cut")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which some may be null; a null meets a null."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, same).drop(*[f"_r_{k}" for k in keys])


def _spec(by: Sequence[str], *more: str) -> WindowSpec:
    return Window.partitionBy(*by, *more)


def running_totals(
    df: DataFrame,
    order: str,
    weights: dict[str, Column],
    by: Sequence[str] = (),
    points: Sequence | None = None,
    then: Sequence[str] = (),
) -> DataFrame:
    """Per key, the total of each weight over the rows before this one.

    Adds ``<name>`` (rows before) and ``<name>_all`` (whole key) for each weight.
    ``then`` names the columns that order rows with the same ``order``.
    """
    by = list(by)
    df, points = placed(df, order, points)
    before, whole = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.unboundedFollowing)

    def earlier(spec: WindowSpec, value) -> Column:
        return F.coalesce(F.sum(value).over(spec.rowsBetween(*before)), F.lit(0))

    if not points:
        spec = _spec(by)
        return df.withColumns(
            {n: earlier(spec.orderBy(order, *then), w) for n, w in weights.items()}
            | {f"{n}_all": F.sum(w).over(spec.rowsBetween(*whole)) for n, w in weights.items()}
        )
    blocked = with_block(df, order, points)
    sums = blocked.groupBy(*by, "_block").agg(*[F.sum(w).alias(f"_s_{n}") for n, w in weights.items()])
    spec = _spec(by)
    carried = sums.select(
        *by,
        "_block",
        *[earlier(spec.orderBy("_block"), f"_s_{n}").alias(f"_c_{n}") for n in weights],
        *[F.sum(f"_s_{n}").over(spec.rowsBetween(*whole)).alias(f"{n}_all") for n in weights],
    )
    local = _spec(by, "_block").orderBy(order, *then)
    out = blocked.withColumns({f"_l_{n}": earlier(local, w) for n, w in weights.items()})
    return (
        join_keys(out, carried, [*by, "_block"])
        .withColumns({n: F.col(f"_l_{n}") + F.col(f"_c_{n}") for n in weights})
        .drop("_block", *[f"_l_{n}" for n in weights], *[f"_c_{n}" for n in weights])
    )


def running_max(
    df: DataFrame,
    order: str,
    values: dict[str, Column],
    by: Sequence[str] = (),
    points: Sequence | None = None,
    then: Sequence[str] = (),
    before: Sequence[str] = (),
) -> DataFrame:
    """Per key, the largest of each value up to this row, or over the rows before it for the names in ``before``.

    Nulls are passed over.  For a value that never decreases along the order this is the last one seen.
    ``then`` names the columns that order rows with the same ``order``.
    """
    by = list(by)
    df, points = placed(df, order, points)

    def seen(spec: WindowSpec) -> dict[str, Column]:
        spec = spec.orderBy(order, *then)
        return {n: F.max(v).over(spec.rowsBetween(Window.unboundedPreceding, -int(n in before))) for n, v in values.items()}

    if not points:
        return df.withColumns(seen(_spec(by)))
    blocked = with_block(df, order, points)
    tops = blocked.groupBy(*by, "_block").agg(*[F.max(v).alias(f"_s_{n}") for n, v in values.items()])
    earlier = _spec(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, "_block", *[F.max(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in values])
    out = blocked.withColumns({f"_l_{n}": v for n, v in seen(_spec(by, "_block")).items()})
    return (
        join_keys(out, carried, [*by, "_block"])
        .withColumns({n: F.greatest(f"_l_{n}", f"_c_{n}") for n in values})
        .drop("_block", *[f"_l_{n}" for n in values], *[f"_c_{n}" for n in values])
    )


def position(
    df: DataFrame, order: str, by: Sequence[str] = (), name: str = "t", points: Sequence | None = None
) -> DataFrame:
    """Row number from 0 along the order, per key."""
    return running_totals(df, order, {name: F.lit(1).cast("bigint")}, by, points).drop(f"{name}_all")


def over_rows(
    df: DataFrame,
    order: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    reach: int,
    by: Sequence[str] = (),
    points: Sequence | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Window columns that look at most ``reach`` rows to either side.

    A long order is numbered and cut into equal chunks; the rows within reach of
    a border are copied into the neighbouring chunk, and the copies are dropped
    after the window.
    """
    by = list(by)
    df, points = placed(df, order, points)
    if not points:
        return df.withColumns(columns(_spec(by).orderBy(order)))
    size = max(rows_per_block, 2 * reach, 1)
    first, last = F.floor((F.col("_t") - reach) / size), F.floor((F.col("_t") + reach) / size)
    numbered = position(df, order, by, "_t", points)
    copied = numbered.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), last)))
    done = copied.withColumns(columns(_spec(by, "_chunk").orderBy("_t")))
    return done.filter(F.col("_chunk") == F.floor(F.col("_t") / size)).drop("_t", "_chunk")


def neighbours(
    df: DataFrame, order: str, val: str, by: Sequence[str] = (), points: Sequence | None = None
) -> DataFrame:
    """The nearest known value at or before and at or after each row.

    Adds ``_t`` (position), ``_prev`` and ``_next`` (structs of position ``t`` and value ``v``).
    """
    by = list(by)
    df, points = placed(df, order, points)
    known = F.when(F.col(val).isNotNull(), F.struct(F.col("_t").alias("t"), F.col(val).alias("v")))

    # Frames that grow from their first row are updated row by row.  Frames that
    # shrink towards the last row would be computed anew for each row, so the
    # next known value is the last one seen when walking backwards.
    def both(spec: WindowSpec) -> dict[str, Column]:
        seen = (Window.unboundedPreceding, Window.currentRow)
        return {
            "_prev": F.last(known, True).over(spec.orderBy("_t").rowsBetween(*seen)),
            "_next": F.last(known, True).over(spec.orderBy(F.desc("_t")).rowsBetween(*seen)),
        }

    numbered = position(df, order, by, "_t", points)
    if not points:
        return numbered.withColumns(both(_spec(by)))
    blocked = with_block(numbered, order, points)
    ends = blocked.groupBy(*by, "_block").agg(F.min(known).alias("_lo"), F.max(known).alias("_hi"))
    spec, seen = _spec(by), (Window.unboundedPreceding, -1)
    carried = ends.select(
        *by,
        "_block",
        F.last("_hi", True).over(spec.orderBy("_block").rowsBetween(*seen)).alias("_before"),
        F.last("_lo", True).over(spec.orderBy(F.desc("_block")).rowsBetween(*seen)).alias("_after"),
    )
    return (
        join_keys(blocked.withColumns(both(_spec(by, "_block"))), carried, [*by, "_block"])
        .withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
        .drop("_block", "_before", "_after")
    )
