"""Local regression over a scatter of any length.

A local line needs five weighted sums around each point.  The weight is a
polynomial in the distance on either side, so the sums over a whole run of
values follow from its moments.  The distinct values of a key are cut into
blocks, blocks are merged into a tree of nodes, and a point takes its sums from
the few nodes that tile its neighbourhood and from the values of the blocks at
its ends and around it.  Each node's moments are taken about its own centre; a node
lies within the neighbourhood, so moving them to the point stays within the unit
interval and loses no digits.

The radius that holds a share of the points comes from merging the values with
the middles of all runs of that many points, both in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from shelfcast.operators.ordered import running_max, running_totals, split_points
from shelfcast.operators.quantiles import median
from shelfcast.sources.scratch import stored

BLOCK = 512  # distinct values in a block
FAN = 32  # nodes under a node of the level above
POWERS = 12  # moments up to the weight's ninth power times the squared distance
RAW = -1  # the level of a block's values themselves
_WEIGHT = (1.0, -3.0, 3.0, -1.0)  # (1 - u^3)^3 in powers of u^3
_NUMBERS = ArrayType(DoubleType())


def _radii(values: DataFrame, by: Sequence[str], frac: float) -> DataFrame:
    """Each distinct value with its number ``_i``, its radius ``_h`` and the numbers of the outermost values within.

    ``_c`` counts the points of a value.  The run of ``k`` points nearest to a value starts at the first
    rank whose middle, of its value and the one ``k`` ranks on, is not below the value.
    """
    by = list(by)
    cuts = split_points(values, "_x")
    ranked = running_totals(values, "_x", {"_at": F.col("_c"), "_i": F.lit(1).cast("bigint")}, by, cuts)
    k = F.least(F.greatest(F.floor(frac * F.col("_at_all") + 1e-10), F.lit(1)), F.col("_at_all"))
    ranked = stored(ranked.withColumn("_k", k).withColumn("_rest", F.col("_at_all") - k), "ranked")

    none, number = F.lit(None).cast("double"), F.lit(None).cast("bigint")
    low = ranked.filter("_at <= _rest").select(
        *by, F.col("_at").alias("_pos"), F.col("_x").alias("_lo"), F.col("_i").alias("_lo_i"),
        none.alias("_hi"), number.alias("_hi_i"), F.lit(False).alias("_end"),
    )
    high = ranked.filter("_at + _c >= _k").select(
        *by, F.greatest(F.col("_at") - F.col("_k"), F.lit(-1)).alias("_pos"), none.alias("_lo"), number.alias("_lo_i"),
        F.col("_x").alias("_hi"), F.col("_i").alias("_hi_i"), F.lit(False).alias("_end"),
    )
    last = ranked.filter("_i = 0").select(
        *by, F.col("_rest").alias("_pos"), none.alias("_lo"), number.alias("_lo_i"), none.alias("_hi"), number.alias("_hi_i"),
        F.lit(True).alias("_end"),
    )
    columns = ["_lo", "_lo_i", "_hi", "_hi_i", "_end"]
    steps = low.unionByName(high).unionByName(last).groupBy(*by, "_pos").agg(*[F.max(c).alias(c) for c in columns])
    seen = {"_from": "_lo", "_from_i": "_lo_i", "_next": "_hi", "_to": "_hi", "_to_i": "_hi_i"}
    steps = running_max(steps, "_pos", {n: F.col(c) for n, c in seen.items()}, by, before=["_to", "_to_i"]).filter("_pos >= 0")
    middle = F.when(F.col("_end"), 2 * F.col("_to")).otherwise(F.col("_from") + F.col("_next"))

    # Walking down from the largest middle, the first run at or above a value is the last one met.
    ends = ["_from", "_from_i", "_to", "_to_i"]
    runs = steps.select(*by, (-middle).alias("_o"), F.lit(0).alias("_asks"), *[(-F.col(c)).alias(f"{c}_") for c in ends], none.alias("_x"), number.alias("_i"))
    asks = ranked.select(
        *by, (-2 * F.col("_x")).alias("_o"), F.lit(1).alias("_asks"),
        *[(number if c.endswith("_i") else none).alias(f"{c}_") for c in ends], "_x", "_i",
    )
    met = running_max(runs.unionByName(asks), "_o", {c: F.col(f"{c}_") for c in ends}, by, then=["_asks"])
    found = met.filter("_asks = 1").select(*by, "_x", "_i", *[(-F.col(c)).alias(c) for c in ends])
    return found.withColumn("_h", F.greatest(F.col("_x") - F.col("_from"), F.col("_to") - F.col("_x"))).drop("_from", "_to")


def _cover(first: int, last: int, levels: int, fan: int) -> list[tuple[int, int]]:
    """The fewest nodes, as (level, number), that tile the blocks from ``first`` to before ``last``."""
    out, level = [], 0
    while first < last:
        if level == levels - 1:
            return out + [(level, n) for n in range(first, last)]
        while first < last and first % fan:
            out.append((level, first))
            first += 1
        while first < last and last % fan:
            last -= 1
            out.append((level, last))
        first, last, level = first // fan, last // fan, level + 1
    return out


def _needed(levels: int):
    """What the points of a block read: blocks of values at the ends and around them, nodes in between."""

    @F.pandas_udf("array<struct<_level:int,_node:bigint>>")
    def run(block: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        out = []
        for b, lo, hi in zip(block, lows, highs):
            left, right = np.unique(np.asarray(lo) // BLOCK), np.unique(np.asarray(hi) // BLOCK)
            wanted = {(RAW, int(n)) for n in (b, *left, *right)}
            for n in left:
                wanted.update(_cover(int(n) + 1, int(b), levels, FAN))
            for n in right:
                wanted.update(_cover(int(b) + 1, int(n), levels, FAN))
            out.append([{"_level": level, "_node": node} for level, node in sorted(wanted)])
        return pd.Series(out, dtype=object)

    return run


def _moments(z: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.array([(weight * z**j).sum() for j in range(POWERS)])


def _moved(moments: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Moments of ``scale * z + shift`` from those of z, one row per pair of scale and shift."""
    own = moments[None, :] * scale[:, None] ** np.arange(POWERS)
    steps = shift[:, None] ** np.arange(POWERS)
    out = np.zeros((len(scale), POWERS))
    for m in range(POWERS):
        for j in range(m + 1):
            out[:, m] += comb(m, j) * steps[:, m - j] * own[:, j]
    return out


def _leaves(by: Sequence[str]):
    """A block's values, and the node over them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                x, one, y = (np.array([v[c] for v in r["_v"]]) for c in ("_x", "_s0", "_s1"))
                centre, half = x[0] / 2 + x[-1] / 2, (x[-1] / 2 - x[0] / 2) or 1.0
                key = {c: r[c] for c in by} | {"_node": r["_node"], "_centre": centre, "_half": half}
                z = (x - centre) / half
                rows.append(key | {"_level": RAW, "_x": x, "_one": one, "_y": y})
                rows.append(key | {"_level": 0, "_x": None, "_one": _moments(z, one), "_y": _moments(z, y)})
            yield pd.DataFrame(rows, columns=[*by, "_level", "_node", "_centre", "_half", "_x", "_one", "_y"])

    return run


def _merged(by: Sequence[str]):
    """One node from the nodes under it, ``FAN`` at most."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        centre, half = pdf["_centre"].to_numpy(), pdf["_half"].to_numpy()
        low, high = (centre - half).min(), (centre + half).max()
        mid, reach = low / 2 + high / 2, high / 2 - low / 2
        total = {}
        for c in ("_one", "_y"):
            total[c] = sum(_moved(m, np.array([s / reach]), np.array([(a - mid) / reach]))[0] for m, a, s in zip(pdf[c], centre, half))
        row = dict(zip([*by, "_node"], key)) | {"_level": int(pdf["_level"].iloc[0]) + 1, "_centre": mid, "_half": reach, "_x": None} | total
        return pd.DataFrame([row], columns=[*by, "_level", "_node", "_centre", "_half", "_x", "_one", "_y"])

    return run


def _tree(values: DataFrame, by: Sequence[str], levels: int) -> DataFrame:
    """Blocks of values and the nodes over them; ``values`` has number ``_i``, ``_x`` and the sums ``_s0``, ``_s1``."""
    by = list(by)
    kinds = [values.schema[c] for c in by]
    schema = StructType(
        [*kinds, StructField("_level", IntegerType()), StructField("_node", LongType()), StructField("_centre", DoubleType()),
         StructField("_half", DoubleType()), StructField("_x", _NUMBERS), StructField("_one", _NUMBERS), StructField("_y", _NUMBERS)]
    )
    packed = values.groupBy(*by, F.floor(F.col("_i") / BLOCK).alias("_node")).agg(
        F.sort_array(F.collect_list(F.struct("_i", "_x", "_s0", "_s1"))).alias("_v")
    )
    below = stored(packed.mapInPandas(_leaves(by), schema), "leaves")
    out = below
    for level in range(1, levels):
        nodes = below.filter(F.col("_level") == level - 1).withColumn("_node", F.floor(F.col("_node") / FAN))
        below = stored(nodes.groupBy(*by, "_node").applyInPandas(_merged(by), schema), "nodes")
        out = out.unionByName(below)
    return out


def _fitted(by: Sequence[str], levels: int):
    """Local lines at the points of one block."""

    def run(key: tuple, points: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        p, block = points.iloc[0], int(key[-1])
        x, h = np.asarray(p["_xs"]), np.asarray(p["_hs"])
        left, right = np.asarray(p["_los"]) // BLOCK, np.asarray(p["_his"]) // BLOCK
        unit = np.where(h > 0, h, 1.0)
        held = {(r["_level"], r["_node"]): r for r in sources.to_dict("records")}
        sums = np.zeros((len(x), 5))  # weights; times gap; times squared gap; times y; times gap and y; gaps in radii

        def values(node: int, who: np.ndarray) -> None:
            r = held[RAW, node]
            gap = (r["_x"][None, :] - x[who, None]) / unit[who, None]
            w = np.clip(1 - np.abs(gap) ** 3, 0, None) ** 3
            w = np.where(h[who, None] > 0, w, gap == 0)
            one, y = w * r["_one"], w * r["_y"]
            sums[who] += np.stack([one.sum(1), (one * gap).sum(1), (one * gap * gap).sum(1), y.sum(1), (y * gap).sum(1)], axis=1)

        def nodes(first: int, last: int, who: np.ndarray, side: int) -> None:
            for at in _cover(first, last, levels, FAN):
                r = held[at]
                scale, shift = r["_half"] / unit[who], (r["_centre"] - x[who]) / unit[who]
                one, y = _moved(r["_one"], scale, shift), _moved(r["_y"], scale, shift)
                for q, a in enumerate(_WEIGHT):
                    a *= side**q
                    sums[who, :3] += a * one[:, 3 * q : 3 * q + 3]
                    sums[who, 3:] += a * y[:, 3 * q : 3 * q + 2]

        for n in np.unique(np.concatenate([left, right, [block]])):
            values(n, np.flatnonzero((left == n) | (right == n) | (n == block)))
        for n in np.unique(left[left < block]):
            nodes(n + 1, block, np.flatnonzero(left == n), -1)
        for n in np.unique(right[right > block]):
            nodes(block + 1, n, np.flatnonzero(right == n), 1)
        mass, s1, s2, t0, t1 = sums.T
        with np.errstate(divide="ignore", invalid="ignore"):
            var, cov = s2 - s1 * s1 / mass, t1 - s1 * t0 / mass
            slope = np.where(var > 1e-13 * s2, cov / var, 0.0)
            fit = np.where(mass > 0, (t0 - slope * s1) / mass, np.nan)
        return pd.DataFrame({c: v for c, v in zip(by, key)} | {"_x": x, "_new": fit})

    return run


def _lines(blocks: DataFrame, tree: DataFrame, by: Sequence[str], levels: int) -> DataFrame:
    by = list(by)
    wanted = blocks.select(*by, "_b", F.explode(_needed(levels)("_b", "_los", "_his")).alias("_s"))
    # Names of their own, since both sides of the cogroup come from the blocks.
    wanted = wanted.select(*[F.col(c).alias(c) for c in (*by, "_b")], "_s._level", "_s._node")
    sources = wanted.join(tree, [*by, "_level", "_node"])
    schema = StructType([*[blocks.schema[c] for c in by], StructField("_x", DoubleType()), StructField("_new", DoubleType())])
    at = [*by, "_b"]
    return blocks.groupBy(*at).cogroup(sources.groupBy(*at)).applyInPandas(_fitted(by, levels), schema)


def lowess(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), frac: float = 2 / 3, iters: int = 3, out: str = "smooth"
) -> DataFrame:
    """Robust local regression of y on x, one scatter per key, with tricube weights and ``iters`` robust passes.

    Rows without a key, x or y are left out.  Points with the same x have the same value, so the work goes by
    distinct values, in tasks of a block each, however long a scatter is or however often a value occurs.
    Where a radius is 0 the value is the mean there; where a robust pass leaves a neighbourhood
    without weight, or the median residual of a key is 0, the value of the pass before stays.
    """
    by = list(by)
    points = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(how="any")
    points = stored(points.withColumn("_r", F.lit(1.0)).withColumn("_fit", F.lit(None).cast("double")), "scatter")
    values = stored(points.groupBy(*by, "_x").agg(F.count("*").alias("_c")), "values")
    near = stored(_radii(values, by, frac), "radii")
    numbers = near.select(*by, "_x", "_i")
    blocks = near.groupBy(*by, F.floor(F.col("_i") / BLOCK).alias("_b")).agg(
        F.sort_array(F.collect_list(F.struct("_i", "_x", "_h", "_from_i", "_to_i"))).alias("_v")
    )
    blocks = stored(blocks.select(*by, "_b", *[F.col(f"_v.{c}").alias(n) for c, n in (("_x", "_xs"), ("_h", "_hs"), ("_from_i", "_los"), ("_to_i", "_his"))]), "blocks")
    last, levels = blocks.agg(F.max("_b")).first()[0] or 0, 1
    while last >= FAN**levels:
        levels += 1
    for step in range(iters + 1):
        sums = points.groupBy(*by, "_x").agg(F.sum("_r").alias("_s0"), F.sum(F.col("_r") * F.col("_y")).alias("_s1"))
        tree = _tree(sums.join(numbers, [*by, "_x"]), by, levels)
        lines = stored(_lines(blocks, tree, by, levels), "lines")
        fit = F.coalesce(F.nanvl("_new", F.col("_fit")), "_fit")
        points = points.join(lines, [*by, "_x"]).withColumn("_fit", fit).drop("_new")
        if step < iters:
            points = stored(points.withColumn("_miss", F.abs(F.col("_y") - F.col("_fit"))), "residuals")
            middle = stored(median(points, "_miss", by, "_median"), "medians")
            points = points.join(middle, by) if by else points.withColumn("_median", middle.select("_median").scalar())
            off = F.col("_miss") / (6 * F.col("_median"))
            robust = F.when(F.col("_median") > 0, F.pow(F.greatest(1 - off * off, F.lit(0.0)), F.lit(2.0))).otherwise(F.col("_r"))
            points = points.withColumn("_r", robust).drop("_miss", "_median")
    return points.select(*by, F.col("_x").alias(x), F.col("_y").alias(y), F.col("_fit").alias(out))
