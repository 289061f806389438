"""Boosted trees on binned rows.

Trees look at a feature only through its bins.  So the rows are binned first and rows with equal bins become one
cell with a weight and a mean target: for squared loss every split gains the same as on the rows themselves.
The number of cells is bounded by the product of the bins, not by the rows.  All rows are read three times by
distributed passes (values, quantiles, cells); what is fitted is the table of cells.

Up to ``MOST_CELLS`` cells a model is grown in one task from that table, as normal equations are solved from
their sums, and the models of a cross-validation are grown side by side, one task each.  A larger table is
fitted by Spark ML's distributed trees, one job per level, with the same bins, weights and loss.

A feature with few values has one bin for each; any other is cut at its quantiles.  A missing value has a bin of
its own, above all others.  Rows without a target are left out; without rows there is no model, which is an error.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.sources.scratch import ensure_checkpoint_dir, stored

BINS = 32
MOST_CELLS = 1_000_000
RATE = 0.1  # weight of every tree but the first
QUANTILE_ERROR = 1e-3


@dataclass
class Binning:
    """Where each feature is cut."""

    features: list[str]
    cuts: list[list[float]]

    def columns(self) -> list[str]:
        return [f"_bin_{i}" for i in range(len(self.features))]

    def place(self, df: DataFrame) -> DataFrame:
        """Add the bin of each feature as a number from 0."""
        raw = [f"_raw_{i}" for i in range(len(self.features))]
        missing = F.lit(float("nan"))
        doubles = df.withColumns({r: F.coalesce(F.col(f).cast("double"), missing) for r, f in zip(raw, self.features)})
        ends = [[float("-inf"), *cuts, float("inf")] for cuts in self.cuts]
        cutter = Bucketizer(splitsArray=ends, inputCols=raw, outputCols=self.columns(), handleInvalid="keep")
        return cutter.transform(doubles).drop(*raw)


def binning(df: DataFrame, features: Sequence[str], bins: int = BINS) -> Binning:
    """Cuts between the values of a feature that has few, else at quantiles; at most ``bins`` bins each.

    One pass counts values, one takes the quantiles of long features, and the values of short ones are collected.
    """
    features = list(features)
    known = {f: F.nullif(F.col(f).cast("double"), F.lit(float("nan"))) for f in features}
    doubles = df.select(*[col.alias(f) for f, col in known.items()])
    about = doubles.agg(*[F.approx_count_distinct(f, 0.05).alias(f) for f in features]).first()
    values = {}
    for f in (f for f in features if about[f] <= 2 * bins):
        seen = sorted(r[0] for r in doubles.select(f).filter(F.col(f).isNotNull()).distinct().collect())
        if len(seen) <= bins:
            values[f] = seen
    long = [f for f in features if f not in values]
    shares = [i / bins for i in range(1, bins)]
    quantiles = dict(zip(long, doubles.approxQuantile(long, shares, QUANTILE_ERROR))) if long else {}
    cuts = []
    for f in features:
        if f in values:
            found = [a + (b - a) / 2 for a, b in zip(values[f], values[f][1:])]
        else:
            found = sorted(set(quantiles[f]))
        cuts.append(found or [0.0])
    return Binning(features, cuts)


# Trees in a task.  A tree is an array of nodes: feature (-1 at a leaf), bin, left child, value.


def _grow(bins: np.ndarray, weight: np.ndarray, target: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, ...]:
    """One tree on cells, level by level, from the sums per node, feature and bin; and its value for each cell.

    A cell goes right when its bin is above the node's; of equally good splits the first feature and bin count.
    """
    count = bins.shape[1]
    feature, cut, child, value = [], [], [], []
    node = np.zeros(len(bins), np.int64)  # of each cell, numbered within the level
    rows, out = np.arange(len(bins)), np.zeros(len(bins))
    moment = weight * target
    first, size = 0, 1
    for level in range(depth + 1):
        w_all = np.bincount(node, weight[rows], size)
        s_all = np.bincount(node, moment[rows], size)
        mean = s_all / w_all
        value += mean.tolist()
        if level < depth:
            best, where = np.zeros(size), np.full(size, -1)
            floor = 1e-12 * np.bincount(node, weight[rows] * target[rows] ** 2, size)
            for f in range(count):
                key = node * width + bins[rows, f]
                w = np.cumsum(np.bincount(key, weight[rows], size * width).reshape(size, width), axis=1)[:, :-1]
                s = np.cumsum(np.bincount(key, moment[rows], size * width).reshape(size, width), axis=1)[:, :-1]
                w_right, s_right = w_all[:, None] - w, s_all[:, None] - s
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = s * s / w + s_right * s_right / w_right - (s_all * mean)[:, None]
                gain[~((w > 0.5) & (w_right > 0.5))] = -1.0  # a side without rows
                top = gain.argmax(axis=1)
                gained = gain[np.arange(size), top]
                better = gained > np.maximum(best, floor)
                best[better], where[better] = gained[better], (f * width + top)[better]
        else:
            where = np.full(size, -1)
        split = where >= 0
        feature += np.where(split, where // width, -1).tolist()
        cut += np.where(split, where % width, 0).tolist()
        rank = np.cumsum(split) - 1
        child += np.where(split, first + size + 2 * rank, -1).tolist()
        done = ~split[node]
        out[rows[done]] = mean[node[done]]
        rows, node = rows[~done], node[~done]
        if not len(rows):
            break
        at = where[node]
        node = 2 * rank[node] + (bins[rows, at // width] > at % width)
        first, size = first + size, 2 * int(split.sum())
    arrays = (np.array(feature, np.int16), np.array(cut, np.int16), np.array(child, np.int32), np.array(value))
    return arrays, out


def _walk(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    feature, cut, child, value = tree
    at, moving = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(moving):
        moving = moving[feature[at[moving]] >= 0]
        here = at[moving]
        at[moving] = child[here] + (bins[moving, feature[here]] > cut[here])
    return value[at]


def grow_trees(bins: np.ndarray, weight: np.ndarray, target: np.ndarray, rounds: int, depth: int, width: int) -> list:
    """(weight, tree) for each round: the first on the target, the others on the gradient of the squared loss."""
    trees, fitted = [], np.zeros(len(bins))
    for i in range(rounds):
        tree, values = _grow(bins, weight, 2 * (target - fitted) if i else target, depth, width)
        rate = RATE if i else 1.0
        trees.append((rate, tree))
        fitted += rate * values
    return trees


def predict_trees(trees: list, bins: np.ndarray) -> np.ndarray:
    """Equal vectors are looked at once."""
    if not len(bins):
        return np.zeros(0)
    different, back = np.unique(bins, axis=0, return_inverse=True)
    return sum(rate * _walk(tree, different) for rate, tree in trees)[back.ravel()]


def _bins_of(columns: Sequence[str], table: pa.Table | pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(table[c]).astype(np.int16) for c in columns], axis=1)


@dataclass
class Boosted:
    """A fitted model; it bins what it is given and adds ``out``."""

    bins: Binning
    trees: list | GBTRegressionModel
    out: str

    def transform(self, df: DataFrame) -> DataFrame:
        placed, columns = self.bins.place(df), self.bins.columns()
        if isinstance(self.trees, GBTRegressionModel):
            return self.trees.transform(_assembled(placed, columns)).drop("_vector", *columns)
        held = df.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(predict_trees(held.value, _bins_of(range(len(batch)), list(batch))))

        return placed.withColumn(self.out, predict(*columns)).drop(*columns)


def _assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The bins as the vector ``_vector``; numbers in order, not the categories that the cutting marks them as."""
    df = df.withColumns({c: F.col(c).alias(c, metadata={}) for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol="_vector").transform(df)


def _distributed(cells: DataFrame, columns: Sequence[str], rounds: int, depth: int, seed: int, out: str) -> GBTRegressionModel:
    ensure_checkpoint_dir(cells.sparkSession)
    trees = GBTRegressor(
        featuresCol="_vector", labelCol="_target", weightCol="_weight", predictionCol=out,
        maxIter=rounds, maxDepth=depth, maxBins=BINS + 2, stepSize=RATE, seed=seed,
    )
    return trees.fit(_assembled(cells, columns))


def cells(df: DataFrame, bins: Binning, y: str) -> DataFrame:
    """One row per different vector of bins with its weight and mean target."""
    known = bins.place(df).filter(F.col(y).isNotNull()).groupBy(*bins.columns())
    return known.agg(F.count(F.lit(1)).cast("double").alias("_weight"), F.avg(F.col(y).cast("double")).alias("_target"))


def fit_boosted(
    df: DataFrame, features: Sequence[str], y: str, rounds: int, depth: int, seed: int = 42, out: str = "predicted"
) -> Boosted:
    """Boosted trees for squared loss.  Pass a stored table: the cuts and the cells read it."""
    bins = binning(df, features)
    columns, table = bins.columns(), stored(cells(df, bins, y), "cells")
    if table.count() > MOST_CELLS:
        return Boosted(bins, _distributed(table, columns, rounds, depth, seed, out), out)

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in columns])  # sums in one order, whatever the tasks before
        found = _bins_of(columns, group)
        weight, target = (group.column(c).to_numpy() for c in ("_weight", "_target"))
        return pa.table({"trees": [pickle.dumps(grow_trees(found, weight, target, rounds, depth, BINS + 2))]})

    made = table.groupBy().applyInArrow(fit, "trees binary").first()
    if made is None:
        raise ValueError("no rows with a target to fit on")
    return Boosted(bins, pickle.loads(made["trees"]), out)


def fold_cells(df: DataFrame, bins: Binning, y: str, fold: str) -> DataFrame:
    """(fold, vector): the count, mean and squared deviations of the target of the fold's rows."""
    target = F.col(y).cast("double")
    return (
        bins.place(df)
        .filter(F.col(y).isNotNull() & F.col(fold).isNotNull())
        .groupBy(F.col(fold).cast("int").alias("fold"), *bins.columns())
        .agg(
            F.count(F.lit(1)).cast("double").alias("_n"),
            F.avg(target).alias("_mean"),
            (F.var_pop(target) * F.count(F.lit(1))).alias("_dev"),
        )
    )


def cross_validate(
    df: DataFrame, features: Sequence[str], y: str, fold: str, k: int, rounds: int, depth: int, seed: int = 42
) -> DataFrame:
    """(fold, rmse, n): every fold scored by trees fitted on the others.

    The cells of all folds are dealt to each of the k models, which leave out their own.  Where these are too many,
    a model gets one cell a vector, with the other folds' rows in its weight and mean, so that the size of its table
    is bounded by the product of the bins and not by that times k.  A fold's squared error is that around its own
    means, which its cells hold, and that of the means.
    """
    bins = binning(df, features)
    columns, table = bins.columns(), stored(fold_cells(df, bins, y, fold), "fold-cells")
    if table.count() <= MOST_CELLS:
        own = F.col("fold") == F.col("_model")
        marked = {"_weight": F.when(own, 0.0).otherwise(F.col("_n")), "_target": F.col("_mean")}
        seen = _dealt(table, k).withColumns(marked | {"_n": F.when(own, F.col("_n")).otherwise(0.0)})
    else:
        part = F.struct("fold", "_n", "_mean", "_dev")
        vectors = stored(table.groupBy(*columns).agg(F.sort_array(F.collect_list(part)).alias("_folds")), "vectors")
        if vectors.count() > MOST_CELLS:
            return _distributed_folds(table, columns, k, rounds, depth, seed)
        seen = _model_cells(_dealt(vectors, k), columns)

    def one(key: tuple, group: pa.Table) -> pa.Table:
        i = key[0].as_py()
        group = group.sort_by([(c, "ascending") for c in [*columns, "fold"]])
        found = _bins_of(columns, group)
        weight, mean, n, own_mean, dev = (group.column(c).to_numpy() for c in ("_weight", "_target", "_n", "_mean", "_dev"))
        rest, own = weight > 0, n > 0
        if not rest.any() or not own.any():
            return pa.table({"fold": pa.array([], pa.int32()), "rmse": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        trees = grow_trees(found[rest], weight[rest], mean[rest], rounds, depth, BINS + 2)
        miss = own_mean[own] - predict_trees(trees, found[own])
        total = n[own].sum()
        rmse = np.sqrt((dev[own] + n[own] * miss * miss).sum() / total)
        return pa.table({"fold": pa.array([i], pa.int32()), "rmse": [rmse], "n": pa.array([int(total)], pa.int64())})

    return seen.groupBy("_model").applyInArrow(one, "fold int, rmse double, n long")


def _dealt(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("_model", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def _model_cells(dealt: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A vector as the model ``_model`` sees it: weight and mean of the other folds' rows, and its own fold's part."""

    def total(value: Callable[[Column], Column]) -> Column:
        others = F.filter("_folds", lambda f: f["fold"] != F.col("_model"))
        return F.aggregate(others, F.lit(0.0), lambda s, f: s + value(f))

    own = F.try_element_at(F.filter("_folds", lambda f: f["fold"] == F.col("_model")), F.lit(1))
    weight, moment = total(lambda f: f["_n"]), total(lambda f: f["_n"] * f["_mean"])
    return dealt.select(
        "_model", F.col("_model").alias("fold"), *columns, weight.alias("_weight"),
        F.coalesce(F.try_divide(moment, weight), F.lit(0.0)).alias("_target"),
        *[F.coalesce(own[c], F.lit(0.0)).alias(c) for c in ("_n", "_mean", "_dev")],
    )


def _distributed_folds(table: DataFrame, columns: Sequence[str], k: int, rounds: int, depth: int, seed: int) -> DataFrame:
    parts = []
    for i in range(k):
        rest = table.filter(F.col("fold") != i).withColumnsRenamed({"_n": "_weight", "_mean": "_target"})
        model = _distributed(rest, columns, rounds, depth, seed, "_p")
        held = model.transform(_assembled(table.filter(F.col("fold") == i), columns))
        miss = F.col("_mean") - F.col("_p")
        error = F.sum(F.col("_dev") + F.col("_n") * miss * miss) / F.sum("_n")
        parts.append(held.groupBy("fold").agg(F.sqrt(error).alias("rmse"), F.sum("_n").cast("bigint").alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
