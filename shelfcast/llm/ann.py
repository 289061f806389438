"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are taken in bands of norms, each a factor of two wide and centred on a power of two.  A vector is scaled by the
largest norm of its band and lifted onto the unit sphere by one more component, so that the nearest by inner product are
the nearest on the sphere; every query searches every band, and the few vectors of a band of at most ``SMALL`` whole.
A table files a vector under the signed axes it is nearest to in several pseudo-rotations (three rounds of random
signs and a fast Hadamard transform each).  How many of them make up its key grows with the logarithm of the band's size, so that
buckets shrink as the table grows.  A query looks into the ``probes`` keys of every table whose axes lie nearest to it together; what it finds
there is ranked by the exact inner product in double precision.  The nearest cells, looked at first, give each query a score that its
``k`` best reach at least, so that later cells pass on only what reaches it too.  A query that finds fewer than ``k`` this way, though
there are more candidates, is answered by looking at every row.

All but the last axis of a key make a cell, which is what is shuffled; within a cell a query meets only the vectors of the last axes it
probes.  Cells are dealt into blocks of bounded size on both sides, so a vector that occurs in a third of all
rows makes more tasks, not a longer one.

Edge cases: vectors that are null, empty or zero, or hold nulls or non-finite numbers, take no part; vectors
of different lengths never meet; repeated rows count once for each id; ties go to the smaller id; fewer
candidates than ``k`` are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.sources.scratch import stored

TABLES = 12
PROBES = (26, 600)  # keys looked into, by the number of axes in a key; each axis more takes the last ratio again
GROWTH = 256  # a band this many times larger has one axis more in its keys
LEAST = 32  # vectors for each first axis before a second one is added
TRIED = 96  # axes of a rotation that a query tries
SMALL = 32  # a band of so many vectors is looked at as a whole
WHOLE = -1  # its cell
BLOCK = 4_096  # vectors, and queries, of one task
PAIRS = 50_000  # inner products taken at once


def usable(vector: str) -> Column:
    v = F.col(vector)
    number = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(number, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _signs(dim: int, table: int) -> np.ndarray:
    return np.random.default_rng([dim, table, 20]).choice([-1.0, 1.0], (3, dim))


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform; the width is a power of two."""
    dim = x.shape[1]
    for signs in _signs(dim, table):
        x = x * signs
        h = 1
        while h < dim:
            x = x.reshape(len(x), -1, 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), dim)
            h *= 2
        x = x / np.sqrt(dim)
    return x


def lifted(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Rows on the unit sphere, padded to a power of two; ``largest`` None is for queries."""
    norm = np.linalg.norm(x, axis=1)
    dim = 1 << int(x.shape[1]).bit_length()  # room for one more component
    out = np.zeros((len(x), dim))
    out[:, : x.shape[1]] = x / (norm if largest is None else np.full(len(x), largest))[:, None]
    if largest is not None:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm / largest) ** 2))
    return out


def _signed(x: np.ndarray, table: int, turn: int) -> np.ndarray:
    """Each row's share of every signed axis; axis i has the numbers 2i and 2i + 1."""
    r = rotate(x, table * 16 + turn)
    return np.stack([r, -r], axis=2).reshape(len(r), -1)


def axes_for(n: int) -> int:
    """Axes in the keys of a band of ``n`` vectors; 0 for a band looked at whole."""
    if n <= SMALL:
        return 0
    return 1 + max(0, math.floor(math.log(max(n / LEAST, 1), GROWTH)))


def probes_for(axes: int) -> int:
    return PROBES[axes - 1] if axes <= len(PROBES) else int(PROBES[-1] * (PROBES[-1] / PROBES[-2]) ** (axes - len(PROBES)))


def own_keys(x: np.ndarray, table: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell and the last axis of each row."""
    cell, last = np.full(len(x), table, np.int64), np.zeros(len(x), np.int64)
    for turn in range(axes):
        if turn:
            cell = cell * (2 * x.shape[1]) + last
        last = _signed(x, table, turn).argmax(axis=1)
    return cell, last


def probed_keys(x: np.ndarray, table: int, axes: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and last axes of the keys whose axes lie nearest to each row, one row of ``probes`` keys each.

    Shares add up along a key, so the best keys of a length begin with the best of the length before.
    """
    cell, total, last = np.full((len(x), 1), table, np.int64), np.zeros((len(x), 1)), None
    for turn in range(axes):
        both = _signed(x, table, turn)
        if turn:
            cell = cell * both.shape[1] + last
        near = np.argsort(-both, axis=1, kind="stable")[:, :TRIED]
        sums = (total[:, :, None] + np.take_along_axis(both, near, axis=1)[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        total = np.take_along_axis(sums, best, axis=1)
        cell = np.take_along_axis(cell, best // near.shape[1], axis=1)
        last = np.take_along_axis(near, best % near.shape[1], axis=1)
    return cell, last


def _band(vector: str) -> Column:
    """The power of two nearest to the norm, so that unit vectors lie in the middle of a band."""
    return F.floor(F.log2(_norm(vector)) + 0.5).cast("int")


def _norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _filed(largest: dict[tuple[int, int], float], tables: int):
    """Keys of vectors, given with their band and its number of axes; ``largest`` is by length and band."""

    @F.pandas_udf("array<struct<cell:bigint,last:int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, band, axes in batches:
            out: list = [[{"cell": WHOLE, "last": 0}]] * len(v)
            kinds = pd.Series(list(zip(v.map(len), band, axes)), dtype=object)
            for (d, b, m), at in kinds.groupby(kinds).indices.items():
                if not m:
                    continue
                u = lifted(np.stack([np.asarray(row, np.float64) for row in v.iloc[at]]), largest[d, b])
                keys = [own_keys(u, t, m) for t in range(tables)]
                for i, row in enumerate(at):
                    out[row] = [{"cell": int(c[i]), "last": int(a[i])} for c, a in keys]
            yield pd.Series(out, dtype=object)

    return run


def _probed(tables: int, probes: int | None):
    """Cells that a query looks into, with the last axes it wants there; ``near`` marks the nearest cell of each table."""

    @F.pandas_udf("array<struct<cell:bigint,lasts:array<int>,near:boolean>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, axes in batches:
            out: list = [[{"cell": WHOLE, "lasts": [0], "near": False}]] * len(v)
            kinds = pd.Series(list(zip(v.map(len), axes)), dtype=object)
            for (_, m), every in kinds.groupby(kinds).indices.items():
                if not m:
                    continue
                for at in np.array_split(every, -(-len(every) // 64)):
                    u = lifted(np.stack([np.asarray(row, np.float64) for row in v.iloc[at]]), None)
                    keys = [probed_keys(u, t, m, probes or probes_for(m)) for t in range(tables)]
                    for i, row in enumerate(at):
                        cell, last = np.concatenate([c[i] for c, _ in keys]), np.concatenate([a[i] for _, a in keys])
                        order = np.argsort(cell, kind="stable")
                        cells, starts = np.unique(cell[order], return_index=True)
                        near = {int(c[i, 0]) for c, _ in keys} if m > 1 else set()
                        parts = np.split(last[order], starts[1:])
                        out[row] = [{"cell": int(c), "lasts": part.tolist(), "near": int(c) in near} for c, part in zip(cells, parts)]
            yield pd.Series(out, dtype=object)

    return run


def _met(k: int):
    """The ``k`` best of each query among the vectors of a cell that lie under its last axes (null: all) and score ``least`` or more."""

    def run(_: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([])})
        if not len(index) or not len(queries):
            return none
        index = index.sort_values("last", kind="stable")
        x, ids = np.stack(index["v"].to_list()).astype(np.float64), index["vec_id"].to_numpy()
        axes = index["last"].to_numpy()
        q, asks = np.stack(queries["v"].to_list()).astype(np.float64), queries["vec_id"].to_numpy()
        every = np.unique(axes)
        lasts = [every if row is None else row for row in queries["lasts"]]
        least = queries["least"].fillna(-np.inf).to_numpy(np.float64)
        who, wanted = np.repeat(np.arange(len(q)), [len(row) for row in lasts]), np.concatenate(lasts)
        first = np.searchsorted(axes, wanted, "left")
        many = np.searchsorted(axes, wanted, "right") - first
        who, first, many = who[many > 0], first[many > 0], many[many > 0]
        # Queries are taken together up to PAIRS products; one query has at most BLOCK of them here.
        each = np.bincount(who, many, len(q)).cumsum()
        out = []
        for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(each[who] // PAIRS)) + 1):
            if not len(part):
                continue
            n = many[part]
            at = np.repeat(first[part] - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())
            by = np.repeat(who[part], n)
            other = asks[by] != ids[at]
            at, by = at[other], by[other]
            score = (x[at] * q[by]).sum(axis=1)
            good = score >= least[by]
            found = pd.DataFrame({"query_id": asks[by][good], "vec_id": ids[at][good], "score": score[good]})
            found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            found = found.drop_duplicates(["query_id", "vec_id"])  # an id with several vectors takes one place
            out.append(found[found.groupby("query_id").cumcount() < k])
        return pd.concat(out) if out else none

    return run


def _ranked(k: int):
    def run(_: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(index) or not len(queries):
            return pd.DataFrame(columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        index = index.sort_values("vec_id", kind="stable")
        x = np.stack(index["v"].to_list()).astype(np.float64)
        ids = index["vec_id"].to_numpy()
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        places = min(k, len(starts)) - 1  # an id with several vectors takes one place
        out = []
        for begin in range(0, len(queries), 512):
            part = queries.iloc[begin : begin + 512]
            q, own = np.stack(part["v"].to_list()).astype(np.float64), part["vec_id"].to_numpy()
            rough = q @ x.T
            rough[own[:, None] == ids[None, :]] = -np.inf
            top = rough if len(starts) == len(ids) else np.maximum.reduceat(rough, starts, axis=1)
            edge = -np.partition(-top, places, axis=1)[:, places]
            for i in range(len(q)):
                # ties are decided on sums taken in one order, so all that come near the edge are summed again
                near = np.flatnonzero((rough[i] >= edge[i] - 1e-9 * (1 + abs(edge[i]))) & (rough[i] > -np.inf))
                score = (x[near] * q[i]).sum(axis=1)
                best = np.lexsort((ids[near], -score))
                if len(starts) < len(ids):
                    best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
                best = best[:k]
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(out)[columns]

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int | None = None,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each query, other than itself.

    An id with several vectors counts with the highest score of any of them, as a query too.
    """
    rows = _rows(vectors, is_query, id_col, vector_col)
    # One number per vector length and band; both are few.
    banded = rows.withColumn("d", F.size("v")).withColumn("band", _band("v"))
    norms = banded.groupBy("d", "band").agg(F.max(_norm("v")).alias("m"), F.count("*").alias("n")).collect()
    largest = {(r["d"], r["band"]): r["m"] * (1 + 1e-12) for r in norms}
    keyed = vectors.sparkSession.createDataFrame([(r["d"], r["band"], axes_for(r["n"])) for r in norms], "d int, band int, axes int")
    cell = ["d", "band", "cell"]
    filed = banded.join(F.broadcast(keyed), ["d", "band"]).select("vec_id", "v", "d", "band", "axes", F.explode(_filed(largest, tables)("v", "band", "axes")).alias("key"))
    index = stored(filed.select("vec_id", "v", "d", "band", "axes", "key.cell", "key.last"), "index")
    kinds = F.broadcast(keyed.select("d", "axes").distinct())
    queries = banded.filter("asks").join(kinds, "d").select("vec_id", "v", "d", "axes", F.explode(_probed(tables, probes)("v", "axes")).alias("key"))
    queries = stored(queries.select("vec_id", "v", "d", "axes", "key.cell", "key.lasts", "key.near"), "probes")

    def blocks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    # One row per band and cell; its size is measured before it is joined.  A query's cell leads to all bands of as many axes.
    ask, at = ["d", "axes", "cell"], [*cell, "bi", "bq"]

    def meet(queries: DataFrame) -> DataFrame:
        dealt = stored(blocks(index, [*cell, "axes"], "ni").join(blocks(queries, ask, "nq"), ask), "dealt")

        def spread(df: DataFrame, keys: list[str], own: str, other: str, names: tuple[str, str], more: list[str]) -> DataFrame:
            return df.join(dealt, keys).select(
                *[F.col(c).alias(c) for c in cell],  # names of their own for each side of the cogroup
                F.pmod(F.xxhash64("vec_id", "v"), F.col(own)).cast("int").alias(names[0]),
                F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1]),
                "vec_id",
                "v",
                *more,
            )

        one = spread(index, [*cell, "axes"], "ni", "nq", ("bi", "bq"), ["last"])
        two = spread(queries, ask, "nq", "ni", ("bq", "bi"), ["lasts", "least"])
        return one.groupBy(*at).cogroup(two.groupBy(*at)).applyInPandas(_met(k), "query_id long, vec_id long, score double")

    # The nearest cell of each table, whole, gives a bound below the k-th score; nothing under it is shuffled later.
    asked = queries.select("vec_id", "v", "d", "axes", "cell", "lasts", F.lit(None).cast("double").alias("least"), "near")
    early = stored(meet(asked.filter("near").withColumn("lasts", F.lit(None).cast("array<int>"))), "early")
    bound = stored(_best(early, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least")), "bound")
    found = meet(asked.drop("least").join(bound, "vec_id", "left")).unionByName(early)
    found = stored(_best(found, k), "found")
    # Candidates of a query: the other ids of its vector's length.
    others = F.broadcast(banded.groupBy("d").agg((F.countDistinct("vec_id") - 1).alias("c")))
    due = banded.filter("asks").select("vec_id", "d").distinct().join(others, "d").groupBy("vec_id").agg(F.least(F.lit(k), F.sum("c")).alias("due"))
    got = found.groupBy("query_id").agg(F.count("*").alias("got"))
    short = due.join(got, F.col("vec_id") == F.col("query_id"), "left").filter(F.coalesce("got", F.lit(0)) < F.col("due"))
    short = stored(short.select("vec_id"), "short")
    if short.isEmpty():
        return found
    exact = _exact(rows, rows.filter("asks").join(short, "vec_id", "left_semi"), k)
    return found.join(short, F.col("query_id") == short["vec_id"], "left_anti").unionByName(exact)


def _rows(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    return vectors.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # An id met more than once, in several tables or with several vectors, counts with its highest score.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_exact(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The same by looking at every row, in blocks; what recall is measured against."""
    rows = _rows(vectors, is_query, id_col, vector_col)
    return _exact(rows, rows.filter("asks"), k)


def _exact(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    n = max(1, -(-rows.count() // BLOCK))
    m = max(1, -(-queries.count() // BLOCK))
    at = ["d", "bi", "bq"]

    def part(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        return df.select(
            F.size("v").alias("d"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(own)).cast("int").alias(names[0]),
            F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(names[1]),
            F.col("vec_id").alias("vec_id"), F.col("v").alias("v"),  # names of their own for each side of the cogroup
        )

    one, two = part(rows, n, m, ("bi", "bq")), part(queries, m, n, ("bq", "bi"))
    found = one.groupBy(*at).cogroup(two.groupBy(*at)).applyInPandas(_ranked(k), "query_id long, vec_id long, score double")
    return _best(found, k)
