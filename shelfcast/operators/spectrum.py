"""Fourier transforms of series of any length, a square root of the length at a time.

A transform of ``m = a * b`` points is b transforms of a points, a turn of each value, and a transforms of b
points: two grouped steps of about the root of m rows each, so no task holds a series.  That asks for a length
that factors; a power of two does, and a series of any other length is a convolution with a chirp of such a
length (Bluestein).  Work and rows grow with n log n.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BLOCK = 1 << 16  # positions of a chirp that one row makes


def _factor(m: int) -> int:
    """The number of points of the first step, about the root of m."""
    return 1 << ((m.bit_length() - 1) // 2)


def _spread(table: pa.Table, keys: Sequence[str], **columns: np.ndarray) -> pa.Table:
    """A group's keys beside new columns."""
    n = len(next(iter(columns.values())))
    first = pa.array(np.zeros(n, np.int64))
    return pa.table({k: table.column(k).take(first) for k in keys} | {k: pa.array(v) for k, v in columns.items()})


def _values(table: pa.Table, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, complex)
    out[at] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
    return out


def transform(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The discrete Fourier transform of (keys, m, t, re, im), again with t; absent points count as 0.

    ``m``, a power of two, is the length of the key's series.
    """
    keys = [*keys, "m"]
    known = [points.schema[k] for k in keys]

    def first(table: pa.Table) -> pa.Table:
        m, r = table.column("m")[0].as_py(), table.column("r")[0].as_py()
        a = _factor(m)
        own = np.fft.fft(_values(table, table.column("t").to_numpy() // (m // a), a))
        k = np.arange(a, dtype=np.int64)
        turned = own * np.exp(-2j * np.pi * (r * k % m) / m)
        return _spread(table, keys, k=k, r=np.full(a, r), re=turned.real, im=turned.imag)

    def second(table: pa.Table) -> pa.Table:
        m, k = table.column("m")[0].as_py(), table.column("k")[0].as_py()
        a = _factor(m)
        own = np.fft.fft(_values(table, table.column("r").to_numpy(), m // a))
        return _spread(table, keys, t=k + a * np.arange(m // a, dtype=np.int64), re=own.real, im=own.imag)

    residues = points.withColumn("r", F.expr("t % shiftright(m, cast((length(bin(m)) - 1) div 2 as int))"))
    values = StructType(list(known)).add("k", "long").add("r", "long").add("re", "double").add("im", "double")
    steps = residues.groupBy(*keys, "r").applyInArrow(first, values)
    out = StructType(list(known)).add("t", "long").add("re", "double").add("im", "double")
    return steps.groupBy(*keys, "k").applyInArrow(second, out)


def _chirp(t: Column, n: Column) -> Column:
    """The angle pi t^2 / n, its whole turns taken out in integers."""
    return F.pmod(t * t, 2 * n) * math.pi / n


def squared_spectrum(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, k, square): the squared size of the transform of (by, n, t, e) at k from 0 to n / 2.

    ``n`` is the number of points of a series and ``t`` runs from 0; the series may be of different lengths.
    """
    by, t, n = list(by), F.col("t"), F.col("n")
    sized = series.select(*by, "n", F.expr("shiftleft(1L, length(bin(2 * n - 2)))").alias("m"), "t", "e")
    turned = sized.select(
        *by, "n", "m", "t", (F.col("e") * F.cos(_chirp(t, n))).alias("re"), (-F.col("e") * F.sin(_chirp(t, n))).alias("im")
    )
    # The chirp of each length, wrapped around: position t and, from the end, position m - t.
    lengths = sized.filter("t = 0").select("n", "m").distinct()
    blocks = lengths.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK))))
    whole = F.sequence(F.col("at") * _BLOCK, F.least((F.col("at") + 1) * _BLOCK, n) - 1)
    places = blocks.withColumn("t", F.explode(whole))
    both = F.when(t == 0, F.array(t)).otherwise(F.array(t, F.col("m") - t))
    chirp = places.select(
        "n", "m", F.explode(both).alias("t"), F.cos(_chirp(t, n)).alias("re"), F.sin(_chirp(t, n)).alias("im")
    )
    held = transform(chirp, ["n"]).withColumnsRenamed({"re": "re_b", "im": "im_b"})
    product = transform(turned, [*by, "n"]).join(held, ["n", "m", "t"])
    mixed = product.select(
        *by, "n", "m", "t",
        (F.col("re") * F.col("re_b") - F.col("im") * F.col("im_b")).alias("re"),
        (-F.col("re") * F.col("im_b") - F.col("im") * F.col("re_b")).alias("im"),
    )
    back = transform(mixed, [*by, "n"]).filter(2 * t <= n)
    size = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("m").cast("double") * F.col("m"))
    return back.select(*by, "n", t.alias("k"), size.alias("square"))
