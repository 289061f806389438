"""Small helpers that the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, as ``doc_id`` and ``text``; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fold(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def about(df: DataFrame, rows: int, *keys: str, seed: int = 0) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), chosen by a hash of ``keys``.

    Only for the bounded rows that a classifier is fitted on; the same rows at any partitioning.
    """
    n = df.count()
    if n <= rows:
        return df
    space = 1 << 31
    return df.filter(F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(space)) < int(space * rows / n))


def known_labels(labels: DataFrame, label: str, folds: int) -> DataFrame:
    """One row per document that may be learned from: id and 0 or 1; fold 0 is held out."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
