"""Shards of equal weight in bytes, tokens and rows at once, by vector bin packing.

Equal texts are a group and go to one shard.  Small groups are filed by hash into bins, a fixed number for each
shard; a group heavier than a bin is a unit of its own.  Bins and groups, whose number depends on the number of
shards only, are placed one by one, heaviest first, each on the shard where the product of its weights with what
the shard has left is highest, among shards with room for its bytes (the law); where no shard has that room, it goes
where most bytes are left.  A group heavier than ``WHOLE`` of a shard's fair share needs room in all three.  A group is cut only where it is heavier than a fair share, or heavier than ``WHOLE`` of one and fits nowhere:
its rows are then dealt by their number, in chunks of about a bin, and the chunks are placed like bins.  A row's slot is its bin's or chunk's
place in the shard and its own place there.

Edge cases: a null text has no bytes; empty texts are one group; rows that are equal in id and text are rows of
one group like any other, and a null id is an id like any other, so both are dealt where a group is cut; an empty
table gives an empty result.  Columns beside id and text are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.llm.common import texts
from shelfcast.sources.scratch import stored

SHARDS = 24
BINS = 256  # bins for each shard
WHOLE = 0.25  # a group of up to this part of a shard's share is never cut
OVERHEAD = 8  # bytes a row takes besides its text
WEIGHTS = ("bytes", "tokens", "n")


def place(weights: np.ndarray, groups: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each chunk; ``weights`` has a row per chunk and a column per resource, ``groups`` numbers from 0."""
    total = weights.sum(axis=0)
    share = weights / np.where(total > 0, total, 1)
    need = np.zeros((groups.max(initial=-1) + 1, weights.shape[1]))
    np.add.at(need, groups, share)
    chunks = np.split(np.argsort(groups, kind="stable"), np.cumsum(np.bincount(groups, minlength=len(need)))[:-1])
    fair = 1.0 / shards
    left = np.full((shards, weights.shape[1]), fair)
    out = np.zeros(len(weights), np.int32)

    waiting = [(-n.max(), 0, g, own, n) for g, (own, n) in enumerate(zip(chunks, need)) if len(own)]
    heapq.heapify(waiting)
    while waiting:
        _, _, _, own, want = heapq.heappop(waiting)
        room = left >= want - 1e-12
        large = len(own) > 1 and want.max() > WHOLE * fair
        fits = room.all(axis=1) if large else room[:, 0]
        if large and (want.max() > fair or not fits.any()):
            for c in own:
                heapq.heappush(waiting, (-share[c].max(), 1, int(c), [c], share[c]))
            continue
        s = int(np.argmax(np.where(fits, left @ want, -np.inf) if fits.any() else left[:, 0]))
        left[s] -= want
        out[own] = s
    return out


def shard(df: DataFrame, shards: int = SHARDS, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, size, tokens, text_crc32, shard and slot."""
    text = F.col("text")
    rows = stored(
        texts(df, id_col, text_col).select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.when(text == "", 0).otherwise(F.length(text) - F.length(F.translate(text, " \n\t", "")) + 1).cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("grp"),
            # Written down once, so that a row keeps its number whoever reads it again.
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    whole = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    total = rows.agg(*whole).first()
    groups = rows.groupBy("grp").agg(*whole)
    units = shards * bins
    weight = F.greatest(*[F.col(w) / F.lit(float(total[w] or 1)) for w in WEIGHTS])
    # A group heavier than a bin: at most three for each bin, whatever the input.
    heavy = groups.withColumn("chunks", F.ceil(weight * units).cast("int")).filter("chunks > 1").select("grp", "chunks")
    unit = F.when(
        F.col("chunks").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("grp", F.lit(1)), F.lit(units)).cast("string"))
    ).otherwise(F.concat_ws(" ", "grp", F.pmod(F.xxhash64("row", F.lit(2)), F.col("chunks"))))
    dealt = rows.join(F.broadcast(heavy), "grp", "left").withColumn("unit", unit).drop("chunks")
    # At most some ten thousand rows: the number of bins and chunks is set by the number of shards.
    table = sorted(dealt.groupBy("unit").agg(*whole).collect(), key=lambda r: r["unit"])
    names = {name: i for i, name in enumerate(sorted({r["unit"].split(" ")[0] for r in table}))}
    numbers = np.array([names[r["unit"].split(" ")[0]] for r in table], int)
    where = place(np.array([[r[w] for w in WEIGHTS] for r in table], float).reshape(len(table), 3), numbers, shards)
    filled, plan = [0] * shards, []
    for r, s in zip(table, where.tolist()):
        plan.append((r["unit"], s, filled[s]))
        filled[s] += r["n"]
    placed = df.sparkSession.createDataFrame(plan, "unit string, shard int, before long")
    within = Window.partitionBy("unit").orderBy("grp", "doc_id", "row")
    return dealt.join(F.broadcast(placed), "unit").select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("before") + F.row_number().over(within) - 1).alias("slot")
    )
