"""Exact ranked search: posting lists cut into blocks of alike documents, skipped by the maxima of their blocks.

A document's score for an item is the sum of weight times impact over the item's terms, so it is an inner
product, and a block of documents whose coordinatewise maximum has too small a product with the item holds
nothing that can rank.

``build_vectors``
    gives every document the impacts of the terms that are asked for, orders the documents by a signature of
    random hyperplanes, so that alike ones are neighbours, and cuts this order into segments of bounded size.
``build_blocks``
    cuts, within a segment, each term's posting list into runs of neighbours and stores for each run the
    largest impact of every term that an item asks for together with that term.
``search_segments``
    walks an item's lists block by block, best bound first, and ends when no bound reaches the item's
    threshold; the documents of the other blocks are scored exactly.

Thresholds are exact scores too: an item's k-th best score in a hashed share of the documents, then its k-th
best within the segment.  Blocks are skipped only below the threshold, so equal scores are never lost.  A list
is needed only where the item's other lists together could reach the threshold with it and not without it;
in a segment, the cheapest lists whose largest impacts together stay below the threshold have no blocks.

The items are the stated query set and are worked on in blocks of bounded text; what a task holds of them
(terms, weights, thresholds) is bounded by such a block, whatever the number of documents or items.

Edge cases: a null text has no terms; a document without terms is not counted; an item without terms, or whose
terms no document holds, has no rows.  Items with the same id and text are one, with the same id and another
text two.  Documents with the same id are ranked one by one; equal scores go by id, null ids last.  Empty
tables give no rows; columns beside id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import texts
from shelfcast.sources.scratch import stored

K = 20
ITEM_BYTES = 4_000_000  # text of the items that are searched for at a time, about
SEED_SHARE = 16  # one document in so many gives the first thresholds
SEGMENT_DOCS = 4_096
SEGMENT_ENTRIES = 1_000_000  # documents with many terms make shorter segments
BLOCK_DOCS = 32
BITS = 16  # of a signature
MAX_PARTS = 10_000  # tasks of the ordered pass; more documents make longer tasks, not longer segments

# Terms are what ASCII letters and digits and all other characters beyond ASCII spell; only A-Z are lowered.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return text.encode().translate(_LETTERS).split()


@dataclass
class Asked:
    """A block of items: their ids, and per item the numbers and repeats of its terms."""

    ids: list
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    vocabulary: dict[bytes, int]


@dataclass
class Weighed:
    """What a task needs to know of the items: term weights times repeats per item, and its threshold."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]
    least: np.ndarray
    size: int  # of the vocabulary


def asked_items(items: DataFrame) -> Iterator[Asked]:
    """The items with terms, in blocks of about ``ITEM_BYTES`` of text."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-total // ITEM_BYTES))
    for i in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == i).distinct()
        vocabulary: dict[bytes, int] = {}
        ids, terms, repeats = [], [], []
        for row in mine.sort("doc_id", "text").collect():
            counts = Counter(terms_of(row["text"]))
            if counts:
                ids.append(row["doc_id"])
                terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64))
                repeats.append(np.array(list(counts.values()), np.int64))
        if ids:
            yield Asked(ids, terms, repeats, vocabulary)


def _counted(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row per document with a term: row (a number of its own), doc_id, n, and the asked terms with counts."""
    kind = dict(documents.dtypes)["doc_id"]
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value.get
        for batch in batches:
            lengths, terms, counts, sizes = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                found = Counter(map(known, words))
                found.pop(None, None)
                lengths.append(len(words))
                terms.extend(found)
                counts.extend(found.values())
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            out = [
                batch.column("row"),
                batch.column("doc_id"),
                pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "n", "terms", "counts"])

    rows = documents.withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, f"row long, doc_id {kind}, n long, terms array<int>, counts array<long>").filter("n > 0")


def _flat(column: pa.Array | pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column, one after the other, and where each row begins (with the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat, np.r_[0, np.cumsum(lengths)]


def _spans(first: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all elements of the chosen rows, and where each of these rows begins among them."""
    begin, lengths = first[chosen], first[chosen + 1] - first[chosen]
    starts = np.cumsum(lengths) - lengths
    return np.repeat(begin - starts, lengths) + np.arange(int(lengths.sum())), starts


def _lists(flat: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, kind))


def _impacts(n: np.ndarray, counts: np.ndarray, first: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each count is worth in a document of ``n`` terms; all integers."""
    m = 100 - 25 + (25 * n * documents) // length
    return (1_000_000_000 * counts) // (1000 * counts + 12 * np.repeat(m, np.diff(first)))


def build_vectors(counted: DataFrame, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """segment, place, row, doc_id, terms, impacts: alike documents are neighbours and share segments."""
    kind = dict(counted.dtypes)["doc_id"]
    planes = np.random.default_rng(0).standard_normal((len(weights), BITS)).astype(np.float32)
    held = counted.sparkSession.sparkContext.broadcast((weights.astype(np.float32)[:, None] * planes))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 1 << np.arange(BITS - 1, -1, -1)
        for batch in batches:
            terms, first = _flat(batch.column("terms"), np.int64)
            counts, _ = _flat(batch.column("counts"), np.int64)
            impacts = _impacts(batch.column("n").to_numpy(), counts, first, documents, length)
            signature = np.zeros(batch.num_rows, np.int64)
            for i in range(BITS):  # one plane at a time: all at once would take BITS times the memory
                sums = np.add.reduceat(impacts * held.value[terms, i], first[:-1])
                signature += (sums > 0) * bits[i]
            columns = [
                pa.array(signature.astype(np.int32)),
                batch.column("row"),
                batch.column("doc_id"),
                _lists(terms, first, pa.int32()),
                _lists(impacts, first, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["signature", "row", "doc_id", "terms", "impacts"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, docs, entries = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            numbers, places = [], []
            for size in pc.list_value_length(batch.column("terms")).to_pylist():
                if docs == SEGMENT_DOCS or docs and entries + size > SEGMENT_ENTRIES:
                    segment, docs, entries = segment + 1, 0, 0
                numbers.append(segment)
                places.append(docs)
                docs, entries = docs + 1, entries + size
            columns = [pa.array(numbers, pa.int64()), pa.array(places, pa.int32())]
            columns += [batch.column(c) for c in ("row", "doc_id", "terms", "impacts")]
            yield pa.RecordBatch.from_arrays(columns, names=["segment", "place", "row", "doc_id", "terms", "impacts"])

    fields = f"row long, doc_id {kind}, terms array<int>, impacts array<int>"
    asked = counted.filter(F.size("terms") > 0)
    parts = min(MAX_PARTS, documents // (2 * SEGMENT_DOCS) + 1)
    signed = stored(asked.mapInArrow(sign, f"signature int, {fields}"), "signed")
    ordered = signed.repartitionByRange(parts, "signature", "row").sortWithinPartitions("signature", "row")
    return ordered.mapInArrow(number, f"segment long, place int, {fields}")


def _needed(item: int, asked: Weighed, largest: np.ndarray) -> np.ndarray:
    """The item's terms whose lists have to be walked in a segment with these largest impacts."""
    terms, weights = asked.terms[item], asked.weights[item]
    reach = weights * largest[terms]
    order = np.argsort(reach, kind="stable")
    total = np.cumsum(reach[order])
    return terms[order[(total >= asked.least[item]) & (reach[order] > 0)]]


class _Segment:
    """The vectors of one segment, by place."""

    def __init__(self, table: pa.Table, size: int):
        table = table.combine_chunks().sort_by("place")
        self.doc_ids, self.rows = table.column("doc_id"), table.column("row").to_numpy()
        self.terms, self.first = _flat(table.column("terms"), np.int64)
        self.impacts, _ = _flat(table.column("impacts"), np.int64)
        self.largest = np.zeros(size, np.int64)
        np.maximum.at(self.largest, self.terms, self.impacts)


def _summaries(segment: _Segment, asked: Weighed) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(term, places of a run of its documents, the terms asked for beside it, their largest impacts)."""
    beside: dict[int, list[np.ndarray]] = {}
    for item in range(len(asked.terms)):
        for t in _needed(item, asked, segment.largest).tolist():
            beside.setdefault(t, []).append(asked.terms[item])
    if not beside:
        return
    lengths = np.diff(segment.first)
    order = np.argsort(segment.terms, kind="stable")  # posting lists: by term, then by place
    place = np.repeat(np.arange(len(lengths)), lengths)[order]
    begin = np.searchsorted(segment.terms[order], np.arange(asked.size + 1))
    wanted = np.zeros(asked.size, bool)
    for t in sorted(beside):
        wanted[:] = False
        for terms in beside[t]:
            wanted[terms] = True
        docs = place[begin[t] : begin[t + 1]]
        for i in range(0, len(docs), BLOCK_DOCS):
            run = docs[i : i + BLOCK_DOCS]
            at, _ = _spans(segment.first, run)
            at = at[wanted[segment.terms[at]]]
            terms, impacts = segment.terms[at], segment.impacts[at]
            by = np.argsort(terms, kind="stable")
            terms, impacts = terms[by], impacts[by]
            heads = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
            yield t, run, terms[heads], np.maximum.reduceat(impacts, heads)


def build_blocks(vectors: DataFrame, asked: Weighed) -> DataFrame:
    """segment, term, places, beside, largest: one row per block of a posting list."""
    held = vectors.sparkSession.sparkContext.broadcast(asked)

    def build(table: pa.Table) -> pa.Table:
        made = list(_summaries(_Segment(table, held.value.size), held.value))
        columns = [
            pa.array([table.column("segment")[0].as_py()] * len(made), pa.int64()),
            pa.array([m[0] for m in made], pa.int32()),
            *(pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in (1, 2, 3)),
        ]
        return pa.Table.from_arrays(columns, names=["segment", "term", "places", "beside", "largest"])

    fields = "segment long, term int, places array<int>, beside array<int>, largest array<int>"
    return vectors.groupBy("segment").applyInArrow(build, fields)


def _scores(query: np.ndarray, segment: _Segment, places: np.ndarray) -> np.ndarray:
    at, starts = _spans(segment.first, places)
    return np.add.reduceat(query[segment.terms[at]] * segment.impacts[at], starts)


def _best(scores: np.ndarray, k: int) -> int:
    """The k-th best score, or 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _walk(item: int, asked: Weighed, segment: _Segment, blocks: dict, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of a segment that may be among the item's k best."""
    lists = [np.arange(*blocks["of"][t]) for t in _needed(item, asked, segment.largest).tolist() if t in blocks["of"]]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = np.concatenate(lists)
    at, starts = _spans(blocks["first"], chosen)
    bounds = np.add.reduceat(query[blocks["beside"][at]] * blocks["largest"][at], starts)
    order = np.argsort(-bounds, kind="stable")
    chosen, bounds = chosen[order], bounds[order]
    seen = np.zeros(len(segment.rows), bool)
    places, scores, least, i, step = [], np.zeros(0, np.int64), max(int(asked.least[item]), 1), 0, 4
    while i < len(chosen) and bounds[i] >= least:
        end = i + int(np.searchsorted(-bounds[i : i + step], -least, side="right"))
        at, _ = _spans(blocks["places_first"], chosen[i:end])
        new = np.unique(blocks["places"][at])
        new = new[~seen[new]]
        i, step = end, min(2 * step, 256)
        if len(new):
            seen[new] = True
            places.append(new)
            scores = np.r_[scores, _scores(query, segment, new)]
            least = max(least, _best(scores, k))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, kept = np.concatenate(places), scores >= least
    return places[kept], scores[kept]


def search_segments(vectors: DataFrame, blocks: DataFrame, asked: Weighed, k: int) -> DataFrame:
    """item (its number), row, doc_id, score: in each segment the documents that may be among an item's k best."""
    kind = dict(vectors.dtypes)["doc_id"]
    held = vectors.sparkSession.sparkContext.broadcast(asked)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        items, found_rows, found_ids, found_scores = [], [], [], []
        if left.num_rows and right.num_rows:
            asked = held.value
            segment = _Segment(left, asked.size)
            right = right.combine_chunks().sort_by("term")
            term = right.column("term").to_numpy()
            heads = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            ends = np.r_[heads[1:], len(term)]
            known = {"of": dict(zip(term[heads].tolist(), zip(heads.tolist(), ends.tolist())))}
            known["beside"], known["first"] = _flat(right.column("beside"), np.int64)
            known["largest"], _ = _flat(right.column("largest"), np.int64)
            known["places"], known["places_first"] = _flat(right.column("places"), np.int64)
            query = np.zeros(asked.size, np.int64)
            for item, (terms, weights) in enumerate(zip(asked.terms, asked.weights)):
                query[terms] = weights
                places, scores = _walk(item, asked, segment, known, query, k)
                query[terms] = 0
                if len(places):
                    items.append(np.full(len(places), item))
                    found_rows.append(segment.rows[places])
                    found_ids.append(segment.doc_ids.take(pa.array(places)))
                    found_scores.append(scores)
        whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ids = [c for x in found_ids for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])]
        columns = [
            pa.array(whole(items), pa.int32()),
            pa.array(whole(found_rows), pa.int64()),
            pa.chunked_array(ids, left.schema.field("doc_id").type),
            pa.array(whole(found_scores), pa.int64()),
        ]
        return pa.Table.from_arrays(columns, names=["item", "row", "doc_id", "score"])

    grouped = vectors.groupBy("segment").cogroup(blocks.groupBy("segment"))
    return grouped.applyInArrow(search, f"item int, row long, doc_id {kind}, score long")


def _first_thresholds(counted: DataFrame, asked: Weighed, documents: int, length: int, k: int) -> np.ndarray:
    """Per item its k-th best exact score in a hashed share of the documents; 0 where fewer have a score."""
    held = counted.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        query = np.zeros(asked.size, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, first = _flat(batch.column("terms"), np.int64)
            counts, _ = _flat(batch.column("counts"), np.int64)
            impacts = _impacts(batch.column("n").to_numpy(), counts, first, documents, length)
            items, best = [], []
            for item, (t, w) in enumerate(zip(asked.terms, asked.weights)):
                query[t] = w
                scores = np.add.reduceat(query[terms] * impacts, first[:-1])
                query[t] = 0
                scores = np.sort(scores[scores > 0])[-k:]
                items.append(np.full(len(scores), item))
                best.append(scores)
            columns = [pa.array(np.concatenate(items), pa.int32()), pa.array(np.concatenate(best), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "score"])

    sample = counted.filter((F.size("terms") > 0) & (F.pmod(F.xxhash64("row"), F.lit(SEED_SHARE)) == 0))
    scored = sample.mapInArrow(run, "item int, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = np.zeros(len(asked.terms), np.int64)
    for row in ranked.filter(F.col("rank") == k).collect():
        out[row["item"]] = row["score"]
    return out


def rank(
    documents: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 for each item."""
    spark, rows = documents.sparkSession, texts(documents, id_col, text_col)
    wanted = texts(items, item_id, item_text)
    kind, item_kind = dict(rows.dtypes)["doc_id"], dict(wanted.dtypes)["doc_id"]
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    for block in asked_items(wanted):
        counted = stored(_counted(rows, block.vocabulary), "counted")
        told = counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        if not told["documents"]:
            continue
        held = np.zeros(len(block.vocabulary), np.int64)
        for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            held[row["t"]] = row["count"]
        n = told["documents"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
        asked = Weighed(
            block.terms,
            [weights[t] * r for t, r in zip(block.terms, block.repeats)],
            np.zeros(len(block.ids), np.int64),
            len(weights),
        )
        asked.least = _first_thresholds(counted, asked, n, told["length"], k)
        vectors = stored(build_vectors(counted, weights, n, told["length"]), "vectors")
        blocks = stored(build_blocks(vectors, asked), "posting-blocks")
        found = search_segments(vectors, blocks, asked, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {item_kind}")
        out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out
