"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is a row of lower-case words; its k-mers are five words long and carry the number of their
occurrence.  Each of ``HASHES`` sketches takes the two k-mers with the smallest hash and keeps them in the
order of the text, so that a sketch agrees when two texts share the k-mers and their order.  Texts whose
sketches agree in two chosen places meet in a bucket.

Similarity of two texts: k-mers that an alignment can pair in order, over all k-mers of both less the
pairs.  Classes are the connected components of the links of ``threshold`` or more.

Work per bucket is linear first: every member is aligned with the bucket's smallest member, and the links
are merged into classes.  A bucket that still holds several classes is finished exactly: its members are
dealt into parts, each pair of parts is one small task, and members of different classes are aligned
there.  Equal texts meet once, as one row, before any of this.

Edge cases: a null text is empty; texts with the same words are one class whatever their case and
punctuation; texts without any word form a class with the texts equal to them; shorter texts than five
words are one k-mer; repeated rows and ids keep a row each, with the same class; an empty table gives an
empty result.  Columns beside id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import texts
from shelfcast.sources.scratch import stored

WORDS = 5
THRESHOLD = 0.8
HASHES = 20
STEPS = (1,)  # sketches i and i + step, in a ring, make a bucket: 20 buckets for 20 sketches
PART = 256  # members of a bucket that one exact task takes from each side
WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """32-bit hashes of words met before."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        self[word] = out = xxhash.xxh32_intdigest(word)
        return out


_HASHES = _WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words; of the pieces between white space for a text without words."""
    lower = text.lower()
    words = WORD.findall(lower) or lower.split()
    return np.array([_HASHES[w] for w in words], np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """A hash for each run of k words; one for all words of a shorter text."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * ODD + words[i : len(words) - k + 1 + i].astype(np.uint64) + np.uint64(i + 1))
    return out


def occurrence(h: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.r_[True, s[1:] != s[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(s)) - first
    return out


_SEEDS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * ODD)


def sketches(h: np.ndarray) -> np.ndarray:
    """For each hash function: the two smallest occurrence-labelled k-mers, in the order of the text."""
    if not len(h):
        return np.zeros(0, np.uint64)
    labelled = _mix(h + occurrence(h).astype(np.uint64) * ODD)
    if len(h) == 1:
        return _mix(labelled[0] ^ _SEEDS)
    hashed = _mix(labelled[None, :] ^ _SEEDS[:, None])
    low = np.sort(np.argpartition(hashed, 1, axis=1)[:, :2], axis=1)  # positions, in text order
    return _mix(labelled[low[:, 0]] * ODD + labelled[low[:, 1]] + _SEEDS)


def buckets(sketch: np.ndarray) -> np.ndarray:
    """Hashes of pairs of sketches, with their place."""
    if not len(sketch):
        return np.zeros(0, np.int64)
    n = len(sketch)
    out = [_mix(sketch * ODD + np.roll(sketch, -s) + np.arange(n, dtype=np.uint64) + np.uint64(1000 * s)) for s in STEPS]
    return np.concatenate(out).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of k-mers that pair up in order; 0.0 where ``threshold`` is out of reach.

    The alignment is banded: k-mers further apart than the band cannot pair up in any alignment that
    reaches the threshold, so leaving them out changes no accepted value.
    """
    na, nb = len(a), len(b)
    if not na or not nb:
        return float(na == nb)
    need = int(np.ceil(threshold * (na + nb) / (1 + threshold) - 1e-9))
    if min(na, nb) < need:
        return 0.0
    short = min(na, nb)
    differ = np.flatnonzero(a[:short] != b[:short])
    front = int(differ[0]) if len(differ) else short
    rest = short - front
    differ = np.flatnonzero(a[na - rest :][::-1] != b[nb - rest :][::-1])
    back = int(differ[0]) if len(differ) else rest
    paired = front + back
    ca, cb = a[front : na - back], b[front : nb - back]
    if len(ca) and len(cb):
        symbols, ids = np.unique(np.concatenate([ca, cb]), return_inverse=True)
        ia, ib = ids[: len(ca)], ids[len(ca) :]
        both = np.minimum(np.bincount(ia, minlength=len(symbols)), np.bincount(ib, minlength=len(symbols)))
        if paired + both.sum() < need:
            return 0.0
        paired += _aligned(ia, ib, both > 0, na - need, nb - need)
    return paired / (na + nb - paired) if paired >= need else 0.0


def _aligned(ia: np.ndarray, ib: np.ndarray, common: np.ndarray, left: int, right: int) -> int:
    """Length of the longest common subsequence within the band ``-right <= i - j <= left``.

    Bit-parallel: one bit for each element of ``ia`` that also occurs in ``ib``.
    """
    pa_, pb_ = np.flatnonzero(common[ia]), np.flatnonzero(common[ib])
    if not len(pa_) or not len(pb_):
        return 0
    masks: dict[int, int] = {}
    for bit, s in enumerate(ia[pa_].tolist()):
        masks[s] = masks.get(s, 0) | (1 << bit)
    low = np.searchsorted(pa_, pb_ - right, side="left").tolist()
    high = np.searchsorted(pa_, pb_ + left, side="right").tolist()
    full = (1 << len(pa_)) - 1
    v = full
    for s, lo, hi in zip(ib[pb_].tolist(), low, high):
        m = masks[s] & (((1 << hi) - 1) >> lo << lo)
        u = v & m
        if u:
            v = ((v + u) | (v - u)) & full
    return len(pa_) - v.bit_count()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            out: list[list] = [[], [], []]
            for text in part.column("text").to_pylist():
                w = word_hashes(text)
                h = kmers(w)
                # texts without words are told apart by the text itself
                out[0].append(xxhash.xxh3_128_digest(w.tobytes() if len(w) else b"-" + text.encode()))
                out[1].append(buckets(sketches(h)))
                out[2].append(w.tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("row_key"),
                    pa.array(out[0], pa.binary()),
                    pa.array(out[1], pa.list_(pa.int64())),
                    pa.array(out[2], pa.binary()),
                ],
                names=["doc_id", "row_key", "words_key", "buckets", "words"],
            )


def _verified(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [similarity(_from(x), _from(y), threshold) for x, y in zip(b["wa"], b["wb"])]
            yield b.assign(sim=own).loc[lambda d: d["sim"] >= threshold, ["a", "b"]]

    return run


def _from(words: bytes) -> np.ndarray:
    return kmers(np.frombuffer(words, np.uint32))


def _shared(grams: list[np.ndarray]) -> np.ndarray:
    """For each two texts, how many occurrence-labelled k-mers they share; nothing aligns more than that."""
    labelled = np.concatenate([_mix(g + occurrence(g).astype(np.uint64) * ODD) if len(g) else g for g in grams])
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, place, count = np.unique(labelled, return_inverse=True, return_counts=True)
    often = count[place] > 1
    column = np.cumsum(count > 1) - 1
    out = np.zeros((len(grams), len(grams)), np.float32)
    place, owner = column[place[often]], owner[often]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    step = 4096
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        lo, hi = np.searchsorted(place, [begin, begin + step])
        has = np.zeros((len(grams), step), np.float32)
        has[owner[lo:hi], place[lo:hi] - begin] = 1
        out += has @ has.T
    return out


def _in_cell(threshold: float):
    """Align members of different classes that meet in one cell; links within the cell are followed at once."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("id", kind="stable")
        ids, label = cell["id"].tolist(), cell["cls"].tolist()
        cls = {c: c for c in label}
        grams = [_from(w) for w in cell["words"]]

        def root(c):
            while cls[c] != c:
                cls[c] = cls[cls[c]]
                c = cls[c]
            return c

        shared, sizes = _shared(grams), np.array([len(g) for g in grams], np.float64)
        share = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
        one, two = np.nonzero(np.triu(share >= threshold - 1e-6, 1))
        found = []
        for k in np.argsort(-share[one, two], kind="stable"):
            i, j = one[k], two[k]
            x, y = root(label[i]), root(label[j])
            if x != y and similarity(grams[i], grams[j], threshold) >= threshold:
                found.append((ids[i], ids[j]))
                cls[max(x, y)] = min(x, y)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``cls``, the smallest id that links lead to; only for nodes that a link touches.

    Labels spread along links and then jump to their label's label, until nothing changes; each round
    is written to the shared folder.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("cls")), "labels")
    while True:
        seen = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("cls").alias("near"))
        )
        spread = labels.join(seen, "id").select("id", F.least("cls", "near").alias("new"), "cls")
        jump = labels.select(F.col("id").alias("new"), F.col("cls").alias("far"))
        nxt = stored(
            spread.join(jump, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("cls"), F.col("cls").alias("was")),
            "labels",
        )
        changed = not nxt.filter(F.col("cls") != F.col("was")).isEmpty()
        labels = nxt.select("id", "cls")
        if not changed:
            return labels


def row_key(id_col: str, text_col: str) -> Column:
    """A digest of a row's id and text."""
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit("-"))
    return F.md5(F.concat(id_text, F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: doc_id, row_key, words_key, class_id (smallest doc_id of the class), class_key.

    ``class_key`` is the smallest words_key of the class and tells classes apart also where they share their
    smallest id or have none.
    ``words_key`` is a digest of the text's words; rows of one class with the same key are copies.
    ``row_key`` is a digest of id and text.  A class whose ids are all null has a null class_id.
    """
    read = texts(df, id_col, text_col).withColumn("row_key", row_key("doc_id", "text"))
    kind = dict(read.dtypes)["doc_id"]
    schema = f"doc_id {kind}, row_key string, words_key binary, buckets array<long>, words binary"
    rows = stored(read.mapInArrow(_read, schema), "sketches")
    # Equal texts meet as one row; its id is the smallest one.
    ids = rows.groupBy("words_key").agg(F.min("doc_id").alias("id"), F.first("buckets").alias("buckets"))
    # An id that occurs with several texts must not link them: the representative is the text, not the id.
    reps = stored(ids.select("words_key", "id", F.col("buckets")).withColumn("rep", _rep("words_key")), "texts")
    member = reps.select("rep", F.explode("buckets").alias("bucket"))
    leader = member.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).filter("n > 1")
    members = stored(member.join(leader, "bucket").select("bucket", F.col("rep").alias("id"), "lead", "n"), "members")
    pairs = stored(members.filter("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    touched = members.select("id").distinct()
    words = stored(
        rows.withColumn("id", _rep("words_key")).join(touched, "id", "left_semi").select("id", "words").dropDuplicates(["id"]),
        "words",
    )
    wa, wb = (words.select(F.col("id").alias(k), F.col("words").alias(f"w{k}")) for k in "ab")
    links = stored(
        pairs.join(wa, "a").join(wb, "b").select("a", "b", "wa", "wb").mapInPandas(_verified(threshold), "a long, b long"),
        "links",
    )
    first = components(links)
    links = links.union(_rest(members, words, first, threshold))
    last = components(links)
    named = reps.join(last, reps["rep"] == last["id"], "left").select(
        "words_key", reps["id"].alias("own"), F.coalesce("cls", "rep").alias("cls")
    )
    least = named.groupBy("cls").agg(F.min("own").alias("class_id"), F.min("words_key").alias("class_key"))
    classes = named.join(least, "cls").select("words_key", "class_id", "class_key")
    return rows.select("doc_id", "row_key", "words_key").join(classes, "words_key")


def _rep(key: str) -> Column:
    """A 64-bit number for a text, for links and labels; the digest itself has 128 bits."""
    return F.xxhash64(key)


def _rest(members: DataFrame, words: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """Links between members of one bucket that the first pass left in different classes.

    The members of a bucket's largest class need not meet each other again, only the rest of the bucket.
    """
    labelled = members.filter("n > 2").join(first, "id", "left").select("bucket", "id", F.coalesce("cls", "id").alias("cls"))
    # With two members the pair was aligned already.
    sizes = labelled.groupBy("bucket", "cls").agg(F.count("*").alias("k"))
    open_ = (
        sizes.groupBy("bucket")
        .agg(F.max(F.struct("k", "cls")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("classes"))
        .filter("classes > 1")
        .select("bucket", "n", F.col("top.cls").alias("main"), F.ceil(F.col("top.k") / PART).cast("int").alias("gm"),
                F.ceil((F.col("n") - F.col("top.k")) / PART).cast("int").alias("go"))
    )
    left = labelled.join(open_, "bucket")
    small, is_main = F.col("n") <= 2 * PART, F.col("cls") == F.col("main")
    spot = F.xxhash64("id")
    part = F.when(small, 0).when(is_main, F.pmod(spot, "gm")).otherwise(F.col("gm") + F.pmod(spot, "go")).cast("int")
    last = F.col("gm") + F.col("go") - 1
    others = (
        F.when(small, F.array(F.lit(0))).when(is_main, F.sequence("gm", last)).otherwise(F.sequence(F.lit(0), last))
    )
    dealt = left.withColumn("part", part).withColumn("other", F.explode(others))
    cell = dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "id", "cls")
    # The same members meet in several buckets; each set is worked on once.
    sets = cell.groupBy("bucket", "i", "j").agg(F.sort_array(F.collect_set(F.struct("id", "cls"))).alias("m")).select("m").distinct()
    rows = sets.select(F.xxhash64("m").alias("cell"), F.explode("m").alias("m")).select("cell", "m.id", "m.cls")
    return rows.join(words, "id").groupBy("cell").applyInPandas(_in_cell(threshold), "a long, b long")


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each near-duplicate class, the one with the smallest id, with all its columns."""
    columns, key = documents.columns, "_row_key"
    while key in columns:
        key += "_"
    classes = stored(near_duplicates(documents, threshold=threshold), "classes")
    best = classes.groupBy("class_key").agg(F.min(F.struct("doc_id", "row_key")).alias("k"))
    keyed = documents.withColumn(key, row_key("doc_id", "text"))
    kept = keyed.join(best.select(F.col("k.row_key").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(*columns)
