"""Documents packed into sequences of a fixed length, in order, with little padding.

The documents are put into the order of their ids and their tokens form one stream per block.  A stream
is cut into sequences by dynamic programming over the places where a cut may fall: the end of a document
(free), the end of a sentence (a small penalty) and, within a sentence longer than ``GAP`` tokens, every
``GAP`` tokens (a larger one).  The cost of a sequence is its padding; a length that is a power of two needs
none.  The best earlier cut within reach is the head of a monotone queue, so a place costs constant time;
earlier places at a distance of a power of two, from ``LEAST_POWER``, are looked at besides.

Edge cases: a null text is empty and is packed as its end token alone; very long documents are cut into as
many pieces as needed; rows with the same id are packed one after the other; an empty table gives an empty
result.  Columns beside id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import texts

LENGTH = 2048
END = 1
SENTENCE_CUT = 1.0  # tokens of padding that one cut at a sentence's end is worth
FORCED_CUT = 16.0
GAP = 64  # in a sentence longer than this, every so many tokens are a place for such a cut
LEAST_POWER = 256  # shorter powers of two are not looked for
BLOCK_BYTES = 24_000_000  # text of one block, about
STREAM_TOKENS = 500_000  # tokens that are packed at a time within a block
CACHE_BYTES = 32_000_000  # of known words in a task, before a batch; they are forgotten at its end
WORD_BYTES = 150  # that a known word takes beside its letters and ids
SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Token ids of texts, by the given tokenizer; each different piece between blanks is looked at once a batch.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its
    pieces.  It takes ASCII in lower case and a final mark after a letter by itself, and so do the lookups.
    Words of plain letters go to its model at once, all others through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        """Forget all words; word k has the ids ``flat[first[k] : first[k + 1]]``."""
        self.words: dict[str, int] = {"": 0}
        self.flat, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 1
        self.held = 0  # bytes, about

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        lengths = np.array([len(x) for x in ids], np.int64)
        added = np.array([i for x in ids for i in x], np.uint32)
        begin, used = self.size, int(self.first[self.size])
        while used + len(added) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while begin + len(words) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.flat[used : used + len(added)] = added
        self.first[begin + 1 : begin + len(words) + 1] = used + np.cumsum(lengths)
        self.size += len(words)
        self.held += WORD_BYTES * len(words) + sum(map(len, words)) + added.nbytes
        self.words.update(zip(words, range(begin, begin + len(words))))

    def _learn(self, words: list[str]) -> None:
        # Letters below U+0130 are composed as they are and have one lower-case letter each.
        plain = [w for w in words if w.isalpha() and max(w) < "\u0130"]
        model, letters = self.tokenizer.model, self.letters
        self._add(
            plain, [[t.id for t in model.tokenize(w.lower().encode().decode("latin-1").translate(letters))] for w in plain]
        )
        done = set(plain)
        others = [w for w in words if w not in done]
        self._add(others, [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else [])

    def _gather(self, flat: np.ndarray, first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries at ``places``, one after the other, and how many each has."""
        begin = first[places]
        lengths = first[places + 1] - begin
        begin -= np.cumsum(lengths) - lengths
        return flat[np.repeat(begin, lengths) + np.arange(int(lengths.sum()))], lengths

    def _numbers(self, column: pa.Array) -> np.ndarray:
        """The place of each word among the known ones; new ones are learned."""
        coded = column.dictionary_encode()
        different = coded.dictionary.to_pylist()
        new = [w for w in different if w not in self.words]
        if new:
            self._learn(new)
        found = np.fromiter(map(self.words.__getitem__, different), np.int64, len(different))
        return found[coded.indices.to_numpy(zero_copy_only=False)]

    def streams(self, batch: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > CACHE_BYTES:
            self._clear()
        rows = pc.split_pattern(pc.replace_substring(batch, "\n", " "), " ")
        coded = rows.flatten().dictionary_encode()
        pieces = coded.dictionary
        pieces = pc.if_else(pc.string_is_ascii(pieces), pc.ascii_lower(pieces), pieces)
        marked = pc.match_substring_regex(pieces, r"\pL[.,;:!?]$")
        heads = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(pieces, -1), "")
        both = np.stack([self._numbers(heads), self._numbers(marks)], axis=1).ravel()
        ids, lengths = self._gather(self.flat, self.first, both)
        first = np.r_[0, np.cumsum(lengths.reshape(-1, 2).sum(axis=1))]
        ids, lengths = self._gather(ids, first, coded.indices.to_numpy(zero_copy_only=False))
        ends = np.r_[0, np.cumsum(lengths)][rows.offsets.to_numpy()[1:] - rows.offsets[0].as_py()]
        return np.split(ids, ends[:-1])

    def sentence_ends(self) -> np.ndarray:
        """Whether a token ends a sentence, by id."""
        vocab = self.tokenizer.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            bare = token.removesuffix("</w>")
            out[i] = token.endswith("</w>") and bool(bare) and not any(c.isalnum() for c in bare) and any(c in ".!?" for c in bare)
        return out


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut and what a cut there costs; ``ends`` are the places after each document."""
    after = np.flatnonzero(sentence[ids]) + 1
    place = np.union1d(after, ends)
    gaps, step = np.diff(np.r_[0, place]), min(GAP, length)
    wide = np.flatnonzero(gaps > step)
    forced = [np.arange(place[k] - gaps[k] + step, place[k], step) for k in wide]
    place = np.union1d(place, np.concatenate(forced)) if forced else place
    cost = np.full(len(place), SENTENCE_CUT)
    cost[np.isin(place, ends, assume_unique=True)] = 0
    if forced:
        cost[np.isin(place, np.concatenate(forced)) & (cost > 0) & ~np.isin(place, after)] = FORCED_CUT
    return place, cost


def best_cuts(place: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """The cheapest cuts of a stream from 0 to the last place; no gap between places exceeds ``length``."""
    where = np.r_[0, place]
    at = np.full(int(where[-1]) + 1, -1, np.int32)
    at[where] = np.arange(len(where))
    powers = []
    power = length >> 1
    while power >= LEAST_POWER:
        powers.append(np.where(where >= power, at[np.maximum(where - power, 0)], -1).tolist())
        power >>= 1
    p, extra = where.tolist(), [0.0, *cost.tolist()]
    n = len(p)
    best, came = [0.0] * n, [0] * n
    keys, items, head = [0.0], [0], 0  # the queue: keys rise from head on
    for j in range(1, n):
        pj = p[j]
        low = pj - length
        while p[items[head]] < low:
            head += 1
        i = items[head]
        value = keys[head] + length - pj
        for prev in powers:
            k = prev[j]
            if k >= 0 and best[k] <= value:
                value, i = best[k], k
        value += extra[j]
        best[j], came[j] = value, i
        key = value + pj
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            items.pop()
        keys.append(key)
        items.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(p[j])
        j = came[j]
    return cuts[::-1]


def pieces_of(ends: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, document and sequence of each piece of a stream."""
    borders = np.union1d(ends, cuts)
    begin = np.r_[0, borders[:-1]]
    return begin, borders, np.searchsorted(ends, begin, side="right"), np.searchsorted(cuts, begin, side="right")


class _Packer:
    """Packs the documents of one block, a stream of bounded length at a time."""

    def __init__(self, sentence: np.ndarray, length: int, first_sequence: int):
        self.sentence, self.length, self.next = sentence, length, first_sequence
        self.held: list[tuple] = []  # id, ids of a part, place of the part in its document, tokens of the document
        self.tokens = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[tuple]]:
        for begin in range(0, len(ids), STREAM_TOKENS):
            part = ids[begin : begin + STREAM_TOKENS]
            self.held.append((doc_id, part, begin, len(ids)))
            self.tokens += len(part)
            if self.tokens >= STREAM_TOKENS:
                yield self.flush()

    def flush(self) -> list[tuple]:
        if not self.held:
            return []
        ids = np.concatenate([h[1] for h in self.held])
        ends = np.cumsum([len(h[1]) for h in self.held])
        cuts = best_cuts(*cut_places(ids, ends, self.sentence, self.length), self.length)
        starts, opens = np.r_[0, ends[:-1]], np.r_[0, cuts[:-1]]
        rows = []
        for b, e, d, s in zip(*(x.tolist() for x in pieces_of(ends, cuts))):
            doc_id, _, shift, total = self.held[d]
            crc = zlib.crc32(ids[b:e].astype("<u4").tobytes())
            rows.append((doc_id, int(b - starts[d] + shift), e - b, crc, total, self.next + s, int(b - opens[s])))
        self.next += len(cuts)
        self.held, self.tokens = [], 0
        return rows


_TOKENS: dict[str, tuple[WordTokens, np.ndarray]] = {}


def _tokens(path: str) -> tuple[WordTokens, np.ndarray]:
    if path not in _TOKENS:
        made = WordTokens(path)
        _TOKENS[path] = (made, made.sentence_ends())
    return _TOKENS[path]


def pack(
    documents: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    end: int = END,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence is the pieces with its ``sequence_id`` in the order of ``offset``.  Blocks are ranges of
    ids, so only the last sequence of a stream may be far from full.
    """
    rows = texts(documents, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-total // BLOCK_BYTES))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(blocks, "doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sentence = _tokens(tokenizer)
        packer = _Packer(sentence, length, TaskContext.get().partitionId() << 32)

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            types = [schema.field("doc_id").type, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=NAMES)

        schema = None
        try:
            for batch in batches:
                schema = batch.schema
                for begin in range(0, batch.num_rows, 1000):
                    part = batch.slice(begin, 1000)
                    for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.streams(part.column("text"))):
                        for found in packer.add(doc_id, np.append(ids, np.uint32(end))):
                            yield out(found)
            found = packer.flush()
            if found:
                yield out(found)
        finally:
            words._clear()  # the process outlives the task and may serve other stages

    return ordered.sortWithinPartitions("doc_id", "tie").mapInArrow(run, SCHEMA.format(kind))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
