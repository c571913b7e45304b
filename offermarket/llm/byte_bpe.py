"""Byte-level BPE in batches: padded matrices of pieces, one merge per row and round.

A text is cut into pieces by the tokenizer's pattern; equal pieces are encoded once.
Pieces of similar length share a matrix of token ids. In each round every row merges
its leftmost pair of minimum rank; rows without a pair that merges leave the matrix.
Ranks of pairs come from a hash table with open addressing, looked up for all rows
at once. Pieces beyond ``WIDEST`` bytes merge in the same order with a heap, which
stays fast for a piece of any length.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.llm import textbytes
from offermarket.llm.frames import REST, field, pack, unpack

NONE = np.int64(1) << 40
#: Widths of the matrices; pieces longer than the last use the heap.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256)
WIDEST = WIDTHS[-1]
#: Rows of a matrix, and pieces whose ids a task remembers before it starts afresh.
ROWS = 1 << 14
MEMORY = 1 << 18
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Ranks of a vocabulary file, as the arrays that the tasks work with."""

    pattern: str
    ranks: dict[bytes, int]
    byte_ids: np.ndarray  # id of each single byte
    keys: np.ndarray  # hash table of pairs: left id << 32 | right id, or -1
    merged: np.ndarray  # id of the merged pair, by slot
    shift: int
    pool: np.ndarray  # bytes of all tokens, one after another
    begin: np.ndarray  # of each id in the pool
    length: np.ndarray


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a file of base64 tokens and ranks. All 256 single bytes must be in it."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    pairs = {
        (ranks[token[:i]] << 32 | ranks[token[i:]]): rank
        for token, rank in ranks.items()
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    }
    bits = max(4, (4 * len(pairs)).bit_length())
    shift = 64 - bits
    keys, merged = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
    left = np.fromiter(pairs.keys(), np.int64, len(pairs))
    value = np.fromiter(pairs.values(), np.int64, len(pairs))
    slot = _slots(left, shift)
    while len(left):
        slot &= len(keys) - 1
        # Of the pairs that want a free slot, the first gets it; the others try the next.
        _, first = np.unique(slot, return_index=True)
        first = first[keys[slot[first]] < 0]
        keys[slot[first]], merged[slot[first]] = left[first], value[first]
        rest = np.ones(len(left), bool)
        rest[first] = False
        left, value, slot = left[rest], value[rest], slot[rest] + 1
    size = max(ranks.values()) + 1
    begin, length = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at = 0
    for token, rank in ranks.items():
        begin[rank], length[rank] = at, len(token)
        at += len(token)
    pool = np.frombuffer(b"".join(ranks), np.uint8)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    return Vocabulary(pattern, ranks, byte_ids, keys, merged, shift, pool, begin, length)


def _slots(keys: np.ndarray, shift: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(shift)).astype(np.int64)


def pair_ranks(vocabulary: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair of ids, NONE where they don't merge; negative ids are padding."""
    out = np.full(len(left), NONE)
    open_ = np.flatnonzero((left >= 0) & (right >= 0))
    key = left[open_] << 32 | right[open_]
    slot = _slots(key, vocabulary.shift)
    while len(open_):
        found = vocabulary.keys[slot]
        same = found == key
        out[open_[same]] = vocabulary.merged[slot[same]]
        on = (found >= 0) & ~same
        open_, key, slot = open_[on], key[on], (slot[on] + 1) & (len(vocabulary.keys) - 1)
    return out


def merge_matrix(vocabulary: Vocabulary, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge all rows of a matrix of ids padded by -1; yields row numbers and their final ids."""
    rows = np.arange(len(ids))
    ranks = np.full((len(ids), max(ids.shape[1] - 1, 0)), NONE)
    for j in range(ranks.shape[1]):
        ranks[:, j] = pair_ranks(vocabulary, ids[:, j], ids[:, j + 1])
    while len(rows) and ranks.shape[1]:
        at = ranks.argmin(axis=1)
        lowest = ranks[np.arange(len(rows)), at]
        going = lowest < NONE
        if not going.all():
            yield rows[~going], ids[~going]
            rows, ids, ranks, at, lowest = rows[going], ids[going], ranks[going], at[going], lowest[going]
            if not len(rows):
                return
        n, width = ids.shape
        every = np.arange(n)
        ids[every, at] = lowest
        # Each row loses the right half of its pair, so the matrix stays rectangular.
        keep = np.ones((n, width), bool)
        keep[every, at + 1] = False
        ids = ids[keep].reshape(n, width - 1)
        keep = np.ones((n, width - 1), bool)
        keep[every, at] = False
        ranks = ranks[keep].reshape(n, width - 2)
        for j in (at - 1, at):
            inside = np.flatnonzero((j >= 0) & (j < width - 2))
            j = j[inside]
            ranks[inside, j] = pair_ranks(vocabulary, ids[inside, j], ids[inside, j + 1])
    if len(rows):
        yield rows, ids


def merge_long(vocabulary: Vocabulary, piece: bytes) -> np.ndarray:
    """The same merges for one long piece: lowest rank first, leftmost of equals."""
    ids = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)]
    n = len(ids)
    rank = pair_ranks(vocabulary, ids[:-1], ids[1:]).tolist() + [int(NONE)]
    ids = ids.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(rank) if r < NONE]
    heapq.heapify(heap)

    def look(i: int) -> None:
        j = after[i]
        rank[i] = int(NONE)
        if j < n:
            found = pair_ranks(vocabulary, np.array([ids[i]]), np.array([ids[j]]))
            rank[i] = int(found[0])
            if rank[i] < NONE:
                heapq.heappush(heap, (rank[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue
        gone = after[i]
        ids[i], after[i], rank[gone] = r, after[gone], -1
        if after[i] < n:
            before[after[i]] = i
        look(i)
        if before[i] >= 0:
            look(before[i])
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return np.array(out, np.int64)


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of each piece; a piece that is itself a token is that token."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    open_: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        whole = vocabulary.ranks.get(piece)
        if whole is not None:
            out[i] = np.array([whole])
        elif len(piece) > WIDEST:
            out[i] = merge_long(vocabulary, piece)
        else:
            open_.setdefault(next(w for w in WIDTHS if w >= len(piece)), []).append(i)
    for width, members in open_.items():
        for start in range(0, len(members), ROWS):
            part = members[start : start + ROWS]
            lengths = np.array([len(pieces[i]) for i in part])
            flat = np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)
            ids = np.full((len(part), width), -1, np.int64)
            ids[np.arange(width) < lengths[:, None]] = vocabulary.byte_ids[flat]
            for rows, final in merge_matrix(vocabulary, ids):
                sizes = (final >= 0).sum(axis=1).tolist()
                for row, ends, size in zip(rows.tolist(), final, sizes):
                    out[part[row]] = ends[:size].astype(np.int32)
    return out


class Encoder:
    """Encodes texts one after another and remembers short pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of each."""
        if len(self.number) > MEMORY or len(self.ids) > 8 * MEMORY:
            self.forget()
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            pieces += self.find(text)
            ends.append(len(pieces))
        new = [p for p in dict.fromkeys(pieces) if p not in self.number]
        if new:
            fresh = encode_pieces(self.vocabulary, [p.encode() for p in new])
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.begins = np.concatenate((self.begins, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, *fresh)).astype(np.int32)
        order = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[order]
        total = np.concatenate(([0], np.cumsum(sizes)))
        index = np.arange(total[-1]) + np.repeat(self.begins[order] - total[:-1], sizes)
        return self.ids[index], total[np.array(ends)]


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of the ids, one after another."""
    sizes = vocabulary.length[ids]
    total = np.cumsum(sizes)
    index = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(vocabulary.begin[ids] - total + sizes, sizes)
    return vocabulary.pool[index]


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    carry: list[str] | None = None,
    text_col: str = "text",
    name: str = "ids",
) -> DataFrame:
    """The documents with the token ids of their whole text, as ``array<int>``.

    The ids are those of the vocabulary without special tokens; NULL and empty texts
    have none. ``carry`` names the columns to return (all if left out); one with the
    result's name is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    carried = docs.columns if carry is None else carry
    rows = pack(docs, carried, _text=field(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for part in textbytes.slices(batches, "_text"):
            texts = [text or "" for text in part.column("_text").to_pylist()]
            ids, offsets = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(REST), lists], names=[REST, "_ids"])

    schema = T.StructType([rows.schema[REST], T.StructField("_ids", T.ArrayType(T.IntegerType()))])
    return unpack(rows.mapInArrow(run, schema), carried, **{name: F.col("_ids")})


def decode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    carry: list[str] | None = None,
    ids_col: str = "ids",
    name: str = "decoded",
) -> DataFrame:
    """The documents with the bytes that their token ids stand for; NULL ids are none.

    ``carry`` as for ``encode``. An id outside the vocabulary is an error.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    carried = docs.columns if carry is None else carry
    rows = pack(docs, carried, _ids=field(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            # A few rows at a time: the bytes take more room than the ids.
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                lists = part.column("_ids")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.concatenate(([0], np.cumsum(known.length[flat])))
                offsets = sizes[np.concatenate(([0], np.cumsum(counts)))]
                data = decode_ids(known, flat)
                found = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(part), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(REST), found], names=[REST, "_bytes"])

    schema = T.StructType([rows.schema[REST], T.StructField("_bytes", T.BinaryType())])
    return unpack(rows.mapInArrow(run, schema), carried, **{name: F.col("_bytes")})
