"""UTF-8 text columns as flat byte arrays, and their words, by whole-array operations.

A task sees a text column as the bytes Arrow already holds; no Python string is made.
Batches are cut by bytes, so memory follows one slice (or one very long text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
#: Bytes whose words are hashed at a time; the arrays for it take some fifty times as much.
HASHED_BYTES = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C17)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters, all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, dtype=bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of lines.
LINE = np.ones(256, dtype=bool)
LINE[10] = False
#: Bytes of letters: A-Z, a-z, all beyond ASCII.
LETTERS = ALNUM.copy()
LETTERS[48:58] = False
# A value per byte, the same for A-Z and a-z.
_VALUE = mix(_FOLD.astype(np.uint64) + np.uint64(0x51ED270B))
_VALUE_OF = {id(kind): np.where(kind, _VALUE, np.uint64(0)) for kind in (ALNUM, SOLID, LINE, LETTERS)}


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULTIPLIER, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; NULL is empty."""
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def beside(batches: Iterator[pa.RecordBatch], struct: str, column: str, name: str) -> Iterator[pa.RecordBatch]:
    """A struct column and one of its fields beside it, without a copy of either."""
    for batch in batches:
        whole = batch.column(struct)
        yield pa.RecordBatch.from_arrays([whole, pc.struct_field(whole, column)], names=[struct, name])


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes of text, a longer text alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        # What the last batch took goes back, as the worker lives on for other tasks.
        del batch, sizes, ends
        pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z lower-cased, and how many each row has."""
    rows = len(offsets) - 1
    if rows > 1 and len(data) > HASHED_BYTES:
        # A half of the rows at a time, cut near the middle of their bytes.
        cut = min(max(int(np.searchsorted(offsets, len(data) // 2)), 1), rows - 1)
        at = offsets[cut]
        one, other = words(data[:at], offsets[: cut + 1], kind), words(data[at:], offsets[cut:] - at, kind)
        return np.concatenate((one[0], other[0])), np.concatenate((one[1], other[1]))
    inside = kind[data]
    if not inside.any():
        return np.empty(0, np.uint64), np.zeros(rows, np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    longest = int(place.max()) + 1
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    values = _VALUE_OF[id(kind)][data[starts[0] :]]
    hashes = mix(np.add.reduceat(values * powers[place], starts - starts[0]))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def spans(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and bytes of all words, and how many words each row has."""
    inside = kind[data].astype(np.int8)
    edges = np.diff(np.concatenate(([0], inside, [0])))
    # A row's end also ends a word, and the next row's start begins one.
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    joined = cut[(inside[cut - 1] == 1) & (inside[cut] == 1)] if len(cut) else cut
    starts = np.sort(np.concatenate((np.flatnonzero(edges == 1), joined)))
    ends = np.sort(np.concatenate((np.flatnonzero(edges == -1), joined)))
    return starts, ends - starts, np.diff(np.searchsorted(starts, offsets))


def prefix_hashes(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes from each start, A-Z lower-cased; the words must be as long."""
    total = np.full(len(starts), np.uint64(size))
    for j in range(size):
        total = total + _VALUE[data[starts + j]] * _POWERS[j + 1]
    return mix(total)
