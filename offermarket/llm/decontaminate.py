"""Benchmark decontamination by suffix arrays over the training text.

Each task turns its documents into shards of word hashes and sorts a suffix array
for each. The benchmark comes in blocks; every suffix of every item is searched for
in every shard, which gives all places of its window; neighbouring places join up to
the longest verbatim matches. A document never leaves its task: nothing is shuffled,
however often a passage occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.llm import textbytes
from offermarket.llm.frames import REST, field, pack

#: Words of a window, bytes of a shard's text, and bytes of a block of benchmark texts.
WINDOW = 10
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20

RESULTS = ["n_words", "n_hit", "items", "matches"]
MATCH = T.ArrayType(
    T.StructType(
        [
            T.StructField("item", T.StringType()),
            T.StructField("item_start", T.IntegerType()),
            T.StructField("doc_start", T.IntegerType()),
            T.StructField("n_words", T.IntegerType()),
        ]
    )
)


@dataclass
class Block:
    """Words of some benchmark items, one after another."""

    ids: list[str]
    words: np.ndarray
    item: np.ndarray  # of each word
    left: np.ndarray  # words of the item from this one on
    window: np.ndarray  # of the word's item: WINDOW, or the item's words if fewer


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``limit`` bytes; only one passes the driver at a time."""
    rows = benchmark.select(
        F.coalesce(field(id_col).cast("string"), F.lit("null")), F.coalesce(field(text_col), F.lit(""))
    )
    ids: list[str] = []
    texts: list[str] = []
    size = 0
    for item, text in rows.toLocalIterator(prefetchPartitions=False):
        ids.append(item)
        texts.append(text)
        size += len(text)
        if size >= limit:
            yield _block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield _block(ids, texts)


def _block(ids: list[str], texts: list[str]) -> Block:
    hashes, counts = textbytes.words(*textbytes.column_bytes(pa.array(texts, pa.large_string())))
    item = np.repeat(np.arange(len(ids)), counts)
    ends = np.cumsum(counts)
    left = ends[item] - np.arange(len(hashes))
    return Block(ids, hashes, item, left, np.minimum(counts, WINDOW)[item])


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; only ties are sorted again.

    Each text in ``symbols`` must end in a symbol that occurs nowhere else.
    """
    order = np.argsort(symbols, kind="stable")
    found = symbols[order]
    rank = np.empty(len(symbols), np.int64)
    new = np.append(True, found[1:] != found[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(order)))
    rank[order] = np.repeat(heads, sizes)
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    depth, n = 1, len(symbols)
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[at + depth]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        new = np.append(True, key[1:] != key[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(tied)))
        # The slots of a tied group are neighbours in the array, so its heads keep their places.
        rank[at] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order


def _bound(symbols, order, lo, hi, depth, wanted, right: bool) -> np.ndarray:
    """First place in [lo, hi) whose symbol at ``depth`` is not below (or is above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        seen = symbols[order[mid] + depth]
        less = seen <= wanted[open_] if right else seen < wanted[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]


def search(symbols: np.ndarray, order: np.ndarray, known: np.ndarray, base: int, block: Block):
    """For every suffix of every item, the interval of the suffix array that begins with its window.

    The interval is narrowed by a binary search per word; suffixes whose interval is
    empty drop out. An occurrence beyond the window is one of the next suffix as well.
    """
    n = len(block.words)
    place = np.searchsorted(known, block.words)
    there = place < len(known)
    there[there] = known[place[there]] == block.words[there]
    symbol = np.where(there, place + base, -1)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    window_lo, window_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    active, depth = np.arange(n), 0
    while len(active):
        active = active[(block.left[active] > depth) & (block.window[active] > depth)]
        active = active[symbol[active + depth] >= 0]
        if not len(active):
            break
        wanted = symbol[active + depth]
        first = _bound(symbols, order, lo[active], hi[active], depth, wanted, right=False)
        last = _bound(symbols, order, first, hi[active], depth, wanted, right=True)
        held = first < last
        active, first, last = active[held], first[held], last[held]
        lo[active], hi[active] = first, last
        depth += 1
        whole = active[block.window[active] == depth]
        window_lo[whole], window_hi[whole] = lo[whole], hi[whole]
    return window_lo, window_hi


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the given ranges one after another, and which range each is from."""
    sizes = hi - lo
    which = np.repeat(np.arange(len(lo)), sizes)
    begin = np.cumsum(sizes) - sizes
    return np.arange(len(which)) - begin[which] + lo[which], which


def match_shard(hashes: np.ndarray, counts: np.ndarray, blocks: list) -> dict[str, list]:
    """What the blocks find in the documents with these words."""
    docs = len(counts)
    known, inverse = np.unique(hashes, return_inverse=True)
    # Documents follow each other, each with an end of its own: symbols 0 .. docs-1.
    starts = np.cumsum(counts + 1) - (counts + 1)
    doc_of = np.repeat(np.arange(docs), counts + 1)
    symbols = np.empty(len(hashes) + docs, np.int64)
    ends = starts + counts
    is_word = np.ones(len(symbols), bool)
    is_word[ends] = False
    symbols[is_word] = inverse + docs
    symbols[ends] = np.arange(docs)
    order = suffix_array(symbols)
    covered = np.zeros(len(symbols) + 1, np.int64)
    items: list[list[str]] = [[] for _ in range(docs)]
    matches: list[list[dict]] = [[] for _ in range(docs)]
    for shared in blocks:
        block = shared.value
        lo, hi = search(symbols, order, known, docs, block)
        at, suffix = _ranges(lo, hi)
        at = order[at]
        if not len(at):
            continue
        width = block.window[suffix]
        covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + width, minlength=len(covered))
        # Windows that continue one another, in the item and in the document, are one match.
        doc, item = doc_of[at], block.item[suffix]
        by = np.lexsort((suffix, at - suffix, item, doc))
        doc, item, at, suffix, width = doc[by], item[by], at[by], suffix[by], width[by]
        new = np.ones(len(at), bool)
        new[1:] = (
            (doc[1:] != doc[:-1])
            | (item[1:] != item[:-1])
            | (at[1:] - suffix[1:] != at[:-1] - suffix[:-1])
            | (suffix[1:] != suffix[:-1] + 1)
        )
        heads = np.flatnonzero(new)
        runs = np.diff(np.append(heads, len(at)))
        first_word = np.searchsorted(block.item, np.arange(len(block.ids)))
        for d, i, s, p, w, r in zip(
            doc[heads].tolist(),
            item[heads].tolist(),
            (suffix[heads] - first_word[item[heads]]).tolist(),
            (at[heads] - starts[doc[heads]]).tolist(),
            width[heads].tolist(),
            runs.tolist(),
        ):
            items[d].append(block.ids[i])
            matches[d].append({"item": block.ids[i], "item_start": s, "doc_start": p, "n_words": w + r - 1})
    hit = (np.cumsum(covered)[:-1] > 0) & is_word
    return {
        "n_words": counts.tolist(),
        "n_hit": np.bincount(doc_of[hit], minlength=docs).tolist(),
        "items": [sorted(set(found)) for found in items],
        "matches": matches,
    }


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str] | None = None,
    id_col: str = "item_id",
    item_text_col: str = "text",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: ``n_words, n_hit, items, matches`` against the whole benchmark.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A window is ten
    words in a row of an item, or a shorter item as a whole; a document word inside an
    occurring window is hit. ``items`` are the ids of items with occurring windows in
    order, ``matches`` the maximal verbatim matches with their places in words. NULL and
    empty texts have no words, a NULL item id reads ``null``, items with the same id
    count once, and an empty benchmark hits nothing. ``carry`` names the document
    columns to return (all if left out); those with names of results are replaced.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    texts = docs.select(*[field(c) for c in carried], field(text_col).alias("_text"))
    return _match(texts, benchmark, carried, None, id_col, item_text_col, block_bytes)


def _match(
    texts: DataFrame,
    benchmark: DataFrame,
    carried: list[str],
    inner: str | None,
    id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The matches of texts in ``_text``, or in the field ``inner`` of the only carried struct."""
    results = RESULTS
    context = texts.sparkSession.sparkContext
    blocks = [context.broadcast(block) for block in blocks_of(benchmark, id_col, item_text_col, block_bytes)]
    found = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("matches", MATCH),
        ]
    )
    types = [
        pa.int64(),
        pa.int64(),
        pa.list_(pa.string()),
        pa.list_(
            pa.struct(
                [
                    ("item", pa.string()),
                    ("item_start", pa.int32()),
                    ("doc_start", pa.int32()),
                    ("n_words", pa.int32()),
                ]
            )
        ),
    ]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = batches if inner is None else textbytes.beside(batches, carried[0], inner, "_text")
        for part in textbytes.slices(named, "_text", SHARD_BYTES):
            data, offsets = textbytes.column_bytes(part.column("_text"))
            got = match_shard(*textbytes.words(data, offsets), blocks)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in carried] + [pa.array(got[n], t) for n, t in zip(results, types)],
                names=carried + results,
            )

    schema = T.StructType([texts.schema[c] for c in carried] + found.fields)
    return texts.mapInArrow(match, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any window of the benchmark, with their own columns only."""
    clean = _match(pack(docs), benchmark, [REST], text_col, **options).filter(F.col("n_hit") == 0)
    return clean.select(*[F.col(REST).getField(c).alias(c) for c in docs.columns])
