"""Ranked lexical search over posting lists blocked by the likeness of their documents.

Documents become sparse vectors over the terms that queries use. They are laid out by
a similarity key, the signs of 32 random projections of the weighted vector, and cut
into chunks of neighbours, whose rows form the index: the vectors; the posting list of
each term in that order, cut into blocks of like documents; and per block a summary,
the largest value of every coordinate over its documents, rounded up. Blocks of a few
documents have none, as it would hold as much as their vectors, and neither have the
shorter ones where a chunk's summaries would pass a fixed size. Long documents make
chunks of fewer. So a row of the index is bounded, and rows are written and read one
or a few at a time.

A search walks a query's terms from the heaviest to the lightest. It ends where the
largest values of the terms left can't reach the score to beat. A block is skipped
only if the scalar product of query and summary is below that score; documents of all
other blocks are scored exactly. The result is therefore that of a full scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.llm import textbytes
from offermarket.llm.frames import field
from offermarket.staging import stage

#: Items searched for in one pass: their terms are the coordinates, and go to every task.
ITEMS = 512
#: Documents of a chunk, and values of the matrix that its summaries are taken from, of the summaries too.
CHUNK, CELLS = 2048, 1 << 23
#: Values that the vectors of a chunk hold, unless a single document has more.
VALUES = 1 << 19
#: Values that keys are summed up of at a time.
KEYED = 1 << 17
#: Documents of a block at most, and of one that has a summary at least.
BLOCK, LEAST = 512, 32
#: Summaries hold values, all below a million, in units of this, rounded up, so that they fit a byte.
UNIT = 4096
#: Chunks searched ahead for a first score to beat.
AHEAD = 8
KEY_BITS = 32
#: A row of the index has megabytes: by Spark's own settings a writer holds a hundred rows before it looks at their bytes,
#: a reader takes a whole row group at once, and a batch for Python, of long texts too, takes 64 MB.
ROW_GROUPS = {
    "parquet.block.size": str(4 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
}
BATCH_BYTES, SMALL = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_PLANE = np.uint64(0xD1B54A32D192ED03)

_ARRAYS = ["ptr", "term", "value", "list_term", "list_max", "list_blocks", "block_ptr", "block_docs", "summary"]


def _term_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _vectors(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``doc, n, terms, counts``: all terms counted, and those of the vocabulary by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        for part in textbytes.slices(batches, "text"):
            hashes, n = textbytes.words(*textbytes.column_bytes(part.column("text")))
            row = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
            known = vocabulary[at] == hashes
            key, counts = np.unique(row[known] * size + at[known], return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * size), pa.int32())
            terms = pa.ListArray.from_arrays(offsets, pa.array(key % size, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(n, pa.int64()), terms, pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
                names=["doc", "n", "terms", "counts"],
            )

    return run


@dataclass
class Statistics:
    """What scores need of the whole corpus: documents and terms in all, and the weight of each coordinate."""

    documents: int
    length: int
    weights: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, size: int) -> Statistics:
        row = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        documents, length = int(row[0]), int(row[1])
        # One row per coordinate at most.
        held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        weights = np.zeros(size, np.int64)
        for term, df in held:
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        return cls(documents, length, weights)

    def values(self, n: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The part of a term's score that its document decides."""
        # Python's integers, as 50 * n * documents may pass 64 bits.
        m = np.array([50 + 50 * int(x) * self.documents // max(self.length, 1) for x in n], np.int64)
        return 1_000_000_000 * counts // (1000 * counts + 20 * np.repeat(m, sizes))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and how many each row has."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def _keyed(vocabulary: np.ndarray, known: Statistics) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The vectors with their values and a similarity key: alike documents share leading bits."""
    planes = np.arange(1, KEY_BITS + 1, dtype=np.uint64) * _PLANE
    signs = (textbytes.mix(vocabulary[:, None] ^ planes) >> np.uint64(63)).astype(np.float32) * 2 - 1
    signs *= known.weights[:, None].astype(np.float32) / 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, sizes = _lists(batch.column("terms"))
            counts, _ = _lists(batch.column("counts"))
            if not len(terms):
                continue
            values = known.values(batch.column("n").to_numpy(), counts, sizes)
            starts = np.cumsum(sizes) - sizes
            sums = np.empty((len(starts), KEY_BITS), np.float32)
            # Some rows at a time, as each value takes a row of numbers.
            firsts = np.flatnonzero(np.diff(starts // KEYED, prepend=-1))
            for first, last in zip(firsts, np.append(firsts[1:], len(starts))):
                part = slice(starts[first], starts[last] if last < len(starts) else len(terms))
                # The rows come without empty vectors, so that every sum is over its own terms.
                shares = signs[terms[part]] * (values[part, None].astype(np.float32) * 1e-6)
                sums[first:last] = np.add.reduceat(shares, starts[first:last] - starts[first], axis=0)
            key = ((sums > 0).astype(np.int64) << np.arange(KEY_BITS - 1, -1, -1)).sum(axis=1)
            offsets = pa.array(np.append(starts, len(terms)), pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))
            whole = pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("salt"), pa.array(key), whole, listed], names=["doc", "salt", "key", "terms", "values"]
            )

    return run


def summarised(ptr: np.ndarray, size: int) -> np.ndarray:
    """Which blocks have a summary: those of ``LEAST`` documents or more, the longest if all would pass ``CELLS`` values."""
    lengths = np.diff(ptr)
    large = lengths >= LEAST
    most = max(1, CELLS // size)
    if large.sum() > most:
        large = np.zeros(len(lengths), bool)
        large[np.argsort(-lengths, kind="stable")[:most]] = True
    return large


def _summaries(row: np.ndarray, ptr: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Per block that has a summary, the largest value of each coordinate."""
    large = np.flatnonzero(summarised(ptr, dense.shape[1]))
    out = np.empty((len(large), dense.shape[1]), np.uint8)
    for i, block in enumerate(large):
        np.max(dense[row[ptr[block] : ptr[block + 1]]], axis=0, out=out[i])
    return out


def build_chunk(ptr: np.ndarray, term: np.ndarray, value: np.ndarray, size: int, block: int = BLOCK) -> dict[str, np.ndarray]:
    """Posting lists, blocks and summaries of neighbouring vectors given row by row."""
    docs = len(ptr) - 1
    row = np.repeat(np.arange(docs), np.diff(ptr))
    dense = np.zeros((docs, size), np.uint8)
    dense[row, term] = -(-value // UNIT)
    order = np.lexsort((row, term))
    by_term, by_row = term[order], row[order]
    list_begins = np.flatnonzero(np.append(True, by_term[1:] != by_term[:-1])) if len(term) else np.empty(0, np.int64)
    lengths = np.diff(np.append(list_begins, len(term)))
    # Each list is cut into blocks of nearly equal size.
    pieces = -(-lengths // block)
    which = np.repeat(np.arange(len(lengths)), pieces)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    block_ptr = np.append(list_begins[which] + lengths[which] * inside // pieces[which], len(term))
    kind = _term_type(size)
    return {
        "ptr": ptr.astype(np.int32),
        "term": term.astype(kind),
        "value": value.astype(np.int32),
        "list_term": by_term[list_begins].astype(kind),
        "list_max": (np.maximum.reduceat(value[order], list_begins) if len(term) else value).astype(np.int32),
        "list_blocks": np.append(0, np.cumsum(pieces)).astype(np.int32),
        "block_ptr": block_ptr.astype(np.int32),
        "block_docs": by_row.astype(np.uint16),
        "summary": _summaries(by_row, block_ptr, dense),
    }


def _chunks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of their keys as rows of the index, one for each chunk."""
    docs, most = max(1, min(CHUNK, CELLS // size)), VALUES

    def index_row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        terms, sizes = _lists(whole.column("terms").combine_chunks())
        values, _ = _lists(whole.column("values").combine_chunks())
        chunk = build_chunk(np.append(0, np.cumsum(sizes)), terms.astype(np.int64), values.astype(np.int64), size)
        doc = whole.column("doc").combine_chunks()
        ids = pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), doc)
        return pa.RecordBatch.from_arrays(
            [ids, *[pa.array([chunk[name].tobytes()], pa.binary()) for name in _ARRAYS]], names=["docs", *_ARRAYS]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, values = [], 0, 0
        for batch in batches:
            ends = np.append(0, np.cumsum(_lists(batch.column("terms"))[1]))
            start = 0
            while start < batch.num_rows:
                # Rows that the chunk has room for; an empty one takes any row.
                stop = int(np.searchsorted(ends, ends[start] + most - values, side="right")) - 1
                stop = min(max(stop, start if rows else start + 1), start + docs - rows, batch.num_rows)
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    rows += stop - start
                    values += int(ends[stop] - ends[start])
                if stop < batch.num_rows:
                    yield index_row(held)
                    held, rows, values = [], 0, 0
                start = stop
        if rows:
            yield index_row(held)

    return run


@dataclass
class Query:
    """An item's coordinates from the heaviest to the lightest, and its best documents so far."""

    terms: np.ndarray
    weights: np.ndarray
    beat: int = 1
    scores: np.ndarray = attribute(default_factory=lambda: np.empty(0, np.int64))
    docs: pa.Array | None = None

    @classmethod
    def of(cls, terms: np.ndarray, weights: np.ndarray, beat: int = 1) -> Query:
        order = np.argsort(-weights[terms], kind="stable")
        heavy = order[weights[terms[order]] > 0]
        return cls(terms[heavy], weights[terms[heavy]], max(beat, 1))

    def take(self, scores: np.ndarray, docs: pa.Array, top: int) -> None:
        """Keep the best, ties by the smaller id, and raise the score to beat."""
        self.scores = np.concatenate((self.scores, scores))
        self.docs = docs if self.docs is None else pa.concat_arrays([self.docs, docs])
        if len(self.scores) > top:
            ranked = pa.table({"score": self.scores, "doc": self.docs})
            best = pc.sort_indices(ranked, [("score", "descending"), ("doc", "ascending")], null_placement="at_end")[:top]
            self.scores, self.docs = self.scores[best.to_numpy()], self.docs.take(best)
        if len(self.scores) == top:
            self.beat = max(self.beat, int(self.scores.min()))


@dataclass
class Chunk:
    """A row of the index, ready for queries."""

    docs: pa.Array
    arrays: dict[str, np.ndarray]
    size: int
    #: Blocks and scored documents met so far: skipped ones are what the summaries spare.
    met: dict[str, int] = attribute(default_factory=lambda: {"blocks": 0, "skipped": 0, "scored": 0})

    def __post_init__(self) -> None:
        a = self.arrays
        self.place = np.full(self.size, -1, np.int64)
        self.place[a["list_term"]] = np.arange(len(a["list_term"]))
        self.large = summarised(a["block_ptr"], self.size)
        self.slot = np.cumsum(self.large) - 1
        self.summary = a["summary"].reshape(-1, self.size)
        order = np.argsort(a["term"], kind="stable")
        self.values = a["value"][order].astype(np.int64)
        self.rows = a["block_docs"].astype(np.int64)
        self.list_ptr = a["block_ptr"][a["list_blocks"]].astype(np.int64)

    def bounds(self, blocks: np.ndarray, first: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What a document of each block can score with the terms from ``first`` on (blocks with summaries only)."""
        out = np.zeros(len(blocks), np.int64)
        step = max(1, (1 << 18) // max(len(terms), 1))
        for start in range(0, len(blocks), step):
            part = slice(start, start + step)
            largest = self.summary[self.slot[blocks[part], None], terms].astype(np.int64) * UNIT * weights
            out[part] = np.where(np.arange(len(terms)) >= first[part, None], largest, 0).sum(axis=1)
        return out

    def search(self, query: Query, top: int) -> None:
        here = self.place[query.terms]
        terms, weights, lists = query.terms[here >= 0], query.weights[here >= 0], here[here >= 0]
        if not len(lists):
            return
        left = np.cumsum((weights * self.arrays["list_max"][lists])[::-1])[::-1]
        sizes = self.list_ptr[lists + 1] - self.list_ptr[lists]
        picked = np.repeat(self.list_ptr[lists] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        rows, shares = self.rows[picked], self.values[picked] * np.repeat(weights, sizes)
        seen = np.zeros(len(self.docs), bool)
        best = query.scores
        beat, start, width = query.beat, 0, 1
        found, found_scores = [], []
        while start < len(lists) and left[start] >= beat:
            # Several lists at a time, more with each step; those that can't matter any more are left.
            stop = start + int((left[start : start + width] >= beat).sum())
            firsts, ends = self.arrays["list_blocks"][lists[start:stop]], self.arrays["list_blocks"][lists[start:stop] + 1]
            many = (ends - firsts).astype(np.int64)
            blocks = np.repeat(firsts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            several = self.large[blocks]
            kept = np.ones(len(blocks), bool)
            position = np.repeat(np.arange(start, stop), many)
            kept[several] = self.bounds(blocks[several], position[several], terms, weights) >= beat
            self.met["blocks"] += len(blocks)
            self.met["skipped"] += int((~kept).sum())
            blocks = blocks[kept]
            lengths = np.diff(self.arrays["block_ptr"])[blocks].astype(np.int64)
            inside = np.repeat(self.arrays["block_ptr"][blocks] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            wanted = np.zeros(len(self.docs), bool)
            wanted[self.rows[inside]] = True
            wanted &= ~seen
            seen |= wanted
            docs = np.flatnonzero(wanted)
            if len(docs):
                self.met["scored"] += len(docs)
                use = wanted[rows]
                # Sums of whole numbers below 2**53 are exact in doubles.
                scores = np.bincount(rows[use], shares[use], len(self.docs))[docs].astype(np.int64)
                enough = scores >= beat
                found.append(docs[enough])
                found_scores.append(scores[enough])
                best = np.concatenate((best, scores[enough]))
                if len(best) >= top:
                    best = np.partition(best, len(best) - top)[len(best) - top :]
                    beat = max(beat, int(best.min()))
            start, width = stop, width * 2
        if found:
            docs, scores = np.concatenate(found), np.concatenate(found_scores)
            enough = scores >= beat
            if enough.any():
                query.take(scores[enough], self.docs.take(pa.array(docs[enough])), top)


def read_chunk(batch: pa.RecordBatch, i: int, size: int) -> Chunk:
    kinds = {"term": _term_type(size), "list_term": _term_type(size), "block_docs": np.uint16, "summary": np.uint8}
    arrays = {}
    for name in _ARRAYS:
        raw = batch.column(name)[i].as_buffer()
        arrays[name] = np.frombuffer(raw, kinds.get(name, np.int32)) if raw.size else np.empty(0, kinds.get(name, np.int32))
    return Chunk(batch.column("docs")[i].values, arrays, size)


def _search(items: list[np.ndarray], weights: np.ndarray, beat: list[int], top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best documents of each item in the chunks of a task: ``top`` rows an item at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [Query.of(terms, weights, least) for terms, least in zip(items, beat)]
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = read_chunk(batch, i, len(weights))
                for query in queries:
                    chunk.search(query, top)
        for number, query in enumerate(queries):
            if query.docs is not None and len(query.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(query.scores), pa.int32()), query.docs, pa.array(query.scores)], names=["item", "doc", "score"]
                )

    return run


def build_index(vectors: DataFrame, vocabulary: np.ndarray, known: Statistics) -> DataFrame:
    """The index over all vectors that hold a coordinate, staged; each row is a chunk of like documents."""
    doc = vectors.schema["doc"]
    salted = vectors.filter(F.size("terms") > 0).withColumn("salt", F.monotonically_increasing_id())
    keyed = T.StructType([doc]).add("salt", T.LongType()).add("key", T.LongType())
    keyed = keyed.add("terms", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(T.IntegerType()))
    row = T.StructType([T.StructField("docs", T.ArrayType(doc.dataType))] + [T.StructField(name, T.BinaryType()) for name in _ARRAYS])
    # The salt parts documents of one key, so copies, however many, fill several partitions.
    laid_out = (
        salted.select("doc", "n", "terms", "counts", "salt")
        .mapInArrow(_keyed(vocabulary, known), keyed)
        .repartitionByRange("key", "salt")
        .sortWithinPartitions("key", "salt")
    )
    return stage(laid_out.mapInArrow(_chunks(len(vocabulary)), row), "search-index", ROW_GROUPS)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends rows of megabytes to Python one or a few at a time."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, SMALL)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def _best(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, beat: list[int], top: int) -> DataFrame:
    kind = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return index.mapInArrow(_search(items, weights, beat, top), schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search_items(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, top: int) -> DataFrame:
    """``item`` (its place in the list), ``rank, doc, score`` of the ``top`` documents of each item.

    A few chunks are searched ahead: the score of their ``top``-th document is one that
    all others have to reach, whichever chunks they are.
    """
    chunks = index.count()
    beat = [1] * len(items)
    with small_batches(index.sparkSession):
        ahead = _best(index.sample(False, min(1.0, AHEAD / max(chunks, 1)), 7), items, weights, [1] * len(items), top)
        for item, score in ahead.filter(F.col("rank") == top).select("item", "score").collect():
            beat[item] = score
        # Staged, as the setting holds only here: ``top`` rows an item.
        return stage(_best(index, items, weights, beat, top), "search-found")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        hashes, n = textbytes.words(*textbytes.column_bytes(part.column("text")))
        offsets = np.append(0, np.cumsum(n))
        lists = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [part.column("item_id"), pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64()))], names=["item_id", "terms"]
        )


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The ``top`` best documents of each item: ``item_id, rank, doc_id, score``.

    Terms are words as in ``textbytes.ALNUM`` with A-Z lower-cased; a NULL text has
    none. With N documents that hold a term, L terms in them, n terms in the document,
    df documents with the term and tf times in this one, a term weighs
    floor(1000 ln((2N + 2) / (2df + 1))) and scores that times
    10^9 tf div (1000 tf + 20 m), where m = 50 + 50 n N div L. An item's terms count
    once each. Documents of score 0 are no results; equal scores are ranked by the smaller
    id, NULL last. Rows that repeat an id are documents of their own. Items that
    repeat id and text are one item; an item without terms has no results. Other columns
    play no part. Items are searched in passes of about ``ITEMS``, each with an index over the terms
    of its own items.
    """
    texts = docs.select(field(id_col).alias("doc"), F.coalesce(field(text_col), F.lit("")).alias("text"))
    wanted = items.select(field(item_col).alias("item_id"), F.coalesce(field(item_text_col), F.lit("")).alias("text")).distinct()
    schema = T.StructType([wanted.schema["item_id"]]).add("terms", T.ArrayType(T.LongType()))
    listed = stage(wanted.mapInArrow(_item_terms, schema).filter(F.size("terms") > 0), "search-items")
    passes = max(1, -(-listed.count() // ITEMS))
    part = F.pmod(F.xxhash64("item_id", "terms"), F.lit(passes))
    result = None
    for number in range(passes):
        some = listed.filter(part == number).orderBy("item_id", F.xxhash64("terms")).collect()
        found = _one_pass(texts, [row["item_id"] for row in some], [np.array(row["terms"], np.int64).view(np.uint64) for row in some], top, listed)
        result = found if result is None else result.unionByName(found)
    return result


def _one_pass(texts: DataFrame, ids: list, terms: list[np.ndarray], top: int, listed: DataFrame) -> DataFrame:
    spark = texts.sparkSession
    numbers = T.StructType([T.StructField("item", T.IntegerType()), listed.schema["item_id"]])
    named = spark.createDataFrame(list(enumerate(ids)), numbers)
    vocabulary = np.unique(np.concatenate([np.zeros(1, np.uint64), *terms]))
    doc = texts.schema["doc"]
    counted = T.StructType([doc]).add("n", T.LongType()).add("terms", T.ArrayType(T.IntegerType())).add("counts", T.ArrayType(T.LongType()))
    with small_batches(spark):
        vectors = stage(texts.mapInArrow(_vectors(vocabulary), counted), "search-vectors")
        known = Statistics.of(vectors, len(vocabulary))
        index = build_index(vectors, vocabulary, known)
    found = search_items(index, [np.searchsorted(vocabulary, t) for t in terms], known.weights, top)
    # As many rows as items of a pass.
    return found.join(F.broadcast(named), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score"
    )
