"""MinHash near-dedup with DartMinHash signatures and banded joining.

A document is the set of its five-word shingles; equal sets are one node from the
start, so groups of copies meet in one row. Each shingle owns a plane of weight by
rank, cut into unit cells, and a hash throws a Poisson number of darts into each
cell. A dart has a coordinate, a rank and a height; those below the shingle's weight
count, and every coordinate keeps its earliest dart. Bands of coordinates are
joined, and every link is checked by the exact similarity of the sets.

Each member of a bucket is first compared with the smallest of it, and links found
so join into components. In buckets that still hold several components, all pairs of
members of two components are compared, in blocks of up to ``BLOCK`` members. What is
compared are sketches whose parities rule a pair out for sure; pairs that they allow
are rows, and checked by the exact similarity. Of the pairs of two components in a bucket
the likeliest are checked first, and the others only where these don't join the two, so
a component costs few rows however many copies it has, and no pair of a bucket is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.llm import textbytes
from offermarket.llm.components import components
from offermarket.llm.frames import REST, field, pack, unpack
from offermarket.skew import hot_join
from offermarket.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
ROUNDING = 1e-6
#: Coordinates, bands and coordinates of a band: a pair at 0.8 shares no band in 5 of a million cases.
COORDINATES = 256
BANDS, WIDTH = 40, 6
#: Of 256 one-bit coordinates, pairs at 0.8 agree in 230 on average; under 207 in three of a million cases.
LEAST_BITS = 207
#: 64-bit words of the parity sketch of a set.
PARITY_WORDS = 16
#: Pairs of two components in a bucket that are checked first, as the likeliest to join them.
CENTRES = 4
#: Members of a mixed bucket, and rows of small mixed buckets, that a task compares at a time.
BLOCK, TOGETHER = 1 << 12, 1 << 13
#: Pairs of sketches compared at a time.
PAIRS = 1 << 16
#: Shingles and cells worked on at a time.
CHUNK = 1 << 15
#: Slots of the broadcast list that spares a shuffle of texts: 2**20 integers at most.
SLOTS = 1 << 20

# Darts of a cell by its hash: a Poisson number of mean 1, from the inverse of its distribution.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_CELL, _DART, _RANK = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes per row, and how many. A row of fewer words is one shingle."""
    rows = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))
    first = np.repeat(np.cumsum(counts) - counts, counts)
    start = np.flatnonzero((left >= size) | (np.arange(len(words)) == first))
    value = np.full(len(start), np.uint64(size))
    for k in range(size):
        has = np.minimum(start + k, max(len(words) - 1, 0))
        value = np.where(left[start] > k, textbytes.mix(value * np.uint64(31) + words[has]), value)
    row = rows[start]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.bincount(row, minlength=len(counts))


def _throw(best: np.ndarray, row: np.ndarray, element: np.ndarray, weight: np.ndarray, ranks: np.ndarray) -> None:
    """Throw the darts of the given cells of rank and lower ``best`` where one comes earlier."""
    layers = np.ceil(weight).astype(np.int64)
    for start in range(0, len(element), CHUNK):
        part = slice(start, start + CHUNK)
        # One cell for each unit of weight.
        at = np.repeat(np.arange(start, start + len(element[part])), layers[part])
        layer = np.arange(len(at)) - np.repeat(np.cumsum(layers[part]) - layers[part], layers[part])
        cell = textbytes.mix(element[at] + ranks[at].astype(np.uint64) * _RANK + layer.astype(np.uint64) * _CELL)
        number = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * 2.0**-53, side="right")
        dart = np.repeat(np.arange(len(at)), number)
        which = np.arange(len(dart)) - np.repeat(np.cumsum(number) - number, number)
        hashed = textbytes.mix(cell[dart] + (which.astype(np.uint64) + np.uint64(1)) * _DART)
        owner = at[dart]
        below = weight[owner] - layer[dart]
        if (below < 1).any():
            height = (textbytes.mix(hashed) >> np.uint64(11)) * 2.0**-53
            kept = height < below
            hashed, owner = hashed[kept], owner[kept]
        coordinate = (hashed >> np.uint64(56)).astype(np.int64) % COORDINATES
        # The rank: its cell, then the place inside it, which also tells darts apart.
        rank = (ranks[owner].astype(np.uint64) << np.uint64(44)) | ((hashed & np.uint64((1 << 56) - 1)) >> np.uint64(12))
        np.minimum.at(best, row[owner] * COORDINATES + coordinate, rank)


def signatures(elements: np.ndarray, counts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash of weighted sets: a row of ``COORDINATES`` ranks for each; rows without elements stay at the top."""
    empty = np.uint64((1 << 64) - 1)
    rows = len(counts)
    best = np.full(rows * COORDINATES, empty)
    weights = np.ones(len(elements)) if weights is None else weights
    row = np.repeat(np.arange(rows), counts)
    total = np.bincount(row, weights=weights, minlength=rows)
    # So many cells of rank that few rows miss a coordinate; those go on with as many more.
    step = np.ceil(COORDINATES * (math.log(COORDINATES) + 3) / np.maximum(total, 1e-9)).astype(np.int64)
    done = np.zeros(rows, np.int64)
    open_ = total > 0
    while open_.any():
        chosen = np.flatnonzero(open_[row])
        repeats = step[row[chosen]]
        # A piece at a time, so that memory doesn't follow the number of cells.
        ends = np.cumsum(repeats)
        begin = 0
        while begin < len(chosen):
            base = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
            some = chosen[begin:stop]
            many = repeats[begin:stop]
            at = np.repeat(some, many)
            rank = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + done[row[at]]
            _throw(best, row[at], elements[at], weights[at], rank)
            begin = stop
        done[open_] += step[open_]
        missing = (best.reshape(rows, COORDINATES) == empty).any(axis=1)
        open_ &= missing
    return best.reshape(rows, COORDINATES)


def _bands(signature: np.ndarray) -> np.ndarray:
    out = np.empty((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        value = np.full(len(signature), np.uint64(band + 1))
        for j in range(band * WIDTH, (band + 1) * WIDTH):
            value = textbytes.mix(value * np.uint64(31) + signature[:, j])
        out[:, band] = value
    return out.view(np.int64)


def _sketch(signature: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, in 64-bit integers."""
    bits = (textbytes.mix(signature) & np.uint64(1)).astype(np.uint64).reshape(len(signature), -1, 64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def _node(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """128 bits of each set, from two sums over its elements."""
    row = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros((len(counts), 2), np.uint64)
    np.add.at(out[:, 0], row, textbytes.mix(values + np.uint64(1)))
    np.add.at(out[:, 1], row, textbytes.mix(values ^ np.uint64(0x5DEECE66D)))
    return pa.array([key.tobytes() for key in out], pa.binary())


def _sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text. One without a word is a shingle as a whole, so that equal ones meet."""
    values, counts = shingles(*textbytes.words(*textbytes.column_bytes(part.column("text"))))
    bare = np.flatnonzero(counts == 0)
    keys = part.column("text_key").to_numpy().view(np.uint64)[bare]
    values = np.insert(values, np.cumsum(counts)[bare], textbytes.mix(keys ^ np.uint64(0x2545F4914F6CDD1D)))
    counts[bare] = 1
    return values, counts


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        values, counts = _sets(part)
        signature = signatures(values, counts)

        def lists(table: np.ndarray) -> pa.Array:
            offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))

        yield pa.RecordBatch.from_arrays(
            [
                part.column(REST),
                part.column("doc"),
                part.column("uid"),
                part.column("text_key"),
                _node(values, counts),
                pa.array(counts, pa.int64()),
                lists(_bands(signature)),
                lists(_sketch(signature)),
            ],
            names=[REST, "doc", "uid", "text_key", "node", "n", "bands", "sketch"],
        )


def _parities(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per set, the parity of how many elements fall on each of ``64 * PARITY_WORDS`` bits."""
    width = 64 * PARITY_WORDS
    row = np.repeat(np.arange(len(counts)), counts)
    place = (textbytes.mix(values ^ np.uint64(0x3C6EF372)) % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(row * width + place, minlength=len(counts) * width) & 1).astype(np.uint64)
    words = odd.reshape(len(counts), PARITY_WORDS, 64) << np.arange(64, dtype=np.uint64)
    return words.sum(axis=2, dtype=np.uint64).view(np.int64)


def _list_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "text"):
        values, counts = _sets(part)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
        where = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * PARITY_WORDS)
        parities = pa.ListArray.from_arrays(where, pa.array(_parities(values, counts).ravel()))
        yield pa.RecordBatch.from_arrays(
            [_node(values, counts), lists, parities], names=["node", "shingles", "parity"]
        )


def _may_be_similar(x: Column, y: Column) -> Column:
    """What the sizes and one-bit sketches of two nodes allow."""
    fits = F.least(x["n"], y["n"]) >= SIMILARITY * F.greatest(x["n"], y["n"]) - ROUNDING
    differing = sum(F.bit_count(x["sketch"][i].bitwiseXOR(y["sketch"][i])) for i in range(COORDINATES // 64))
    return fits & (COORDINATES - differing >= LEAST_BITS)


def _common_needed(size: Column, other: Column) -> Column:
    """Shingles that sets of these sizes must share to be similar."""
    return SIMILARITY / (1 + SIMILARITY) * (size + other) - ROUNDING


def _shingle_sets(wanted: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, shingles, parity`` of the wanted nodes, read again from one or more of their texts."""
    keys = stage(nodes.join(wanted, "node", "left_semi").select("node", "text_key"), "wanted-texts")
    slot = F.pmod("text_key", F.lit(SLOTS)).cast("int")
    # The list of slots has a fixed largest size; chance company costs a tokenisation, no more.
    slots = F.broadcast(keys.select(slot.alias("slot")).distinct())
    sets = (
        texts.withColumn("slot", slot)
        .join(slots, "slot", "left_semi")
        .select("text", "text_key")
        .mapInArrow(_list_shingles, "node binary, shingles array<bigint>, parity array<bigint>")
        .join(wanted, "node", "left_semi")
        .groupBy("node")
        .agg(F.any_value("shingles").alias("shingles"), F.any_value("parity").alias("parity"))
    )
    return stage(sets, "shingle-sets")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the node pairs ``a, b``, those whose sets have the similarity asked for."""
    rows = pairs
    for end, other in (("a", "b"), ("b", "a")):
        counts = stage(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n_rows")), "pair-counts")
        named = sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}"))
        rows = hot_join(rows, named, counts, [end], [other])
    common = F.size(F.array_intersect("set_a", "set_b"))
    enough = common >= _common_needed(F.size("set_a"), F.size("set_b"))
    return stage(rows.filter(enough).select("a", "b"), "links")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Buckets that still hold several labels, with their rows."""
    sizes = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n_rows"))
    return found.filter("labels > 1")


def _open_rows(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that are still mixed, and the rows of each such bucket."""
    whole = stage(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    mixed = stage(_mixed(whole).select("band", "n_rows"), "mixed")
    rows = hot_join(whole.select("band", "node"), mixed, mixed, ["band"], ["node"])
    return stage(rows, "open"), mixed


def _relabelled(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels after some more links, each between nodes of two components.

    Only the labels that the links join take part in the search for components, so its
    cost follows the new links. A label is the smallest node of its component and stays that.
    """
    named = links
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        named = named.join(own, end, "left").withColumn(f"label_{end}", F.coalesce(f"label_{end}", end))
    merged = components(named.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
    merged = stage(merged.select(F.col("node").alias("label"), F.col("label").alias("now")), f"{name}-merged")
    kept = labels.join(merged, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return stage(kept.unionByName(merged.select(F.col("label").alias("node"), F.col("now").alias("label"))), f"{name}-labels")


def _allowed(values: dict, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of some pairs of members, those that sizes and parities allow to be similar, and how far they differ at least."""
    n, parity = values["n"], values["parity"]
    x, y = n[rows], n[columns]
    kept = np.flatnonzero(np.minimum(x, y) >= SIMILARITY * np.maximum(x, y) - ROUNDING)
    total = np.zeros(len(kept))
    # Each differing bit takes an element of one set alone, so too many of them rule a pair out for sure.
    for words in (slice(0, 4), slice(4, PARITY_WORDS)):
        r, c = rows[kept], columns[kept]
        total = total + np.bitwise_count(parity[r, words] ^ parity[c, words]).sum(axis=1)
        size = n[r] + n[c]
        few = total <= size - 2 * (SIMILARITY / (1 + SIMILARITY) * size - ROUNDING)
        kept, total = kept[few], total[few]
    return kept, total / np.maximum(n[rows[kept]] + n[columns[kept]], 1)


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _likeliest(found: Found, label: np.ndarray, most: int) -> Found:
    """Of the pairs of each two components the ``most`` that differ least, marked where others are put off."""
    rows, columns, differing, more = found
    x, y = label[rows], label[columns]
    two = np.minimum(x, y) * len(label) + np.maximum(x, y)
    order = np.lexsort((differing, two))
    two = two[order]
    starts = np.flatnonzero(np.concatenate(([True], two[1:] != two[:-1])))[: len(two)]
    sizes = np.diff(np.append(starts, len(two)))
    place = np.arange(len(two)) - np.repeat(starts, sizes)
    put_off = np.logical_or.reduceat(more[order], starts) if len(two) else more
    marked = np.repeat(put_off | (sizes > most), sizes) if len(two) else more
    kept = order[place < most]
    return rows[kept], columns[kept], differing[kept], marked[place < most]


def _compared(values: dict, left: np.ndarray, right: np.ndarray, most: int | None) -> Found:
    """Pairs of a left and a right member of two components that may be similar, how far they differ, and whether others were put off.

    With ``most``, so many of each two components, those that differ least.
    """
    label = values["label"]
    none = np.empty(0, np.int64)
    found = (none, none, np.empty(0), np.empty(0, bool))
    names, counts = np.unique(label[np.concatenate((left, right))], return_counts=True)
    if len(names) < 2:
        return found
    # Pairs inside the largest component need no look.
    largest = names[np.argmax(counts)]
    sides = [(left[label[left] != largest], right)]
    if left is not right:
        sides.append((left[label[left] == largest], right[label[right] != largest]))
    parts = [found]
    for one, other in sides:
        step = max(1, PAIRS // max(len(other), 1))
        for start in range(0, len(one), step):
            some = one[start : start + step]
            rows, columns = np.repeat(some, len(other)), np.tile(other, len(some))
            # A pair that comes both ways is one.
            twice = (label[columns] != largest) & (rows > columns) if left is right else False
            apart = (label[rows] != label[columns]) & ~np.broadcast_to(twice, rows.shape)
            rows, columns = rows[apart], columns[apart]
            kept, differing = _allowed(values, rows, columns)
            part = (rows[kept], columns[kept], differing, np.zeros(len(kept), bool))
            parts.append(part if most is None else _likeliest(part, label, most))
    found = tuple(np.concatenate(column) for column in zip(*parts))
    return found if most is None else _likeliest(found, label, most)


def _compare(most: int | None):
    """For ``applyInArrow``: the possible pairs of two blocks of a bucket, or of some small buckets."""

    def compare(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        parity = pc.list_flatten(part.column("parity")).to_numpy().view(np.uint64).reshape(-1, PARITY_WORDS)
        label = pc.dictionary_encode(part.column("label")).combine_chunks().indices.to_numpy().astype(np.int64)
        values = {"n": part.column("n").to_numpy(), "parity": parity, "label": label}
        low, high, block = (part.column(name).to_numpy() for name in ("low", "high", "block"))
        if low[0] < 0:
            band = part.column("band").to_numpy()
            order = np.argsort(band, kind="stable")
            ends = np.flatnonzero(np.append(band[order][1:] != band[order][:-1], True)) + 1
            sides = [(one, one) for one in np.split(order, ends[:-1])]
        else:
            left = np.flatnonzero(block == low[0])
            sides = [(left, left if low[0] == high[0] else np.flatnonzero(block == high[0]))]
        found = [_compared(values, left, right, most) for left, right in sides]
        rows, columns, _, more = (np.concatenate(parts) for parts in zip(*found))
        node = part.column("node")
        return pa.table({"one": node.take(pa.array(rows)), "other": node.take(pa.array(columns)), "more": pa.array(more)})

    return compare


def _possible_pairs(rows: DataFrame, n_rows: int, most: int | None) -> DataFrame:
    """Node pairs ``a, b`` of two components that share a mixed bucket and may be similar; ``more`` if others were put off.

    Each two blocks of a bucket are a group of their own; buckets of up to ``BLOCK`` members
    are grouped together. So a group has a largest size, whatever a bucket holds.
    """
    blocks = F.ceil(F.col("n_rows") / BLOCK).cast("int")
    dealt = rows.withColumn("block", F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(-1).cast("int"))
    met = F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1)))
    paired = dealt.withColumn("met", F.explode(met))
    small = F.pmod(F.xxhash64("band"), F.lit(max(1, -(-n_rows // TOGETHER))))
    grouped = paired.select(
        F.when(F.col("block") < 0, small).otherwise(F.col("band")).alias("bucket"),
        F.least("block", "met").alias("low"),
        F.greatest("block", "met").alias("high"),
        "band", "block", "node", "label", "n", "parity",
    ).groupBy("bucket", "low", "high")
    pairs = grouped.applyInArrow(_compare(most), "one binary, other binary, more boolean")
    ends = [F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")]
    return stage(pairs.groupBy(*ends).agg(F.max("more").alias("more")), "possible-pairs")


def _join_mixed(members: DataFrame, labels: DataFrame, texts: DataFrame, nodes: DataFrame, exact: bool) -> DataFrame:
    """``labels`` after all links in the buckets that these leave mixed."""
    open_rows, mixed = _open_rows(members, labels)
    n_rows = mixed.agg(F.sum("n_rows")).first()[0]
    if n_rows is None:
        return labels
    sets = _shingle_sets(stage(open_rows.select("node").distinct(), "open-nodes"), texts, nodes)
    slim = nodes.select("node", "n").join(sets.select("node", "parity"), "node")
    for most in [None] if exact else [CENTRES, None]:
        now = slim.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pairs = _possible_pairs(open_rows.join(now, "node"), n_rows, most)
        found = _links(pairs.select("a", "b"), sets)
        if not found.isEmpty():
            labels = _relabelled(labels, found, "mixed")
        if pairs.filter("more").isEmpty():
            break
    return labels


def near_classes(
    docs: DataFrame,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    exact: bool = False,
) -> DataFrame:
    """Per document: ``class_id, class_size, kept``, where classes are joined by similarity.

    Two documents are linked if the Jaccard similarity of their five-word shingle sets
    (words as in ``textbytes.ALNUM``, A-Z lower-cased) is at least 0.8; classes are the
    connected components, named by their smallest id, and that document is kept. A
    text of one to four words is one shingle. Texts without words are similar only if
    they are equal; NULL counts as empty. A NULL id counts as the largest; of rows that
    repeat both id and text one is kept at most. ``carry`` names the input columns to
    return (all but the text if left out); those with names of results are replaced.

    A similar pair is missed only if no band holds both. ``exact`` checks all pairs that the
    sketches allow at once, not the likeliest of two components first; the result is the same.
    """
    carried = [c for c in docs.columns if c != text_col] if carry is None else carry
    texts = pack(
        docs,
        carried,
        doc=field(id_col),
        text=F.coalesce(field(text_col), F.lit("")),
        text_key=F.xxhash64(F.coalesce(field(text_col), F.lit(""))),
    )
    found = (
        T.StructType([texts.schema[REST], texts.schema["doc"]])
        .add("uid", T.LongType())
        .add("text_key", T.LongType())
        .add("node", T.BinaryType())
        .add("n", T.LongType())
        .add("bands", T.ArrayType(T.LongType()))
        .add("sketch", T.ArrayType(T.LongType()))
    )
    numbered = texts.withColumn("uid", F.monotonically_increasing_id())
    rows = stage(numbered.mapInArrow(_sign, found), "signatures")
    first = F.struct(F.col("doc").isNull().alias("missing"), F.col("doc").alias("doc"), F.col("text_key").alias("key"), "uid")
    nodes = stage(
        rows.groupBy("node").agg(
            F.any_value("n").alias("n"),
            F.any_value("bands").alias("bands"),
            F.any_value("sketch").alias("sketch"),
            F.min(first).alias("first"),
            F.any_value("text_key").alias("text_key"),
            F.count(F.lit(1)).alias("n_rows"),
        ),
        "nodes",
    )
    bands = nodes.select("node", F.explode("bands").alias("band"))
    buckets = stage(
        bands.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1"),
        "buckets",
    )
    members = stage(
        hot_join(bands, buckets.drop("n_rows"), buckets.select("band", "n_rows"), ["band"], ["node"]), "members"
    )
    slim = nodes.select("node", "n", "sketch")

    stars = members.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    centres = stage(stars.groupBy("b").agg(F.count(F.lit(1)).alias("n_rows")), "centres")
    near = hot_join(
        stars.join(slim.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("x")), "a"),
        slim.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y")),
        centres,
        ["b"],
        ["a"],
    )
    star_pairs = stage(near.filter(_may_be_similar(F.col("x"), F.col("y"))).select("a", "b"), "star-pairs")
    ends = star_pairs.select(F.col("a").alias("node")).unionByName(star_pairs.select(F.col("b").alias("node")))
    star_links = _links(star_pairs, _shingle_sets(stage(ends.distinct(), "star-ends"), texts, nodes))
    labels = stage(components(star_links), "labels")
    final = _join_mixed(members.select("band", "node"), labels, texts, nodes, exact)

    by_node = (
        nodes.select("node", "first", "n_rows")
        .join(final, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    by_node = stage(by_node, "class-nodes")
    classes = stage(
        by_node.groupBy("label").agg(
            F.min("first").alias("best"), F.sum("n_rows").alias("class_size"), F.count(F.lit(1)).alias("n_rows")
        ),
        "class-sizes",
    )
    of_node = stage(
        hot_join(
            by_node.select("node", "label", F.col("n_rows").alias("copies")),
            classes.drop("n_rows"),
            classes.select("label", "n_rows"),
            ["label"],
            ["node"],
        ),
        "node-classes",
    )
    joined = hot_join(
        rows.select(REST, "doc", "uid", "node"),
        of_node.select("node", "best", "class_size"),
        of_node.select("node", F.col("copies").alias("n_rows")),
        ["node"],
        ["uid"],
    )
    grouped = joined.select(
        REST,
        F.col("best.doc").alias("class_id"),
        "class_size",
        (F.col("uid") == F.col("best.uid")).alias("kept"),
    )
    results = {c: F.col(c) for c in ("class_id", "class_size", "kept")}
    return unpack(grouped, carried, **results)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document that is the first of its class, with all its columns.

    Of rows that repeat both id and text, the one whose row has the smallest hash stays.
    """
    key = F.xxhash64(F.coalesce(field(text_col), F.lit("")))
    named = docs.select(field(id_col).alias("gone_id"), field(text_col).alias("text"), key.alias("gone_key"))
    classes = near_classes(named, ["gone_id", "gone_key"], "gone_id", "text")
    counted = stage(
        classes.groupBy("gone_id", "gone_key").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n_rows")),
        "near-duplicates",
    )
    here = field(id_col).eqNullSafe(F.col("gone_id")) & (key == F.col("gone_key"))
    gone = counted.filter(~F.col("stays"))
    repeated = counted.filter(F.col("stays") & (F.col("n_rows") > 1))
    kept = docs.join(gone, here, "left_anti")
    if repeated.isEmpty():
        return kept
    names = [f"column_{i}" for i in range(len(docs.columns))]
    row = F.struct(*[field(c).alias(n) for c, n in zip(docs.columns, names)])
    many = kept.join(repeated, here, "left_semi")
    one = many.groupBy(field(id_col).alias("the_id"), key.alias("the_key")).agg(F.min_by(row, F.xxhash64(row)).alias("row"))
    first = one.select(*[F.col("row").getField(n).alias(c) for n, c in zip(names, docs.columns)])
    return kept.join(repeated, here, "left_anti").unionByName(first)
