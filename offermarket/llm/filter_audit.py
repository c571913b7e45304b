"""Audit of filters that act one after another: what each removes under every order.

A filter's bit in a document's failure mask tells that the document fails it. Of the
32 subsets of five filters a document survives those without any filter it fails; the
subsets are the bits of its survival word, the bitwise AND of the truth tables of the
filters that it fails. How many documents survive each subset is the positional
popcount of the words, per part and label, taken by carry-save adders over whole
arrays. Every figure of every order follows from these counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermarket.llm.frames import field
from offermarket.skew import hot_join
from offermarket.staging import stage

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Truth table per filter: the subsets (bits of a word) that leave the filter out.
TABLES = [sum(1 << s for s in range(SUBSETS) if not s >> i & 1) for i in range(len(FILTERS))]
WHOLE = (1 << SUBSETS) - 1
# Thresholds of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Groups of part and labels a task counts before it hands them on.
HELD_GROUPS = 4096


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides."""
    words = F.array_remove(F.split(text, BLANK_RUN, -1), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text),
        "D": text.rlike(SIGNS),
    }


def survival_word(fails: list[Column]) -> Column:
    """The subsets of filters that a document survives, as the bits of a 32-bit number in a long."""
    word = F.lit(WHOLE)
    for table, failed in zip(TABLES, fails):
        word = word.bitwiseAND(F.when(failed, F.lit(table)).otherwise(F.lit(WHOLE)))
    return word


def _reduce(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One word of each group's weight, and the carries with the group of each."""
    carries, owners = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    while sizes.max(initial=0) > 1:
        triples = -(-sizes // 3)
        padded = np.zeros(int(triples.sum()) * 3, np.uint32)
        shift = 3 * (np.cumsum(triples) - triples) - (np.cumsum(sizes) - sizes)
        padded[np.repeat(shift, sizes) + np.arange(len(words))] = words
        a, b, c = padded[0::3], padded[1::3], padded[2::3]
        half = a ^ b
        carry, owner = (a & b) | (half & c), np.repeat(np.arange(len(sizes)), triples)
        carries.append(carry[carry != 0])
        owners.append(owner[carry != 0])
        words, sizes = half ^ c, triples
    return words, sizes, np.concatenate(carries), np.concatenate(owners)


def positional_popcount(words: np.ndarray, group: np.ndarray, times: np.ndarray, groups: int) -> np.ndarray:
    """Per group, how often each of the 32 bits is set in its ``uint32`` words, each counted ``times``.

    Carry-save: three words of one weight become one of that weight (their sum without
    carry) and one of twice the weight (the carry), until every group holds one word of
    each weight; only those are looked at bit by bit. A word that counts several times
    enters at the weights of the bits of that number.
    """
    counts = np.zeros((groups, SUBSETS), np.int64)
    carried, owner = np.empty(0, np.uint32), np.empty(0, np.int64)
    weight = 0
    while len(carried) or (times >> weight).any():
        enters = (times >> weight & 1).astype(bool)
        owner = np.concatenate((owner, group[enters]))
        order = np.argsort(owner, kind="stable")
        level = np.concatenate((carried, words[enters]))[order]
        one, sizes, carried, owner = _reduce(level, np.bincount(owner, minlength=groups))
        bits = (one[:, None] >> np.arange(SUBSETS, dtype=np.uint32)) & np.uint32(1)
        counts[sizes > 0] += bits.astype(np.int64) << weight
        weight += 1
    return counts


_COUNTED = "part string, good boolean, toxic boolean, subset int, n bigint"


def _rows(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    keys = list(held)
    table = np.array([held[k] for k in keys]).reshape(len(keys), SUBSETS)
    at = np.repeat(np.arange(len(keys)), SUBSETS)
    columns = [pa.array([k[i] for k in keys], kind).take(pa.array(at)) for i, kind in enumerate((pa.string(), pa.bool_(), pa.bool_()))]
    subset = pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(keys)))
    return pa.RecordBatch.from_arrays([*columns, subset, pa.array(table.ravel())], names=["part", "good", "toxic", "subset", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        coded = batch.column("part").dictionary_encode()
        part = coded.indices.to_numpy().astype(np.int64)
        good, toxic = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))
        found, group = np.unique(part * 4 + good * 2 + toxic, return_inverse=True)
        words, times = batch.column("word").to_numpy().astype(np.uint32), batch.column("n_rows").to_numpy()
        for k, counts in zip(found.tolist(), positional_popcount(words, group, times, len(found))):
            name = (coded.dictionary[k // 4].as_py(), bool(k & 2), bool(k & 1))
            held[name] = held.get(name, 0) + counts
        if len(held) > HELD_GROUPS:
            yield _rows(held)
            held = {}
    if held:
        yield _rows(held)


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    """Per labelled id, whether any of its rows calls it good, or toxic."""
    return labels.filter(field(id_col).isNotNull()).groupBy(field(id_col).alias("doc")).agg(
        F.coalesce(F.max(field("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(field("toxic") == 1), F.lit(False)).alias("toxic"),
    )


def survival_words(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """Per document: ``doc, part, good, toxic, word`` (see ``survival_word``), repeated rows once with ``n_rows``.

    Filters: A under 200 words; B under half of the words distinct; C over 3 % of the
    code points A-Z; D any of ``#$%&*|``; E the text of a smaller id again, anywhere in
    the table. A NULL text is empty, a NULL part the empty string. A NULL id is larger than
    all others; rows of equal id are not copies of each other, and an id is good (or
    toxic) if any of its labels says so. Other columns play no part.
    """
    text = F.coalesce(field(text_col), F.lit(""))
    named = docs.select(field(id_col).alias("doc"), F.coalesce(field(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = stage(
        named.select(
            "doc",
            "part",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            *[failed.alias(f"fails_{name}") for name, failed in failures(F.col("text")).items()],
        ),
        "filter-rows",
    )
    order = F.struct(F.col("doc").isNull().alias("missing"), F.col("doc").alias("doc"))
    copies = stage(
        rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first")).filter("n_rows > 1"),
        "filter-copies",
    )
    marked = hot_join(rows, copies.select("digest", "first"), copies.select("digest", "n_rows"), ["digest"], ["doc", "part"], how="left")
    smaller = F.col("first").isNotNull() & ~F.col("doc").eqNullSafe(F.col("first.doc"))
    words = marked.select("doc", "part", survival_word([*[F.col(f"fails_{c}") for c in "ABCD"], smaller]).alias("word"))
    # Repeated rows are one row with their number, so no id is hot in the join with the labels.
    grouped = words.groupBy("doc", "part", "word").agg(F.count(F.lit(1)).alias("n_rows"))
    known = {name: F.coalesce(name, F.lit(False)).alias(name) for name in ("good", "toxic")}
    return grouped.join(_labels(labels, id_col), "doc", "left").select("doc", "part", *known.values(), "word", "n_rows")


def subset_survivors(words: DataFrame) -> DataFrame:
    """Per part: ``survivors, good, toxic``, each an array by subset (bit i: filter i is applied)."""
    counted = words.select("part", "good", "toxic", "word", "n_rows").mapInArrow(_count, _COUNTED)
    summed = counted.groupBy("part", "subset").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"),
    )
    by_subset = F.array_sort(F.collect_list(F.struct("subset", "n", "n_good", "n_toxic")))
    return summed.groupBy("part").agg(by_subset.alias("s")).select(
        "part", F.col("s.n").alias("survivors"), F.col("s.n_good").alias("good"), F.col("s.n_toxic").alias("toxic")
    )


def _bits(letters: Column) -> Column:
    """The subset of the filters named."""
    return sum(F.when(F.contains(letters, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(FILTERS))


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """Per part, order of the five filters and step: what the step keeps and removes.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, removed
    before), ``unique_fails`` (failing its filter only), ``good_lost`` and ``toxic_lost``
    (removed by it and labelled so), ``shapley`` (removed by its filter, summed over all
    orders). Parts are the values in ``part_col``, 600 rows each; no document, no row.
    Awkward rows count as ``survival_words`` says.
    """
    counts = subset_survivors(survival_words(docs, labels, id_col, text_col, part_col))
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("own", _bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn(
        "before", _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))
    )

    def at(counted: str, subset: Column) -> Column:
        return F.get(F.col(counted), subset)

    def lost(counted: str) -> Column:
        return at(counted, F.col("before")) - at(counted, F.col("before") + F.col("own"))

    # A set of k filters stands before another in k! (4 - k)! of the 120 orders.
    weights = F.array(*[F.lit(math.factorial(s.bit_count()) * math.factorial(max(len(FILTERS) - 1 - s.bit_count(), 0))) for s in range(SUBSETS)])
    without = F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    shares = F.transform(without, lambda s: F.get(weights, s).cast("long") * (at("survivors", s) - at("survivors", s + F.col("own"))))
    others = F.lit(SUBSETS - 1) - F.col("own")
    return steps.select(
        "part",
        "filter_order",
        "step",
        at("survivors", F.col("before") + F.col("own")).alias("kept"),
        lost("survivors").alias("removed"),
        (at("survivors", F.lit(0)) - at("survivors", F.col("own")) - lost("survivors")).alias("redundant"),
        (at("survivors", others) - at("survivors", F.lit(SUBSETS - 1))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda total, share: total + share).alias("shapley"),
    )
