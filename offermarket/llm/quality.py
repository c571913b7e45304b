"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a row of transformed statistics, worked out over whole byte arrays.
Sums and products of the labelled rows are added up in Spark, so fitting sees all of
them and the driver only gets one small matrix per class. Class covariances are
shrunk towards their pooled diagonal; the score compares Gaussian log densities,
whose Mahalanobis distances use the Cholesky factors kept with the model.
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
from offermarket.llm.labelled import with_labels
from offermarket.staging import stage

#: Statistics in the order of the feature columns.
STATISTICS = (
    "log_words",
    "mean_word_bytes",
    "spread_word_bytes",
    "upper_share",
    "title_share",
    "digit_share",
    "symbol_share",
    "end_mark_share",
    "odd_mark_share",
    "distinct_words",
    "top_word_share",
    "distinct_pairs",
    "repeat_next_share",
    "lines_per_word",
    "distinct_lines",
    "byte_entropy",
    "marked_words",
)
#: Weight of the pooled diagonal in each class covariance, and the least variance of a statistic.
SHRINKAGE = 0.3
LEAST_VARIANCE = 1e-4
#: Documents below this score are rejected.
LEAST_SCORE = 0.3

_KIND = np.zeros((256, 6), np.int64)  # upper, digit, symbol, end mark, odd mark, line end
_KIND[65:91, 0] = 1
_KIND[48:58, 1] = 1
for _code in range(33, 127):
    _KIND[_code, 2] = not chr(_code).isalnum()
    _KIND[_code, 3] = chr(_code) in ".,;:?'\"-()"
    _KIND[_code, 4] = _KIND[_code, 2] and not _KIND[_code, 3]
_KIND[10, 5] = 1


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the offsets."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, and the occurrences of its most frequent one."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(value)))
    top = np.zeros(rows, np.int64)
    np.maximum.at(top, row[heads], runs)
    return np.bincount(row[heads], minlength=rows), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` per text. Shares are those of a text with a little of everything added."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kinds = [_per_row(_KIND[:, k][data], offsets) for k in range(_KIND.shape[1])]
    upper, digit, symbol, ends, odd, breaks = kinds
    letters = _per_row((textbytes.ALNUM[data] & (_KIND[:, 1][data] == 0)).astype(np.int64), offsets)
    hashes, words = textbytes.words(data, offsets, textbytes.SOLID)
    _, lengths, _ = textbytes.spans(data, offsets, textbytes.SOLID)
    row = np.repeat(np.arange(rows), words)
    where = np.concatenate(([0], np.cumsum(words)))
    mean = _per_row(lengths, where) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(_per_row(lengths**2, where) / np.maximum(words, 1) - mean**2, 0))
    distinct, top = _distinct(row, hashes, rows)
    same_row = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pairs = textbytes.mix(hashes[:-1] * np.uint64(31) + hashes[1:])[same_row] if len(row) else hashes
    pair_row = row[1:][same_row] if len(row) else row
    distinct_pairs, _ = _distinct(pair_row, pairs, rows)
    again = np.bincount(pair_row[(hashes[1:] == hashes[:-1])[same_row]], minlength=rows) if len(row) else np.zeros(rows)
    solid = textbytes.SOLID[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][size > 0]
    begins[firsts] = solid[firsts]
    title = _per_row((begins & (_KIND[:, 0][data] == 1)).astype(np.int64), offsets)
    last = np.append(solid[:-1] & ~solid[1:], solid[-1:])
    finals = offsets[1:][size > 0] - 1
    last[finals] = solid[finals]
    marked = _per_row((last & (_KIND[:, 4][data] == 1)).astype(np.int64), offsets)
    # Lines are the words of another alphabet: everything but the line end.
    line_hash, lines = textbytes.words(data, offsets, textbytes.LINE)
    distinct_lines, _ = _distinct(np.repeat(np.arange(rows), lines), line_hash, rows)
    text_row = np.repeat(np.arange(rows), np.diff(offsets))
    counts = np.bincount(text_row * 256 + data, minlength=rows * 256).reshape(rows, 256)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -np.where(share > 0, share * np.log2(np.where(share > 0, share, 1)), 0).sum(axis=1)

    def logit(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log((part + 0.5) / (whole - part + 0.5))

    root = np.sqrt(np.maximum(words, 1))
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            logit(upper, letters),
            logit(title, words),
            logit(digit, size),
            logit(symbol, size),
            logit(ends, size),
            logit(odd, size),
            np.log((distinct + 1) / root),
            logit(top, words),
            logit(distinct_pairs, np.maximum(words - 1, 0)),
            logit(again, np.maximum(words - 1, 0)),
            np.log((breaks + 1) / (words + 1)),
            logit(distinct_lines, lines),
            entropy,
            logit(marked, words),
        ]
    )


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textbytes.slices(batches, "_text"):
        table = statistics(*textbytes.column_bytes(part.column("_text")))
        offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))
        names = [c for c in part.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [lists], names=names + ["_statistics"])


def described(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns and ``_statistics`` of each whole text; NULL counts as empty."""
    texts = docs.select(*[field(c) for c in carry], field(text_col).alias("_text"))
    schema = T.StructType([texts.schema[c] for c in carry]).add("_statistics", T.ArrayType(T.DoubleType()))
    return texts.mapInArrow(_describe, schema)


@dataclass
class Discriminant:
    """Fitted model: per class mean, Cholesky factor of the covariance and log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    priors: list[float]

    def log_density(self, table: np.ndarray, label: int) -> np.ndarray:
        factor = self.factors[label]
        away = np.linalg.solve(factor, ((table - self.centre) / self.scale - self.means[label]).T)
        return self.priors[label] - 0.5 * (away**2).sum(axis=0) - np.log(np.diag(factor)).sum()

    def score(self, table: np.ndarray) -> np.ndarray:
        """Probability of label 1, kept off 0 and 1 so that order among sure cases stays."""
        margin = self.log_density(table, 1) - self.log_density(table, 0)
        # Densities in many dimensions are too sure of themselves; the root keeps sign and order.
        calm = np.sign(margin) * np.sqrt(np.abs(margin))
        return 1.0 / (1.0 + np.exp(-calm))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit from ``label -> (rows, sum of statistics, sum of their outer products)``."""
    size = len(STATISTICS)
    n = sum(s[0] for s in sums.values())
    centre = sum((s[1] for s in sums.values()), np.zeros(size)) / max(n, 1)
    second = sum((s[2] for s in sums.values()), np.zeros((size, size))) / max(n, 1) - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(second), LEAST_VARIANCE))
    means, covariances, weights = [], [], []
    for label in (0, 1):
        rows, total, product = sums.get(label, (0.0, np.zeros(size), np.zeros((size, size))))
        mean = total / rows if rows else centre
        cov = product / rows - np.outer(mean, mean) if rows else np.diag(scale**2)
        means.append((mean - centre) / scale)
        covariances.append(cov / np.outer(scale, scale))
        weights.append(rows)
    pooled = sum(w * c for w, c in zip(weights, covariances)) / n if n else np.eye(size)
    pooled = np.diag(np.maximum(np.diag(pooled), LEAST_VARIANCE))
    factors = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * pooled) for c in covariances]
    priors = [float(np.log((w + 1) / (n + 2))) for w in weights]
    return Discriminant(centre, scale, means, factors, priors)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label, the rows, sums and outer products of all statistics in this task."""
    size = len(STATISTICS)
    found = {}
    for batch in batches:
        table = batch.column("_statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        labels = batch.column("_label").to_numpy(zero_copy_only=False)
        for label in np.unique(labels):
            part = table[labels == label]
            moments = np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).ravel()))
            found[int(label)] = found.get(int(label), 0) + moments
    for label, moments in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([label], pa.int32()), pa.array([moments.tolist()], pa.list_(pa.float64()))],
            names=["_label", "moments"],
        )


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on all rows of ``_label, _statistics``. Without rows of a label, it gets the overall mean and spread."""
    size = len(STATISTICS)
    parts = labelled.select("_label", "_statistics").mapInArrow(_add_up, "_label int, moments array<double>")
    rows = (
        parts.select("_label", F.posexplode("moments").alias("place", "value"))
        .groupBy("_label", "place")
        .agg(F.sum("value").alias("value"))
        .collect()  # two labels by the number of moments
    )
    sums = {}
    for label in {row._label for row in rows}:
        moments = np.zeros(1 + size + size * size)
        for row in rows:
            if row._label == label:
                moments[row.place] = row.value
        sums[label] = (moments[0], moments[1 : 1 + size], moments[1 + size :].reshape(size, size))
    return discriminant(sums, shrinkage)


def score(rows: DataFrame, model: Discriminant, carry: list[str]) -> DataFrame:
    """The carried columns and ``score``, the probability of label 1, of rows with ``_statistics``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.column("_statistics").flatten().to_numpy(zero_copy_only=False)
            scores = model.score(table.reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(scores, pa.float64())], names=[*carry, "_score"]
            )

    some = rows.select(*[field(c) for c in carry], "_statistics")
    schema = T.StructType([some.schema[c] for c in carry]).add("_score", T.DoubleType())
    scored = some.mapInArrow(run, schema)
    kept = [field(c) for c in carry if c.lower() != "score"]
    return scored.select(*kept, F.col("_score").alias("score"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality"
) -> tuple[DataFrame, Discriminant]:
    """``id, score`` of every document, and the model, fitted on the labelled rows not held out.

    The score depends on the text alone. NULL and empty texts are scored as texts
    without words; repeated rows are scored each; without any labels all scores are equal.
    """
    rows = stage(described(docs, [id_col], text_col), "statistics")
    model = fit(with_labels(rows, labels, label, id_col))
    return score(rows, model, [id_col]), model


def keep_good(
    docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""
    rows = stage(described(docs, [id_col], text_col), "statistics")
    model = fit(with_labels(rows, labels, "quality", id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textbytes.slices(textbytes.beside(batches, REST, text_col, "_text"), "_text"):
            scores = model.score(statistics(*textbytes.column_bytes(part.column("_text"))))
            yield part.filter(pa.array(scores >= least)).select([REST])

    packed = pack(docs)
    good = packed.mapInArrow(run, T.StructType([packed.schema[REST]]))
    return good.select(*[F.col(REST).getField(c).alias(c) for c in docs.columns])
