"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Each task counts the pairs of its texts and deals them to shards by their hashes, as
packed arrays; a shard adds up what all tasks sent it and writes one file of sorted
pair hashes and counts. What a shard knows about single words goes on to the word
shards, which write files of sorted word hashes and their counts. Only sums over all
shards (counts of counts) come to the driver. Scoring maps the files into memory and
looks up the sorted pairs of a slice of text by binary search; it moves no text.

All tables grow with the corpus, as do their files in the shared folder; a worker
holds the pages it reads and nothing else. A pair's shard depends on both its words,
so that no frequent word fills one.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.llm import textbytes
from offermarket.llm.frames import field
from offermarket.staging import new_folder

#: Hashes of the end of a text, counted as a token, and of what stands before its first word.
END, START = np.uint64(1), np.uint64(2)
#: Tokens counted at a time, bytes of text scored at a time; bytes of training text for each pair and word shard.
COUNTED_TOKENS = 3 << 19
SLICE_BYTES = 4 << 20
PAIR_SHARD_BYTES, WORD_SHARD_BYTES = 8 << 20, 16 << 20
LEAST_SHARDS = 64
#: Shards that share the pairs of one first word.
FANS = np.uint64(8)
#: Counts of pairs from this on are kept apart.
MANY = 255
WORD_COLUMNS = ("total", "once", "twice", "often", "before")


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, the token before each, and the number per text: words ``[^\\x20\\x09-\\x0D]+`` and an end."""
    hashes, counts = textbytes.words(data, offsets, textbytes.SOLID)
    counts = counts + 1
    last = np.cumsum(counts) - 1
    token = np.full(int(counts.sum()), END)
    words = np.ones(len(token), bool)
    words[last] = False
    token[words] = hashes
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[last + 1 - counts] = START
    return token, before, counts


def pair_hash(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return textbytes.mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def pair_shard(before: np.ndarray, token: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each pair: most words have few neighbours, the pairs of a frequent one are dealt to several."""
    fan = (textbytes.mix(token + np.uint64(77)) % FANS) * np.uint64(max(1, shards // int(FANS)))
    return ((textbytes.mix(before) + fan) % np.uint64(shards)).astype(np.int64)


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, heads) if len(heads) else values[:0]


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return zlib.compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays), 1)


def _unpack(packed: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zlib.decompress(packed)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:]
    ends = 8 * (len(kinds) + 1) + np.concatenate(([0], np.cumsum(sizes)))
    return [np.frombuffer(raw[ends[i] : ends[i + 1]], kind) for i, kind in enumerate(kinds)]


def _narrow(values: np.ndarray) -> np.ndarray:
    """32-bit counts, which hold at the size of one task's slice or shard."""
    return values.astype(np.uint32)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and the ones before them, of as many texts as make up ``COUNTED_TOKENS``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for part in textbytes.slices(batches, "_text", SLICE_BYTES):
        token, before, _ = tokens(*textbytes.column_bytes(part.column("_text")))
        held.append((token, before))
        size += len(token)
        if size >= COUNTED_TOKENS:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, size = [], 0
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _count_pairs(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, before in _gathered(batches):
            hashed = pair_hash(before, token)
            order = np.argsort(hashed)
            heads = _heads(hashed[order])
            number = np.diff(np.append(heads, len(order)))
            token, before = token[order[heads]], before[order[heads]]
            shard = pair_shard(before, token, shards)
            order = np.lexsort((before, shard))
            token, before, number, shard = token[order], before[order], number[order], shard[order]
            cuts = _heads(shard)
            names, packed = [], []
            for begin, end in zip(cuts, [*cuts[1:], len(shard)]):
                # First words once each, second words by their place in a list of the distinct ones.
                firsts = _heads(before[begin:end])
                seconds, place = np.unique(token[begin:end], return_inverse=True)
                place = place.astype(np.uint16 if len(seconds) <= 1 << 16 else np.uint32)
                runs = np.diff(np.append(firsts, end - begin))
                names.append(int(shard[begin]))
                packed.append(
                    _pack(before[begin:end][firsts], _narrow(runs), seconds, place.view(np.uint8), _narrow(number[begin:end]))
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(packed, pa.binary())], names=["shard", "packed"]
            )

    return run


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write arrays of one length to a file of the shared folder; a repeated task writes the same again."""
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.array([len(arrays[0])], np.int64).tobytes())
        for array in arrays:
            out.write(array.tobytes())
    if system.get_file_info(f"{path}/{name}").type == fs.FileType.File:
        # Written before by the same task; a name only ever stands for a whole file.
        system.delete_file(part)
    else:
        system.move(part, f"{path}/{name}")


def _mapped(folder: str, name: str, kinds: tuple[type, ...]) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory; empty ones where no task had anything to write."""
    system, path = _opened(folder)
    path = f"{path}/{name}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return [np.empty(0, kind) for kind in kinds]
    if isinstance(system, fs.LocalFileSystem):
        whole = np.memmap(path, np.uint8, "r")
    else:
        # Not a folder that can be mapped: map a copy, whose name goes at once.
        with tempfile.NamedTemporaryFile(delete=False) as copy, system.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                copy.write(block)
        whole = np.memmap(copy.name, np.uint8, "r")
        os.unlink(copy.name)
    n = int(whole[:8].view(np.int64)[0])
    out, at = [], 8
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(whole[at : at + size].view(kind))
        at += size
    return out


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts > 2).sum()), int(counts.sum()), len(counts)]


_STATS = pa.schema([("kind", pa.string()), ("values", pa.list_(pa.int64()))])
_PARTS = pa.schema([("shard", pa.int64()), ("packed", pa.binary())])
STATS = -1


def _write_pairs(folder: str, word_shards: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        before, token, number = [], [], []
        for packed in table.column("packed").to_pylist():
            first, runs, seconds, place, n = _unpack(packed, np.uint64, np.uint32, np.uint64, np.uint8, np.uint32)
            place = place.view(np.uint16 if len(seconds) <= 1 << 16 else np.uint32)
            before.append(np.repeat(first, runs))
            token.append(seconds[place])
            number.append(n)
        before, token = np.concatenate(before), np.concatenate(token)
        hashed = pair_hash(before, token)
        order = np.argsort(hashed)
        heads = _heads(hashed[order])
        number = _sums(np.concatenate(number).astype(np.int64)[order], heads)
        before, token, hashed = before[order[heads]], token[order[heads]], hashed[order[heads]]
        # Nearly all counts fit a byte; those that don't are in a file of their own.
        _write(folder, f"pairs-{shard}", [hashed, np.minimum(number, MANY).astype(np.uint8)])
        often = number >= MANY
        _write(folder, f"often-{shard}", [hashed[often], number[often]])
        # What is known here of each word: as a first word its pairs by their counts, as a second its pairs.
        words, place = np.unique(np.concatenate((before, token)), return_inverse=True)
        first, second = place[: len(before)], place[len(before) :]
        size = len(words)
        columns = [
            np.bincount(first, weights=number, minlength=size),
            np.bincount(first[number == 1], minlength=size),
            np.bincount(first[number == 2], minlength=size),
            np.bincount(first[number > 2], minlength=size),
            np.bincount(second, minlength=size),
        ]
        to = (words % np.uint64(word_shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cuts = _heads(to[order])
        names, packed = [STATS], [_pack(np.array(_counts_of_counts(number), np.int64))]
        for begin, end in zip(cuts, [*cuts[1:], len(order)]):
            own = order[begin:end]
            names.append(int(to[own[0]]))
            packed.append(_pack(words[own], *[_narrow(c[own]) for c in columns]))
        return pa.table({"shard": pa.array(names, pa.int64()), "packed": pa.array(packed, pa.binary())}, schema=_PARTS)

    return run


def _write_words(folder: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        if shard == STATS:
            total = sum(_unpack(p, np.int64)[0] for p in table.column("packed").to_pylist())
            return pa.table({"kind": ["pairs"], "values": [total.tolist()]}, schema=_STATS)
        parts = [_unpack(p, np.uint64, *[np.uint32] * len(WORD_COLUMNS)) for p in table.column("packed").to_pylist()]
        words = np.concatenate([p[0] for p in parts])
        order = np.argsort(words)
        heads = _heads(words[order])
        columns = [
            _sums(np.concatenate([p[i + 1] for p in parts]).astype(np.int64)[order], heads)
            for i in range(len(WORD_COLUMNS))
        ]
        words = words[order[heads]]
        _write(folder, f"words-{shard}", [words, *columns])
        total, before = columns[0], columns[-1]
        texts = int(total[words == START].sum())
        return pa.table(
            {
                "kind": ["words", "sums"],
                "values": [_counts_of_counts(before[before > 0]), [int(total.sum()) - texts, texts]],
            },
            schema=_STATS,
        )

    return run


def discounts(stats: list[int]) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of 0, 1, 2 and more, from the counts of counts."""
    one, two, three, four = (float(x) for x in stats[:4])
    if not one:
        return np.zeros(4)
    share = one / (one + 2 * two)
    taken = [
        0.0,
        1 - 2 * share * two / one,
        2 - 3 * share * three / two if two else 1.0,
        3 - 4 * share * four / three if three else 1.0,
    ]
    # Small corpora can give values outside what a count can lose.
    return np.clip(taken, [0, 0.01, 0.01, 0.01], [0, 0.99, 1.99, 2.99])


@dataclass
class Model:
    """Where the arrays lie, and the sums over all of them."""

    folder: str
    pair_shards: int
    word_shards: int
    tokens: int  # of the training texts, ends included
    texts: int
    kinds: int  # distinct tokens
    pairs: int  # distinct pairs
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    left_over: float  # mass that the discounts of words leave to all tokens alike


class Reader:
    """Looks words and pairs up in the mapped arrays."""

    #: Files kept mapped by a task.
    OPEN = 512

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[str, list[np.ndarray]] = {}

    def arrays(self, name: str, kinds: tuple[type, ...]) -> list[np.ndarray]:
        if name not in self.files:
            if len(self.files) >= self.OPEN:
                self.files.pop(next(iter(self.files)))
            self.files[name] = _mapped(self.model.folder, name, kinds)
        return self.files[name]

    def find(self, prefix: str, shards: np.ndarray, keys: np.ndarray, kinds: tuple[type, ...]) -> list[np.ndarray]:
        """The values of each key, 0 for those not there; ``keys`` may be in any order."""
        out = [np.zeros(len(keys), np.int64) for _ in kinds[1:]]
        order = np.lexsort((keys, shards))
        cuts = _heads(shards[order])
        for begin, end in zip(cuts, [*cuts[1:], len(order)]):
            mine = order[begin:end]
            known, *values = self.arrays(f"{prefix}-{shards[mine[0]]}", kinds)
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
            hit = np.flatnonzero(known[at] == keys[mine])
            for column, value in zip(out, values):
                column[mine[hit]] = value[at[hit]]
        return out

    def words(self, words: np.ndarray) -> list[np.ndarray]:
        shards = (words % np.uint64(self.model.word_shards)).astype(np.int64)
        return self.find("words", shards, words, (np.uint64, *[np.int64] * len(WORD_COLUMNS)))

    def pairs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        shards, keys = pair_shard(before, token, self.model.pair_shards), pair_hash(before, token)
        found = self.find("pairs", shards, keys, (np.uint64, np.uint8))[0]
        many = np.flatnonzero(found == MANY)
        found[many] = self.find("often", shards[many], keys[many], (np.uint64, np.int64))[0]
        return found

    def log10(self, token: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each token after the one before it, and its count in training."""
        model = self.model
        words, place = np.unique(np.concatenate((token, before)), return_inverse=True)
        total, once, twice, often, before_it = self.words(words)
        count = np.where(words == END, model.texts, np.where(words == START, 0, total))
        taken = model.word_discounts[np.minimum(before_it, 3)]
        lower = (np.maximum(before_it - taken, 0) + model.left_over / (model.kinds + 1)) / max(model.pairs, 1)
        if not model.pairs:
            lower = np.full(len(words), 1.0)
        given = model.pair_discounts[1] * once + model.pair_discounts[2] * twice + model.pair_discounts[3] * often
        token_at, before_at = place[: len(token)], place[len(token) :]
        pair = self.pairs(before, token)
        seen = total[before_at]
        own = np.maximum(pair - model.pair_discounts[np.minimum(pair, 3)], 0)
        chance = np.where(seen > 0, (own + given[before_at] * lower[token_at]) / np.maximum(seen, 1), lower[token_at])
        return np.log10(chance), count[token_at]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the pairs of all texts and write the model's arrays to the shared folder.

    NULL and empty texts are texts of one token, their end. Repeated rows count again.
    """
    spark = docs.sparkSession
    texts = docs.select(field(text_col).alias("_text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    pair_shards = max(LEAST_SHARDS, -(-size // PAIR_SHARD_BYTES))
    word_shards = max(LEAST_SHARDS, -(-size // WORD_SHARD_BYTES))
    folder = new_folder(spark, "language-model")
    parts = texts.mapInArrow(_count_pairs(pair_shards), "shard bigint, packed binary")
    by_word = parts.groupBy("shard").applyInArrow(_write_pairs(folder, word_shards), "shard bigint, packed binary")
    # A few numbers for each word shard.
    stats = by_word.groupBy("shard").applyInArrow(_write_words(folder), "kind string, values array<bigint>")
    sums = {"pairs": np.zeros(7, np.int64), "words": np.zeros(7, np.int64), "sums": np.zeros(2, np.int64)}
    for row in stats.collect():
        sums[row.kind] += np.array(row["values"], np.int64)
    in_words, n_texts = (int(x) for x in sums["sums"])
    word_discounts = discounts(sums["words"].tolist())
    one, two, *_, more, pairs, kinds = sums["words"].tolist()
    return Model(
        folder,
        pair_shards,
        word_shards,
        in_words + n_texts,
        n_texts,
        kinds,
        pairs,
        discounts(sums["pairs"].tolist()),
        word_discounts,
        float(word_discounts[1] * one + word_discounts[2] * two + word_discounts[3] * more),
    )


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns and ``n_tokens, n_known, base_score, score, perplexity`` of each whole text.

    ``score`` is the log10 probability of all tokens, ``base_score`` that of counts plus
    one. Every text has at least its end, so NULL and empty ones have scores too. Words
    not seen in training share one place among the known ones. Carried columns with
    names of results are replaced.
    """
    results = ["n_tokens", "n_known", "base_score", "score", "perplexity"]
    carried = [c for c in carry if c.lower() not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for part in textbytes.slices(batches, "_text", SLICE_BYTES):
            token, before, counts = tokens(*textbytes.column_bytes(part.column("_text")))
            chance, count = reader.log10(token, before)
            row = np.repeat(np.arange(len(counts)), counts)
            base = np.log10(count + 1.0) - math.log10(model.tokens + model.kinds + 1)
            total = np.bincount(row, weights=chance, minlength=len(counts))
            out = [
                pa.array(counts, pa.int64()),
                pa.array(np.bincount(row[count > 0], minlength=len(counts)), pa.int64()),
                pa.array(np.bincount(row, weights=base, minlength=len(counts))),
                pa.array(total),
                pa.array(10.0 ** (-total / counts)),
            ]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + out, names=carried + results)

    texts = docs.select(*[field(c) for c in carried], field(text_col).alias("_text"))
    schema = T.StructType([texts.schema[c] for c in carried])
    for name in results:
        schema = schema.add(name, T.LongType() if name.startswith("n_") else T.DoubleType())
    return texts.mapInArrow(run, schema)


def train_and_score(docs: DataFrame, learn: Column, carry: list[str], text_col: str = "text") -> tuple[DataFrame, Model]:
    """Train on the documents where ``learn`` holds, score all."""
    model = train(docs.filter(learn), text_col)
    return score(docs, model, carry, text_col), model
