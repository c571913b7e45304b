"""Toxicity with noisy-channel deobfuscation.

Writing that hides a word (digits and signs for letters, letters spaced out, letters
repeated) is found by byte patterns. Each such span becomes a lattice of what its
characters may stand for, and a Viterbi search under a character trigram model picks
the restored text; the rest of a text stays as it is. The restored text is scored by
words and word beginnings that the labelled documents show to be toxic.

The character model is counted in Spark over all documents; its alphabet is fixed,
so it has a fixed size. Labels play no part in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offermarket.llm import textbytes
from offermarket.llm.frames import field
from offermarket.llm.labelled import with_labels
from offermarket.staging import stage

# What digits and signs stand for.
LEET = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
}
SEPARATORS = " .-_*~"
# Log probabilities of the channel: a sign for a letter, a sign as itself, a letter
# repeated, a separator put in, a separator that is one.
SIGN, KEPT, REPEATED, PUT_IN, PARTED = (math.log(p) for p in (0.3, 0.002, 0.2, 0.7, 0.02))
#: Log probability that a word of ordinary form (a doubled letter, a sign of punctuation at its end,
#: a hyphen beside a short group) hides another.
DISGUISED = math.log(0.01)
SHORTEST = 3
#: Symbols of the character model: one for all that is no letter, a-z, the small letters from
#: U+00DF to U+00FF, and one for all other letters.
SYMBOLS = 1 + 26 + 33 + 1
#: Restored spans that a task remembers before it starts afresh.
MEMORY = 1 << 17
#: Prefix lengths in bytes, besides whole words of at least the shortest.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled texts to fit on at most, about; least share and number of toxic texts with
#: a feature; least log odds of its words.
FIT_TEXTS = 50_000
LEAST_SHARE = 0.02
LEAST_TEXTS = 3
LEAST_ODDS = 2.0
#: A document is toxic from this score on.
THRESHOLD = 0.5

_SYMBOL = np.zeros(0x180, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0xDF:0x100] = np.arange(27, 60)
_SYMBOL[[0xF7]] = 0
for _code in [0xAA, 0xB5, 0xBA, *range(0x100, 0x180)]:
    _SYMBOL[_code] = SYMBOLS - 1


def symbols(text: str) -> np.ndarray:
    """Symbols of a text in lower case."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.where(codes < 0x180, _SYMBOL[np.minimum(codes, 0x17F)], SYMBOLS - 1)


def symbol(char: str) -> int:
    code = ord(char)
    return int(_SYMBOL[code]) if code < 0x180 else SYMBOLS - 1


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for part in textbytes.slices(batches, "_text"):
        # Texts are parted, so that none runs into the next.
        found = symbols("\n\n".join(["", *(t or "" for t in part.column("_text").to_pylist()), ""]))
        total += np.bincount((found[:-2] * SYMBOLS + found[1:-1]) * SYMBOLS + found[2:], minlength=len(total))
    where = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], names=["trigram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of each symbol after two others, from all documents.

    Trigram, bigram and single counts are interpolated by how many different symbols
    follow (Witten and Bell); the table has ``SYMBOLS`` cubed entries for any corpus.
    """
    counted = docs.select(field(text_col).alias("_text")).mapInArrow(_count_trigrams, "trigram bigint, n bigint")
    rows = counted.groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    three = np.zeros(SYMBOLS**3)
    three[rows.column("trigram").to_numpy()] = rows.column("n").to_numpy()
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    found = (one + 1.0) / (one.sum() + SYMBOLS)
    for counts in (two, three):
        whole = counts.sum(axis=-1, keepdims=True)
        kinds = np.maximum((counts > 0).sum(axis=-1, keepdims=True), 1)
        found = (counts + kinds * found) / (whole + kinds)
    return np.log(found)


def _decode(span: str, model: np.ndarray, kept: float, parted: float) -> tuple[float, str]:
    """Log probability and text of the best way through a span's character lattice."""
    # State: the last two symbols. Value: log probability and the last character, linked to those before it.
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for char in span.lower():
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def reach(state, value, last):
            if state not in after or value > after[state][0]:
                after[state] = (value, last)

        own = symbol(char)
        options = [(letter, SIGN) for letter in LEET.get(char, "")]
        if own or options:
            options.append((char, 0.0 if own else kept))
        for (a, b), (value, last) in best.items():
            for letter, cost in options:
                code = symbol(letter)
                reach((b, code), value + cost + model[a, b, code], (last, letter))
                if code and code == b and last is not None and last[1] == letter:
                    reach((a, b), value + cost + REPEATED, last)
            if char in SEPARATORS:
                reach((a, b), value + PUT_IN, last)
                reach((b, 0), value + parted + model[a, b, 0], (last, char))
            elif not options:
                reach((b, 0), value + model[a, b, 0], (last, char))
        best = after
    value, last = max(((value + model[a, b, 0], last) for (a, b), (value, last) in best.items()), key=lambda end: end[0])
    text = []
    while last is not None:
        last, char = last
        text.append(char)
    return value, "".join(reversed(text))


def restore(span: str, model: np.ndarray) -> str:
    """The most likely text behind a span, by Viterbi search over its character lattice."""
    return _decode(span, model, KEPT, PARTED)[1]


def restore_ordinary(span: str, model: np.ndarray) -> str:
    """As ``restore``, for a span that may well be as it was written: what is kept costs nothing, any change the odds of a disguise.

    No change leaves fewer than ``SHORTEST`` letters, which tell nothing.
    """
    lower = span.lower()
    codes = np.concatenate(([0, 0], symbols(lower), [0]))
    plain = float(model[codes[:-2], codes[1:-1], codes[2:]].sum())
    value, text = _decode(lower, model, 0.0, 0.0)
    return text if value + DISGUISED > plain and sum(map(str.isalpha, text)) >= SHORTEST else lower


_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in LEET]] = True
_PARTING = np.zeros(256, bool)
_PARTING[[ord(c) for c in SEPARATORS[1:]]] = True


def _shifted(flags: np.ndarray, by: int) -> np.ndarray:
    """``flags[i + by]``, False beyond the ends."""
    out = np.zeros(len(flags), bool)
    if abs(by) >= len(flags):
        return out
    if by >= 0:
        out[: len(flags) - by] = flags[by:]
    else:
        out[-by:] = flags[:by]
    return out


def hidden_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans that may hide a word, in order and apart from each other."""
    return marked_spans(data, offsets)[:2]


def marked_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``hidden_spans``, and which of them have an ordinary form."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    # A line end between texts keeps the end of one from being read with the start of the next.
    parted = offsets + np.arange(len(offsets))
    begin, finish, ordinary = _spans_of(np.insert(data, offsets[1:-1], 10), np.append(parted[:-1], parted[-1] - 1))
    text = np.searchsorted(parted, begin, side="right") - 1
    return begin - text, finish - text, ordinary


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are True from each start up to its end."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[ends] - total[starts]


def _spans_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of texts that each end in a line end, which belongs to them."""
    starts, lengths, counts = textbytes.spans(data, offsets, textbytes.SOLID)
    if not len(starts):
        return starts, lengths, np.zeros(0, bool)
    letter, sign = textbytes.LETTERS[data], _SIGNS[data]
    folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    same = np.zeros(len(data), bool)
    same[:-1] = folded[:-1] == folded[1:]
    plain = letter & (data < 128)
    thrice = plain & same & _shifted(same, 1)
    pair = np.zeros(len(data), bool)  # of two-byte letters
    if len(data) > 3:
        pair[:-3] = (data[:-3] >= 0xC3) & (data[:-3] < 0xE0) & (data[:-3] == data[2:-1]) & (data[1:-2] == data[3:])
    thrice |= pair & _shifted(pair, 2)
    # A sign before a letter, or signs after letters, three characters at least; those that are also
    # punctuation only with others, and one alone is ordinary.
    marked = sign & _shifted(letter, 1)
    ordinary = (plain & same) | pair
    heads, tails = _runs(sign)
    after = (heads > 0) & letter[heads - 1]
    heads, tails = heads[after], tails[after]
    hard = _sums(sign & (data != ord("!")) & (data != ord("(")), heads, tails)
    enough = (tails - heads > 1) | ((heads > 1) & letter[heads - 2])
    marked[heads[(hard > 0) & enough]] = True
    ordinary[heads[(hard == 0) & (tails - heads == 1) & enough]] = True
    # Three groups of one or two characters with separators between; beside one separator, one of up to three is ordinary.
    token, parting = letter | sign, _PARTING[data]
    lead = (data & 0xC0) != 0x80
    heads, tails = _runs(token)
    size, named = _sums(lead, heads, tails), _sums(letter, heads, tails) > 0
    joined = np.zeros(len(heads), bool)
    joined[:-1] = (heads[1:] > tails[:-1]) & (_sums(parting, tails[:-1], heads[1:]) == heads[1:] - tails[:-1])
    if len(heads) > 2:
        short, single = size <= 2, size == 1
        three = joined[:-2] & joined[1:-1] & short[:-2] & short[1:-1] & short[2:]
        letters = named[:-2].astype(np.int8) + named[1:-1] + named[2:]
        marked[heads[:-2][three & ((letters > 1) | (single[:-2] & single[1:-1] & single[2:]))]] = True
    two = joined[:-1] & named[:-1] & named[1:] & (np.minimum(size[:-1], size[1:]) <= 3)
    ordinary[heads[:-1][two]] = True
    ends = starts + lengths
    which = np.repeat(np.arange(len(starts)), lengths)
    where = np.flatnonzero(textbytes.SOLID[data])
    hits = np.zeros(len(starts), bool)
    hits[which[(thrice | marked)[where]]] = True
    # Most of its letters doubled.
    doubles = np.bincount(which, weights=(plain & same)[where], minlength=len(starts))
    hits |= (doubles > 1) & (3 * doubles >= lengths)
    named = _sums(letter, starts, ends) > 0
    maybe = np.zeros(len(starts), bool)
    maybe[which[ordinary[where]]] = True
    maybe &= named & ~hits
    hits &= named
    # Three single characters in a row, not all the same; separators may follow each or stand between two.
    first = data[starts]
    body = np.where((first >= 0xC3) & (first < 0xE0), 2, 1)
    single = token[starts] & (body <= lengths)
    single &= _sums(parting, np.minimum(starts + body, ends), ends) == lengths - body
    row = np.repeat(np.arange(len(counts)), counts)
    between = _sums(parting, starts, ends) == lengths
    between[[0, -1]] = False
    between[1:-1] &= single[:-2] & single[2:] & (row[:-2] == row[2:])
    bare = single & (lengths == body)
    member = single | between
    row = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(starts), bool)
    new[1:] = (member[1:] != member[:-1]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts))
    differs = np.concatenate(([0], np.cumsum(np.append(folded[starts[1:]] != folded[starts[:-1]], False))))
    spaced = member[heads] & (_sums(single, heads, tails) >= 3) & (differs[tails - 1] - differs[heads] > 0)
    spaced &= (_sums(bare, heads, tails) == tails - heads) | (_sums(named, heads, tails) > 0)
    heads, tails = heads[spaced], tails[spaced]
    inside = np.zeros(len(starts) + 1, np.int64)
    inside[heads] += 1
    inside[tails] -= 1
    # Several exclamation marks at the end of an ordinary form are no part of it.
    heads_of, tails_of = _runs(data == ord("!"))
    several = tails_of - heads_of > 1
    heads_of, tails_of = heads_of[several], tails_of[several]
    trimmed = ends.copy()
    place = np.searchsorted(ends, tails_of)
    last = place < len(ends)
    last[last] = ends[place[last]] == tails_of[last]
    trimmed[place[last]] = np.maximum(heads_of[last], starts[place[last]])
    ends = np.where(maybe, trimmed, ends)
    alone = np.flatnonzero((hits | maybe) & (np.cumsum(inside)[:-1] == 0))
    begin = np.concatenate((starts[alone], starts[heads]))
    finish = np.concatenate((ends[alone], ends[tails - 1]))
    order = np.argsort(begin)
    kind = np.concatenate((maybe[alone], np.zeros(len(heads), bool)))
    return begin[order], finish[order], kind[order]


class Restorer:
    """Restores the spans of whole slices of text and remembers those it has met."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[bytes, bytes] = {}

    def span(self, raw: bytes, ordinary: bool = False) -> bytes:
        found = self.known.get(raw)
        if found is None:
            text = raw.decode("utf-8", "replace")
            restored = (restore_ordinary if ordinary else restore)(text, self.model)
            found = raw if restored == text.lower() else restored.encode()
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[raw] = found
        return found

    def worth(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
        """All spans but those of ordinary form that ``restore_ordinary`` would keep, where only doubled letters count.

        What leaving out one of two equal letters gains hangs on the letters beside them alone, so the gains add up.
        """
        # Letters from U+00C0 to U+00FF, one at a time, are looked up too; at both their bytes stands their symbol.
        code = _SYMBOL[np.minimum(textbytes._FOLD[data], 127)]
        wide = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] & 0xC0) == 0x80))
        tail = data[wide + 1].astype(np.int64) + 0x40
        code[wide] = code[wide + 1] = _SYMBOL[np.where(tail < 0xDF, tail | 0x20, tail)]
        strange = data >= 128
        strange[wide] = strange[wide + 1] = False
        strange[wide[1:][np.diff(wide) == 2]] = True
        other = _SIGNS[data] | _PARTING[data] | strange
        exact = ordinary & (_sums(other, starts, ends) == 0)
        where = np.flatnonzero((data[:-1] | 32) == (data[1:] | 32))
        where = where[textbytes.LETTERS[data[where]] & (data[where] < 128)]
        span = np.searchsorted(starts, where, side="right") - 1
        inside = (span >= 0) & (where + 1 < ends[span]) & exact[span]
        where, span = where[inside], span[inside]
        before = np.where(where > starts[span], code[where - 1], 0)
        own = code[where]
        after = np.where(where + 2 < ends[span], code[np.minimum(where + 2, len(data) - 1)], 0)
        gain = REPEATED + self.model[before, own, after] - self.model[before, own, own] - self.model[own, own, after]
        gains = np.bincount(span, weights=np.maximum(gain, 0.0), minlength=len(starts))
        return ~exact | (gains + DISGUISED > -1e-6)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes and offsets of the restored texts."""
        starts, ends, ordinary = marked_spans(data, offsets)
        if not len(starts):
            return data, offsets
        worth = self.worth(data, starts, ends, ordinary)
        starts, ends, ordinary = starts[worth], ends[worth], ordinary[worth]
        whole = data.tobytes()
        pieces, at = [], 0
        grown = np.zeros(len(starts) + 1, np.int64)
        for i, (start, end, kind) in enumerate(zip(starts.tolist(), ends.tolist(), ordinary.tolist())):
            new = self.span(whole[start:end], kind)
            pieces += [whole[at:start], new]
            grown[i + 1] = grown[i] + len(new) - (end - start)
            at = end
        pieces.append(whole[at:])
        return np.frombuffer(b"".join(pieces), np.uint8), offsets + grown[np.searchsorted(starts, offsets)]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Per kind of feature (whole words, beginnings) its words and their hashes; the text of each word; words per text."""
    starts, lengths, counts = textbytes.spans(data, offsets, textbytes.LETTERS)
    hashes, _ = textbytes.words(data, offsets, textbytes.LETTERS)
    whole = np.flatnonzero(lengths >= PREFIXES[0])
    kinds = [(whole, hashes[whole])]
    for size in PREFIXES:
        longer = np.flatnonzero(lengths > size)
        kinds.append((longer, textbytes.prefix_hashes(data, starts[longer], size)))
    return kinds, np.repeat(np.arange(len(counts)), counts), counts


def _known(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are known, and their places."""
    if not len(sorted_hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    hit = np.flatnonzero(sorted_hashes[at] == hashes)
    return hit, at[hit]


@dataclass
class Lexicon:
    """Hashes of toxic words and beginnings in order, their log odds and how often clean words have them."""

    hashes: np.ndarray
    odds: np.ndarray
    clean_rate: np.ndarray
    intercept: float = 0.0
    slope: float = 1.0

    def surprise(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By how much each text has more toxic words than a clean text of its length would, as a Poisson deviance."""
        kinds, row, counts = features(data, offsets)
        best, which = np.zeros(len(row)), np.full(len(row), -1)
        # A word counts for its most telling feature only.
        for places, hashes in kinds:
            hit, at = _known(self.hashes, hashes)
            better = self.odds[at] > best[places[hit]]
            best[places[hit[better]]], which[places[hit[better]]] = self.odds[at[better]], at[better]
        toxic = np.flatnonzero(which >= 0)
        key, found = np.unique(row[toxic] * max(len(self.hashes), 1) + which[toxic], return_counts=True)
        text, feature = key // max(len(self.hashes), 1), key % max(len(self.hashes), 1)
        expected = counts[text] * self.clean_rate[feature]
        more = np.where(found > expected, found * np.log(found / expected) - found + expected, 0.0)
        return np.sqrt(np.bincount(text, weights=more, minlength=len(counts)))

    def score(self, surprise: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.intercept + self.slope * surprise)))


def _fit_texts(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """``_id, _label`` of one document for each different labelled text, about ``limit`` at most."""
    keyed = docs.select(field(id_col).alias("_doc"), F.xxhash64(field(text_col)).alias("_key"))
    known = labels.select(field(id_col).alias("_doc"), field(label).alias(label))
    texts = with_labels(keyed, known, label, "_doc").groupBy("_key", "_label").agg(F.min("_doc").alias("_id"))
    texts = stage(texts.select("_id", "_label"), "fit-texts")
    share = min(1.0, limit / max(texts.count(), 1))
    chosen = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return texts.filter(chosen)


def lexicon(
    docs: DataFrame,
    labels: DataFrame,
    model: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "toxic",
    limit: int = FIT_TEXTS,
) -> Lexicon:
    """Features that tell toxic documents, from the labelled ones that are not held out.

    Equal texts count once. At most about ``limit`` of them are used, chosen by a hash
    of the id, which bounds the list of ids that is broadcast. A feature must occur in
    a ``LEAST_SHARE`` of toxic texts, so there are at most ``1 / LEAST_SHARE`` times the
    features of a text to look at, whatever the corpus.
    """
    chosen = _fit_texts(docs, labels, label, id_col, text_col, limit)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(field(id_col).alias("_id"), field(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def count(only: np.ndarray | None):
        """Texts with each feature, its words, and in a row of its own (NULL) all words."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(shared.value)
            for part in textbytes.slices(batches, "_text"):
                kinds, row, counts = features(*restorer.texts(*textbytes.column_bytes(part.column("_text"))))
                hashes = np.concatenate([h for _, h in kinds])
                text = row[np.concatenate([places for places, _ in kinds])]
                if only is not None:
                    hit, _ = _known(only, hashes)
                    hashes, text = hashes[hit], text[hit]
                order = np.lexsort((text, hashes))
                hashes, text = hashes[order], text[order]
                value, first, n = np.unique(hashes, return_index=True, return_counts=True)
                new = np.ones(len(hashes), np.int64)
                new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                texts_with = np.add.reduceat(new, first) if len(first) else first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*value.view(np.int64).tolist(), None], pa.int64()),
                        pa.array([*texts_with.tolist(), len(counts)], pa.int64()),
                        pa.array([*n.tolist(), int(counts.sum())], pa.int64()),
                    ],
                    names=["feature", "texts", "words"],
                )

        return run

    def counted(wanted: int, only: np.ndarray | None, least: float):
        """Features of at least so many texts with a label, sorted by hash, with their words; and all words."""
        rows = (
            texts.filter(F.col("_label") == wanted)
            .select("_text")
            .mapInArrow(count(only), "feature bigint, texts bigint, words bigint")
            .groupBy("feature")
            .agg(F.sum("texts").alias("texts"), F.sum("words").alias("words"))
            .filter(F.col("feature").isNull() | (F.col("texts") >= least))
            .toArrow()
        )
        words = rows.column("words").to_numpy()
        named = rows.column("feature").is_valid().to_numpy()
        hashes = rows.column("feature").drop_null().to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        return hashes[order], words[named][order], int(words[~named].sum())

    toxic = chosen.filter("_label = 1").count()
    hashes, in_toxic, toxic_words = counted(1, None, max(LEAST_TEXTS, LEAST_SHARE * toxic))
    known, found, clean_words = counted(0, hashes, 0)
    in_clean = np.zeros(len(hashes))
    in_clean[np.searchsorted(hashes, known)] = found
    rate = (in_clean + 0.5) / (clean_words + 1)
    odds = np.log((in_toxic + 0.5) / (toxic_words + 1)) - np.log(rate)
    strong = odds >= LEAST_ODDS
    words = Lexicon(hashes[strong], odds[strong], rate[strong])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for part in textbytes.slices(batches, "_text"):
            surprise = words.surprise(*restorer.texts(*textbytes.column_bytes(part.column("_text"))))
            # Steps of a twentieth, of which there are a few hundred.
            step = np.minimum(np.round(surprise * 20), 1000).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("_label"), pa.array(step)], names=["_label", "step"])

    measured = texts.select("_text", "_label").mapInArrow(measure, "_label int, step int")
    steps = measured.groupBy("_label", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    words.intercept, words.slope = _logistic(
        np.array([r.step / 20 for r in steps]), np.array([r._label for r in steps]), np.array([r.n for r in steps])
    )
    return words


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope by damped Newton steps; without both classes, the slope is kept positive by the ridge."""
    rows = np.column_stack([np.ones(len(x)), x])
    at = np.array([-3.0, 1.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(rows @ at, -30, 30)))
        gradient = rows.T @ (n * (y - p)) - ridge * (at - np.array([-3.0, 1.0]))
        curve = (rows * (n * p * (1 - p))[:, None]).T @ rows + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        at = at + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return float(at[0]), float(at[1])


def toxicity(
    docs: DataFrame,
    model: np.ndarray,
    words: Lexicon,
    carry: list[str],
    text_col: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """The carried columns, ``score`` and, if asked for, the ``restored`` text.

    The score depends on the text alone; NULL and empty texts have no toxic word.
    Carried columns with names of results are replaced.
    """
    results = ["score"] + ["restored"] * with_text
    carried = [c for c in carry if c.lower() not in results]
    shared = docs.sparkSession.sparkContext.broadcast((model, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value
        restorer = Restorer(model)
        for part in textbytes.slices(batches, "_text"):
            data, offsets = restorer.texts(*textbytes.column_bytes(part.column("_text")))
            out = [part.column(c) for c in carried]
            out.append(pa.array(words.score(words.surprise(data, offsets)), pa.float64()))
            if with_text:
                where = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())]
                out.append(pa.StringArray.from_buffers(len(part), where[1], where[2]))
            yield pa.RecordBatch.from_arrays(out, names=carried + results)

    texts = docs.select(*[field(c) for c in carried], field(text_col).alias("_text"))
    schema = T.StructType([texts.schema[c] for c in carried]).add("score", T.DoubleType())
    if with_text:
        schema = schema.add("restored", T.StringType())
    return texts.mapInArrow(run, schema)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, carry: list[str], with_text: bool = False, **columns: str
) -> DataFrame:
    """Fit on the labelled documents that are not held out, then score all."""
    model = character_model(docs, columns.get("text_col", "text"))
    words = lexicon(docs, labels, model, **columns)
    return toxicity(docs, model, words, carry, columns.get("text_col", "text"), with_text)
