import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from awkward import TEXTS, clashing, documents

from offermarket.llm import lexical_search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(rows, items, top):
    """Every document against every item."""
    docs = [(d, terms(t)) for d, t in rows]
    n = sum(bool(w) for _, w in docs)
    length = sum(len(w) for _, w in docs)
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        wanted = set(terms(text))
        df = {t: sum(t in w for _, w in docs) for t in wanted}
        scored = []
        for d, w in docs:
            score = 0
            for t in wanted & set(w):
                tf = w.count(t)
                weight = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += weight * ((10**9 * tf) // (1000 * tf + 20 * (50 + 50 * len(w) * n // length)))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def result(docs, items, top=50):
    rows = lexical_search.search(docs, items, top).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_awkward_rows_and_clashes(spark):
    items = [(1, "The same LINE in two documents"), (1, "The same LINE in two documents"), (2, None), (3, ""), (4, "a one very repeated row"), (None, "end wörds 日本語"), (5, "nothing of this kind zzz")]
    docs = clashing(spark, "doc", "terms", "score", "rank", "item", "key", "item_id")
    wanted = items_of(spark, items).selectExpr("*", "'clash' as doc", "'clash' as terms", "'clash' as rank", "'clash' as score")
    assert result(docs, wanted, 3) == plain(TEXTS, items, 3)
    assert result(docs, wanted) == plain(TEXTS, items, 50)
    assert result(documents(spark, []), wanted) == []
    assert result(docs, items_of(spark, [])) == []


def some_texts(draw, n):
    """Documents of themes, copies among them, some very long."""
    themes = [[f"t{k}w{draw.randint(0, 90)}" for _ in range(120)] for k in range(12)]
    common = ["the", "of", "and", "to", "in"]
    out = {}
    for i in range(n):
        theme = draw.choice(themes)
        size = draw.choice([3, 30, 60, 1500 if i % 97 == 0 else 40])
        out[i] = " ".join(draw.choice(theme) if draw.random() < 0.5 else draw.choice(common) for _ in range(size))
        if i % 4 == 0:
            out[i] = out[0]
    items = [(k, " ".join(draw.sample(theme, 20) + common)) for k, theme in enumerate(themes)]
    return out, items


@pytest.mark.parametrize("sizes", [{}, {"CHUNK": 64, "BLOCK": 8, "LEAST": 2, "ITEMS": 5, "AHEAD": 2}])
def test_themes_ties_and_hot_copies(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical_search, name, value)
    texts, items = some_texts(random.Random(11), 700)
    docs = documents(spark, list(texts.items()))
    for top in (1, 7, 50):
        assert result(docs, items_of(spark, items), top) == plain(texts.items(), items, top)


def test_blocks_are_skipped_only_below_the_score_to_beat(monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAST", 4)
    draw = np.random.default_rng(5)
    size, n, top = 300, 600, 10
    groups = draw.integers(0, 12, n)
    groups.sort()
    dense = np.zeros((n, size), np.int64)
    for row in range(n):
        own = np.concatenate((draw.integers(0, 25, 8) + groups[row] * 25, draw.integers(0, size, 2)))
        dense[row, own] = draw.integers(1, 900_000, len(own))
    row, term = np.nonzero(dense)
    ptr = np.searchsorted(row, np.arange(n + 1))
    chunk = lexical_search.Chunk(pa.array(np.arange(n)), lexical_search.build_chunk(ptr, term, dense[row, term], size, block=16), size)
    # Every summary is the coordinatewise maximum, rounded up.
    blocks = np.split(chunk.rows, chunk.arrays["block_ptr"][1:-1])
    assert max(len(docs) for docs in blocks) <= 16 and sorted(np.concatenate(blocks)) == sorted(row)
    assert len(chunk.summary) == sum(len(docs) >= 4 for docs in blocks)
    for docs, slot, large in zip(blocks, chunk.slot, chunk.large):
        if large:
            over = chunk.summary[slot].astype(int) * lexical_search.UNIT - dense[docs].max(axis=0)
            assert (over >= 0).all() and (over < lexical_search.UNIT).all()
    weights = draw.integers(1, 9000, size)
    for group in range(12):
        wanted = np.unique(draw.integers(0, 25, 12) + group * 25)
        query = lexical_search.Query.of(wanted, weights)
        chunk.search(query, top)
        scores = dense[:, wanted] @ weights[wanted]
        best = sorted(zip(-scores, range(n)))[:top]
        got = sorted(zip((-query.scores).tolist(), query.docs.to_pylist()))
        assert got == [(int(s), d) for s, d in best if s < 0]
    assert chunk.met["skipped"] > 0 and chunk.met["scored"] < 0.5 * n * 12


def _batch_sizes(items, weights, beat, top):
    """Stands in for a search: how many rows of the index came with each batch, as scores."""

    def run(batches):
        for number, batch in enumerate(batches):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([number]), pa.array([batch.num_rows])], names=["item", "doc", "score"])

    return run


def test_large_rows_of_the_index_are_written_and_read_one_at_a_time(spark, monkeypatch):
    word = "concat('w', pmod(xxhash64(id, k), 2500))"
    docs = spark.range(8 * lexical_search.CHUNK).selectExpr("id as doc", f"array_join(transform(sequence(1, 150), k -> {word}), ' ') as text")
    hashes, _ = lexical_search.textbytes.words(*lexical_search.textbytes.column_bytes(pa.array([" ".join(f"w{k}" for k in range(2500))])))
    vocabulary = np.unique(hashes)
    vectors = docs.mapInArrow(lexical_search._vectors(vocabulary), "doc bigint, n bigint, terms array<int>, counts array<bigint>")
    index = lexical_search.build_index(vectors, vocabulary, lexical_search.Statistics(docs.count(), 1, np.full(2500, 1000)))
    large = index.filter("octet_length(summary) > 4 * 1024 * 1024").count()
    assert large >= 4
    files = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in index.inputFiles()]
    assert sum(m.num_row_groups for m in files) >= large
    monkeypatch.setattr(lexical_search, "_search", _batch_sizes)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    seen = lexical_search.search_items(index, [np.arange(5)], np.full(2500, 1000), 1000)
    assert seen.agg({"score": "sum"}).first()[0] == index.count()
    assert seen.count() >= large
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_long_documents_make_chunks_of_fewer(monkeypatch):
    monkeypatch.setattr(lexical_search, "VALUES", 100, raising=False)
    monkeypatch.setattr(lexical_search, "CHUNK", 20)
    sizes = [30, 30, 30, 30, 150, 1, 99, 1] + [2] * 45 + [100, 100, 3]
    terms = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), terms, terms], names=["doc", "terms", "values"])
    for step in (1, 7, len(sizes)):
        index = list(lexical_search._chunks(200)(iter([rows.slice(k, step) for k in range(0, len(sizes), step)])))
        docs = [row.column("docs")[0].as_py() for row in index]
        assert [len(d) for d in docs] == [3, 1, 1, 2, 20, 20, 6, 1, 1, 1]
        assert sum(docs, []) == list(range(len(sizes)))
        assert [len(row.column("value")[0].as_py()) // 4 for row in index] == [sum(sizes[d] for d in some) for some in docs]


def test_summaries_of_a_chunk_are_bounded_and_the_search_stays_exact(monkeypatch):
    size, n, top = 50, 40, 5
    monkeypatch.setattr(lexical_search, "CELLS", size * 32)
    draw = np.random.default_rng(3)
    dense = draw.integers(1, 900_000, (n, size)) * (np.arange(n)[:, None] < 32 + np.arange(size) % 9)
    row, term = np.nonzero(dense)
    ptr = np.searchsorted(row, np.arange(n + 1))
    chunk = lexical_search.Chunk(pa.array(np.arange(n)), lexical_search.build_chunk(ptr, term, dense[row, term], size), size)
    assert len(chunk.summary) == 32 == chunk.large.sum()
    lengths = np.diff(chunk.arrays["block_ptr"])
    assert lengths[chunk.large].min() >= lengths[~chunk.large].max()
    weights = draw.integers(1, 9000, size)
    for wanted in ([0, 8, 17], list(range(size)), [9], [7, 44]):
        query = lexical_search.Query.of(np.array(wanted), weights)
        chunk.search(query, top)
        scores = dense[:, wanted] @ weights[wanted]
        assert sorted(zip(-query.scores, query.docs.to_pylist())) == [(s, d) for s, d in sorted(zip(-scores, range(n)))[:top] if s < 0]


def test_keys_of_long_documents_take_bounded_memory(monkeypatch):
    size, n = 4000, 300
    draw = np.random.default_rng(2)
    held = [np.sort(draw.permutation(size)[: 1 if k % 50 == 0 else size - k]) for k in range(n)]
    offsets = pa.array(np.append(0, np.cumsum([len(x) for x in held])), pa.int32())
    terms = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held), pa.int32()))
    counts = pa.ListArray.from_arrays(offsets, pa.array(draw.integers(1, 40, int(offsets[-1].as_py()))))
    ids = pa.array(np.arange(n))
    batch = pa.RecordBatch.from_arrays([ids, pa.array(draw.integers(5000, 90_000, n)), terms, counts, ids], names=["doc", "n", "terms", "counts", "salt"])
    known = lexical_search.Statistics(n, 10_000_000, draw.integers(1, 9000, size))
    vocabulary = draw.integers(0, 1 << 63, size).astype(np.uint64)

    def keyed():
        return list(lexical_search._keyed(vocabulary, known)(iter([batch])))[0]

    tracemalloc.start()
    first = keyed()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20
    for pieces in (1, 1 << 30):
        monkeypatch.setattr(lexical_search, "KEYED", pieces, raising=False)
        assert keyed().equals(first)
