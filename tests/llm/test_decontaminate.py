import random

import numpy as np
import pytest
from awkward import LONG, TEXTS, clashing, documents
from brute import words

from offermarket.llm import decontaminate

ITEM = "bigint, text string"


def plain(docs, items):
    """Windows of ten words, or whole shorter items, found word by word."""
    windows = []
    for i, text in items:
        w = words(text)
        k = min(10, len(w))
        windows += [("null" if i is None else str(i), tuple(w[p : p + k])) for p in range(len(w) - k + 1) if k]
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, window in windows:
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p : p + len(window)]) == window:
                    ids.add(i)
                    hit.update(range(p, p + len(window)))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


def result(docs, items, **options):
    found = decontaminate.find_matches(docs, items, **options)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_random_texts(spark, block_bytes):
    draw = random.Random(4)
    vocabulary = ["a", "b", "Ab", "é", "7"]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([0, 1, 3, 9, 10, 11, 14]))) for i in range(12)]
    docs = [(i, text(draw.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"before {t} after, {t}") for i, t in items]
    got = result(documents(spark, docs), spark.createDataFrame(items, f"item_id {ITEM}"), block_bytes=block_bytes)
    assert got == plain(docs, items)


def test_awkward_rows(spark):
    items = [(1, None), (2, ""), (3, "a"), (3, "no such word"), (None, "repeated row"), (4, LONG[:400])]
    table = spark.createDataFrame(items, f"item_id {ITEM}")
    docs = clashing(spark, "n_hit", "items", "matches", "_text_")
    assert result(docs, table) == plain(TEXTS, items)
    clean = decontaminate.decontaminate(docs, table)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not row[2] for row in plain(TEXTS, items))
    assert {r.n_hit for r in clean.collect()} == {"clash"}
    empty = table.limit(0)
    assert decontaminate.decontaminate(docs, empty).count() == docs.count()
    assert decontaminate.find_matches(documents(spark, []), table).count() == 0


def test_longest_matches_and_places(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x y w3 {' '.join(f'w{i}' for i in range(2, 16))} z"), (2, item), (3, item[:20])]
    table = spark.createDataFrame([(7, item)], f"item_id {ITEM}")
    found = {r.doc_id: r.matches for r in decontaminate.find_matches(documents(spark, docs), table).collect()}
    assert [tuple(m) for m in found[1]] == [("7", 2, 3, 14)]
    assert [tuple(m) for m in found[2]] == [("7", 0, 0, 20)]
    assert found[3] == []


def test_suffix_array_is_sorted():
    draw = np.random.default_rng(3)
    for _ in range(20):
        symbols = np.concatenate([np.append(draw.integers(5, 8, draw.integers(0, 30)), k) for k in range(5)])
        order = decontaminate.suffix_array(symbols)
        suffixes = [tuple(symbols[i:]) for i in order]
        assert suffixes == sorted(suffixes) and len(set(order.tolist())) == len(symbols)
