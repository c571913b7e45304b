import re
from itertools import permutations

import numpy as np
from awkward import TEXTS, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from offermarket.llm import filter_audit

LABELS = "doc_id bigint, quality int, toxic int"


def plain(rows, labels):
    """Every order walked through, document by document."""
    fails = []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(
            (text == (t or "")) and d is not None and (doc is None or d < doc) for d, t, _ in rows
        )
        failing = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": smaller,
        }
        good = any(d == doc and q == 1 for d, q, _ in labels if d is not None)
        toxic = any(d == doc and t == 1 for d, _, t in labels if d is not None)
        fails.append((part or "", {f for f, yes in failing.items() if yes}, good, toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(name in f[1] for f in mine) - len(gone),
                    sum(f[1] == {name} for f in mine),
                    sum(f[2] for f in gone),
                    sum(f[3] for f in gone),
                ]
    shapley = {}
    for (part, order, step), row in out.items():
        key = part, order[step - 1]
        shapley[key] = shapley.get(key, 0) + row[1]
    return {k: tuple(row) + (shapley[k[0], k[1][k[2] - 1]],) for k, row in out.items()}


def result(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def triples(rows):
    return [(d, t, None if d == 7 else "en") for d, t in rows]


def test_awkward_rows_and_clashes(spark):
    given_labels = [(1, 1, 0), (1, 0, 0), (5, 1, 1), (12, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1)]
    labels = spark.createDataFrame(given_labels, LABELS)
    docs = clashing(spark, "part", "word", "doc", "digest", "good", "fails_A", "n_rows")
    assert result(docs, labels) == plain(triples(TEXTS), given_labels)
    assert result(documents(spark, []), labels) == {}


def test_every_combination_and_a_hot_text(spark):
    long = " ".join(f"w{i}" for i in range(220))
    parts = [long, "a b c", "x " * 300, "ABC DEF " + long, long + " $", "x X# " * 150, "X " * 9 + "% y", long + " END" * 40]
    rows = [(i, parts[i % len(parts)] if i % 3 else "the hot one", ["en", "de", None, ""][i % 4]) for i in range(600)]
    rows += [(4, "the same id twice", "en"), (4, "the same id twice", "en"), (None, "the hot one", "fr")]
    given_labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 600, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert result(docs, spark.createDataFrame(given_labels, LABELS)) == plain(rows, given_labels)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 4), st.integers(0, 40)), max_size=200))
def test_positional_popcount(items):
    words, group, times = (np.array([x[i] for x in items], kind) for i, kind in enumerate((np.uint32, np.int64, np.int64)))
    counts = filter_audit.positional_popcount(words, group, times, 5)
    for g in range(5):
        for bit in range(32):
            assert counts[g, bit] == sum(t for w, k, t in items if k == g and w >> bit & 1)
