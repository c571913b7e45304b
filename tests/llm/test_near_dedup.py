import random
from collections import Counter

import numpy as np
import pytest
from awkward import TEXTS, clashing, documents
from brute import near_classes as plain
from pyspark.sql import functions as F

from offermarket.llm import near_dedup
from offermarket.llm.components import components
from offermarket.skew import hot_join


def result(docs):
    return {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}


def mutated(draw, words, share):
    return " ".join(draw.choice("xyzuvw") + str(draw.randint(0, 10**6)) if draw.random() < share else w for w in words)


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.8, 0.95])
def test_signatures_estimate_similarity(similarity):
    draw = np.random.default_rng(5)
    n = 400
    common = int(2 * n * similarity / (1 + similarity))
    sets = [draw.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2)]
    sets[1][:common] = sets[0][:common]
    rows = near_dedup.signatures(np.concatenate(sets), np.array([n, n]))
    assert abs((rows[0] == rows[1]).mean() - common / (2 * n - common)) < 0.12


def test_weighted_signatures():
    draw = np.random.default_rng(6)
    elements = draw.integers(0, 2**63, 60, dtype=np.uint64)
    one, other = draw.random(60) * 4, draw.random(60) * 4
    wanted = np.minimum(one, other).sum() / np.maximum(one, other).sum()
    got = [
        (lambda s: (s[0] == s[1]).mean())(
            near_dedup.signatures(
                np.concatenate((elements + np.uint64(k), elements + np.uint64(k))), np.array([60, 60]), np.concatenate((one, other))
            )
        )
        for k in range(8)
    ]
    assert abs(np.mean(got) - wanted) < 0.05


def test_signatures_of_empty_small_and_heavy_sets():
    rows = near_dedup.signatures(np.array([5], np.uint64), np.array([0, 1, 0]))
    assert (rows[0] == rows[2]).all() and (rows[1] < rows[0]).all()
    light = near_dedup.signatures(np.array([5], np.uint64), np.array([1]), np.array([0.01]))
    assert (light < np.uint64((1 << 64) - 1)).all()


def test_groups_of_near_copies(spark):
    draw = random.Random(7)
    texts = {}
    for group in range(12):
        base = [f"g{group}w{draw.randint(0, 500)}" for _ in range(120)]
        for _ in range(draw.choice([1, 2, 5, 40])):
            texts[len(texts)] = mutated(draw, base, draw.choice([0, 0.01, 0.02, 0.04, 0.1]))
    shared = " ".join(f"common{i}" for i in range(60))
    for i in range(60):
        texts[len(texts)] = f"{shared} " + " ".join(f"own{i}x{j}" for j in range(100))
    got = result(documents(spark, list(texts.items())))
    assert got == plain(texts)


def test_hot_copies(spark):
    texts = {i: "the same text of copies that are all alike" if i % 3 else f"another text of number {i} here" for i in range(900)}
    assert result(documents(spark, list(texts.items()))) == plain(texts)


def test_awkward_rows_and_clashes(spark):
    docs = clashing(spark, "node", "band", "class_id", "text_key", "doc", "x", "label")
    rows = near_dedup.near_classes(docs).collect()
    assert len(rows) == len(TEXTS) and {r.node for r in rows} == {"clash"}
    known = {r.doc_id: r.class_id for r in rows if r.doc_id not in (None, 12)}
    wanted = plain({d: t for d, t in TEXTS if d not in (None, 12)})
    # Documents without words: NULL, empty and blank texts; equal ones are one class.
    assert known == wanted
    assert known[3] == known[4] == 3 and known[15] == 14 and known[9] == 9
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (4, 6, 8, 15)").count() == 0
    # Of rows that repeat id and text one stays; NULL ids lose to any other.
    assert kept.filter("doc_id = 12").count() == 2
    assert sum(r.kept for r in rows if r.doc_id == 12) == 2
    assert kept.filter("doc_id is null").count() == 1
    assert near_dedup.near_classes(documents(spark, [])).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    links = spark.createDataFrame(path + star + [(7, 7), (3, 2)], "a bigint, b bigint")
    labels = {r.node: r.label for r in components(links).collect()}
    assert labels == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 400)}}
    assert components(links.limit(0)).count() == 0


def near_group(draw, size, changes=2, words=120):
    """Copies of one text with some words changed: most of them are less alike than the bound."""
    base = [f"w{i}" for i in range(words)]
    texts = {}
    for doc in range(size):
        own = list(base)
        for place in draw.sample(range(words), changes):
            own[place] = f"x{draw.randint(0, 10**9)}"
        texts[doc] = " ".join(own)
    return texts


def chain(draw, size, words=120):
    """Each text has two words of the one before changed for good, so only neighbours are alike."""
    own = [f"c{i}" for i in range(words)]
    texts = {}
    for doc in range(size):
        own[doc * 3 % words] = f"y{doc}"
        texts[doc] = " ".join(own)
    return texts


def agreeing(got, wanted):
    """Share of the pairs of one class that are in one class of the result."""
    pairs = sum(n * (n - 1) for n in Counter(wanted.values()).values())
    both = sum(n * (n - 1) for n in Counter((wanted[d], got[d]) for d in wanted).values())
    return both / pairs if pairs else 1.0


def test_group_of_unlike_near_copies_costs_in_proportion(spark, monkeypatch):
    met = []

    def counted(*args, **options):
        found = hot_join(*args, **options)
        if "centres" in found.columns:
            # Every centre that a member meets is a comparison.
            met.append(found.agg(F.sum(F.size("centres"))).first()[0])
        return found

    monkeypatch.setattr(near_dedup, "hot_join", counted)
    costs = []
    for size in (300, 1200):
        texts = near_group(random.Random(4), size)
        met.clear()
        got, wanted = result(documents(spark, list(texts.items()))), plain(texts)
        costs.append(sum(met) / max(len(met), 1) / size)
        assert agreeing(got, wanted) >= 0.99
        # Classes are never joined without a link.
        assert all(len({wanted[d] for d in got if got[d] == c}) == 1 for c in set(got.values()))
    assert max(costs) <= near_dedup.CENTRES * near_dedup.BANDS
    assert costs[1] <= 1.2 * costs[0]


def test_chain_and_exact_mode(spark):
    texts = chain(random.Random(1), 150)
    docs = documents(spark, list(texts.items()))
    assert result(docs) == plain(texts) == {d: 0 for d in texts}
    group = near_group(random.Random(9), 120)
    rows = near_dedup.near_classes(documents(spark, list(group.items())), exact=True).collect()
    assert agreeing({r.doc_id: r.class_id for r in rows}, plain(group)) == 1.0


def pairs_in_a_crowd(draw, size, pairs, words=120):
    """Copies less alike than the bound, and pairs that are alike, all in the same buckets; and the shingles each keeps."""
    base = [f"w{i}" for i in range(words)]
    places = [draw.sample(range(words), 4) for _ in range(size)]
    for _ in range(pairs):
        places += [draw.sample(range(words), 2)] * 2
    texts, kept = {}, np.ones((len(places), words - 4), int)
    for doc, changed in enumerate(places):
        own = list(base)
        for place in changed:
            own[place] = f"x{draw.randint(0, 10**9)}"
            kept[doc, max(0, place - 4) : place + 1] = 0
        texts[doc] = " ".join(own)
    return texts, kept


def test_no_pair_of_a_large_mixed_bucket_is_lost(spark, monkeypatch):
    """Buckets are cut into several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 100, raising=False)
    monkeypatch.setattr(near_dedup, "CENTRES", 1)
    texts, kept = pairs_in_a_crowd(random.Random(3), 500, 20)
    common = kept @ kept.T
    alike = np.argwhere(5 * common >= 4 * (2 * kept.shape[1] - common))
    wanted = {d: d for d in texts}
    for _ in range(8):
        for a, b in alike:
            wanted[a] = wanted[b] = min(wanted[a], wanted[b])
    assert len({wanted[d] for d in range(500, 540)}) <= 20 and len(set(wanted.values())) > 300
    assert result(documents(spark, list(texts.items()))) == wanted


def test_components_in_a_bucket_cost_few_rows(spark, monkeypatch):
    """Two large components that one bucket holds are joined by a few of their pairs."""
    seen = []
    possible = near_dedup._possible_pairs

    def counted(*args):
        pairs = possible(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dedup, "_possible_pairs", counted)
    texts = near_group(random.Random(4), 300, changes=1)
    assert result(documents(spark, list(texts.items()))) == plain(texts)
    assert all(n < 20 * len(texts) for n in seen)
