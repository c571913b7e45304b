import math

import numpy as np
import pytest
from awkward import TEXTS, clashing, documents
from brute import bigram_scores
from pyspark.sql import functions as F

from offermarket.llm import lm_scoring


def test_scores_equal_plain_counting(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    training = {d for d in texts if d % 5}
    scores, model = lm_scoring.train_and_score(docs, F.col("doc_id") % 5 != 0, carry=["doc_id"])
    wanted = bigram_scores(texts, training)
    rows = scores.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_tokens, n_known, n, base, score = wanted[r.doc_id]
        assert (r.n_tokens, r.n_known, model.tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        assert r.perplexity == pytest.approx(10 ** (-score / n_tokens))
    out = [r for r in rows if r.doc_id % 5 == 0]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_add_up(spark):
    docs = documents(spark, [(1, "a b a c"), (2, "b a b"), (3, "c c a b d"), (4, "a b a b a b")])
    model = lm_scoring.train(docs)
    words = ["a", "b", "c", "d"]
    from offermarket.llm.textbytes import SOLID, column_bytes, words as hashed
    import pyarrow as pa

    known, _ = hashed(*column_bytes(pa.array(words)), SOLID)
    token = np.concatenate((known, [lm_scoring.END], [np.uint64(987654321)]))  # the last is unknown
    for before in [*known, lm_scoring.START, np.uint64(5)]:
        chance, _ = lm_scoring.Reader(model).log10(token, np.full(len(token), before))
        assert (10.0**chance).sum() == pytest.approx(1.0)


def test_awkward_rows(spark):
    docs = clashing(spark, "n_tokens", "score", "packed", "shard")
    scores, model = lm_scoring.train_and_score(docs, F.lit(True), carry=docs.columns)
    rows = scores.collect()
    assert len(rows) == len(TEXTS) and {r.packed for r in rows} == {"clash"}
    assert all(math.isfinite(r.score) and r.score < 0 and r.n_tokens >= 1 for r in rows)
    assert model.texts == len(TEXTS)
    empty, model = lm_scoring.train_and_score(docs, F.lit(False), carry=["doc_id"])
    assert model.tokens == 0 and all(math.isfinite(r.score) for r in empty.collect())
    assert lm_scoring.score(documents(spark, []), model, ["doc_id"]).count() == 0


def test_discounts_stay_in_range():
    for stats in ([0] * 7, [5, 0, 0, 0, 0, 5, 5], [1, 9, 9, 9, 9, 9, 9], [100, 40, 20, 10, 30, 500, 170]):
        taken = lm_scoring.discounts(stats)
        assert (taken >= 0).all() and taken[1] < 1 and taken[2] < 2 and taken[3] < 3
