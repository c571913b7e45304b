"""Each stage of the pipeline against a plain version on what its predecessor kept."""

import base64

import public_tokenizers
import pytest
import tiktoken
from brute import near_classes
from test_decontaminate import plain as contaminated
from test_line_dedup import plain as own_lines

import __spark_entry__
import corpus_pipeline
from offermarket.llm import quality

NAMES = ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_bpe"]


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The documents before the first stage and after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, step in corpus_pipeline.STAGES:
        docs = out[name] = corpus_pipeline.stage(step(spark, docs, sf_dir), f"test-{name}")
    return out


def texts(df):
    return dict(df.select("doc_id", "text").collect())


def test_stages(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    for name in NAMES[:-1]:
        assert kept[name].columns == kept["documents"].columns


def test_quality_stage(spark, sf_dir, kept):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores, _ = quality.quality_scores(kept["documents"], labels)
    good = {r.doc_id for r in scores.collect() if r.score >= 0.3}
    before, after = texts(kept["documents"]), texts(kept["quality_classifier"])
    assert after == {d: before[d] for d in good}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(marked[d] for d in marked if d in good) >= 0.98 * sum(marked.values())


def test_line_stage(kept):
    rows = list(texts(kept["quality_classifier"]).items())
    assert texts(kept["line_dedup"]) == {d: t for d, t, *_ in own_lines(rows)}


def test_near_stage(kept):
    before = texts(kept["line_dedup"])
    first = {d for d, c in near_classes(before).items() if d == c}
    assert texts(kept["minhash_near_dedup"]) == {d: before[d] for d in first}


def test_benchmark_stage(spark, sf_dir, kept):
    before = texts(kept["minhash_near_dedup"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {d for d, _, hit, _ in contaminated(list(before.items()), items) if not hit}
    assert texts(kept["benchmark_decontamination"]) == {d: before[d] for d in clean}
    assert len(clean) < len(before)


def test_token_stage(kept):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    before = texts(kept["benchmark_decontamination"])
    rows = kept["byte_bpe"].collect()
    assert {r.doc_id: r.ids for r in rows} == {d: library.encode_ordinary(t) for d, t in before.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_run_and_registration(spark, sf_dir, kept):
    whole = {r.doc_id: r.ids for r in __spark_entry__.queries()["pipeline"](spark, sf_dir).collect()}
    assert whole == {r.doc_id: r.ids for r in kept["byte_bpe"].collect()}
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in __spark_entry__.queries())] == []


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, sf_dir), f"empty-{name}")
    assert docs.count() == 0
