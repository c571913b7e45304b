import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from awkward import TEXTS, clashing, documents

from offermarket.llm import quality, textbytes, toxicity
from offermarket.llm.queries import QUERIES


def rates(spark, sf_dir, name, label):
    rows = QUERIES[name](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    joined = rows.join(labels, "doc_id").collect()
    out = [r for r in joined if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in joined)
    assert all(0 <= r.score <= 1 for r in joined)
    return sum(r.predicted == r[label] for r in out) / len(out), out


@pytest.mark.parametrize("name, label", [("op5_quality_classifier", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    accuracy, rows = rates(spark, "/root/testdata/sf0.1", name, label)
    assert len(rows) > 500 and accuracy > 0.98
    one, other = ([r.score for r in rows if r[label] == k] for k in (1, 0))
    assert np.mean([a > b for a in one for b in other]) > 0.93


def test_statistics_by_hand():
    texts = ["", "One two two.\nOne two two.", "x" * 10_000, "###", "é ß", "A\n\nB"]
    table = quality.statistics(*textbytes.column_bytes(pa.array(texts)))
    assert table.shape == (6, len(quality.STATISTICS)) and np.isfinite(table).all()
    names = dict(zip(quality.STATISTICS, table[1]))
    assert names["log_words"] == pytest.approx(np.log1p(6))
    assert names["title_share"] == pytest.approx(np.log(2.5 / 4.5))
    assert names["repeat_next_share"] == pytest.approx(np.log(0.5 / 5.5))  # "two" and "two." differ
    assert names["distinct_lines"] == pytest.approx(np.log(1.5 / 1.5))
    # A text's statistics don't depend on its neighbours.
    for i, text in enumerate(texts):
        assert quality.statistics(*textbytes.column_bytes(pa.array([text])))[0] == pytest.approx(table[i])


def test_discriminant_equals_gaussians():
    draw = np.random.default_rng(2)
    size = len(quality.STATISTICS)
    rows = {k: draw.normal(k, 1 + k, (500, size)) for k in (0, 1)}
    model = quality.discriminant({k: (500.0, r.sum(0), r.T @ r) for k, r in rows.items()}, shrinkage=0.0)
    x = draw.normal(0, 1, (5, size))
    z = (x - model.centre) / model.scale
    for k, r in rows.items():
        own = (r - model.centre) / model.scale
        cov, mean = np.cov(own.T, bias=True), own.mean(0)
        away = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)
        wanted = -0.5 * (away + np.linalg.slogdet(cov)[1]) + np.log(501 / 1002)
        assert model.log_density(x, k) == pytest.approx(wanted)


def test_quality_on_awkward_rows(spark):
    docs = clashing(spark, "_statistics", "score", "_label")
    labels = spark.createDataFrame(
        [(1, 1, 0), (2, 0, 0), (2, 0, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (13, 0, 0), (13, 1, 0), (99, 1, 1)],
        "doc_id bigint, quality int, toxic int",
    )
    scores, _ = quality.quality_scores(docs, labels)
    assert scores.count() == len(TEXTS) and scores.filter("score is null or isnan(score)").count() == 0
    kept = quality.keep_good(docs, labels, least=0.0)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)
    assert quality.keep_good(docs, labels, least=1.1).count() == 0
    none, _ = quality.quality_scores(docs, labels.limit(0))
    assert none.count() == len(TEXTS)
    assert quality.quality_scores(documents(spark, []), labels)[0].count() == 0


def test_toxicity_on_awkward_rows(spark):
    docs = clashing(spark, "_text_", "score", "_label", "restored")
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1), (6, None), (None, 1), (13, 0)], "doc_id bigint, toxic int")
    rows = toxicity.toxicity_scores(docs, labels, carry=docs.columns, with_text=True).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows) and {r._text_ for r in rows} == {"clash"}
    assert toxicity.toxicity_scores(docs, labels.limit(0), carry=["doc_id"]).count() == len(TEXTS)
    assert toxicity.toxicity_scores(documents(spark, []), labels, carry=["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_character_model_adds_up(model):
    assert model.shape == (toxicity.SYMBOLS,) * 3
    assert np.exp(model).sum(axis=2) == pytest.approx(np.ones((toxicity.SYMBOLS, toxicity.SYMBOLS)))


def test_restores_hidden_words(model):
    hidden = {
        "1d10t": "idiot", "l0ser": "loser", "L.O.S.E.R": "loser", "i d i o t": "idiot", "stuuupid": "stupid",
        "ssstttuuupppiiiddd": "stupid", "p@thet1c": "pathetic", "$cum": "scum", "m0r0n!": "moron!", "cl0wn": "clown",
        "d1sgu5ting": "disgusting", "tr@sh": "trash", "iiddiioott": "idiot", "m-o-r-o-n": "moron",
    }
    found = {}
    for text in hidden:
        data, offsets = textbytes.column_bytes(pa.array([f"of {text} and"]))
        found[text] = bytes(toxicity.Restorer(model).texts(data, offsets)[0]).decode()[3:-4]
    assert found == hidden


def test_restores_light_and_parted_disguises(model):
    hidden = {
        "idi07": "idiot", "idi07,": "idiot,", "id10+": "idiot", "idio+": "idiot", "mora$$": "moras", "scuum": "scum",
        "stuupiid": "stupid", "cloown": "clown", "looser!": "loser!", "scuum!!": "scum!!", "st.up.id": "stupid", "stu.pid": "stupid",
        "i--d--i--o--t": "idiot", "i. d. i. o. t": "idiot", "i - d - i - o - t": "idiot",
    }
    ordinary = ["all", "orre", "attion", "hello!", "well-known", "up-to-date", "state-of-the-art", "1. 2. 3.", "a - b"]
    texts = [f"of {text} and" for text in [*hidden, *ordinary]]
    data, offsets = textbytes.column_bytes(pa.array(texts))
    after, ends = toxicity.Restorer(model).texts(data, offsets)
    found = [bytes(after[a:b]).decode()[3:-4] for a, b in zip(ends, ends[1:])]
    assert dict(zip([*hidden, *ordinary], found)) == {**hidden, **dict(zip(ordinary, ordinary))}


def test_long_spans_are_restored_whole(model):
    restorer = toxicity.Restorer(model)
    assert restorer.span(b"lo" + 70 * b"o" + b"ser") == b"loser"
    assert restorer.span(b"l" + 100_000 * b"o" + b"ser") == b"loser"


def test_plain_texts_stay_as_they_are(model):
    texts = ["", "The plain text of it, with all words.", "ünïcödé Wörds", "see you at 10", "A B", "it is a b"]
    data, offsets = textbytes.column_bytes(pa.array(texts))
    after, ends = toxicity.Restorer(model).texts(data, offsets)
    assert bytes(after) == "".join(texts).encode() and ends.tolist() == offsets.tolist()


def test_hidden_toxic_words_raise_the_score(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.character_model(docs)
    words = toxicity.lexicon(docs, labels, model)
    clean = docs.join(labels.filter("toxic = 0 and quality = 1"), "doc_id").filter("length(text) between 300 and 900")
    draw = random.Random(3)
    hide = ["1d10t", "i d i o t", "l0ser", "stuuupid", "m0r0n", "tr@sh", "cl0wn", "$cum", "p@thet1c"]
    planted = []
    for r in clean.orderBy("doc_id").limit(60).collect():
        own = r.text.split(" ")
        for word in draw.sample(hide, 4):
            own.insert(draw.randint(0, len(own)), word)
        planted.append((r.doc_id, " ".join(own)))
        planted.append((-1 - r.doc_id, r.text))
    frame = spark.createDataFrame(planted, "doc_id bigint, text string")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(frame, model, words, ["doc_id"]).collect()}
    caught = [scores[d] >= toxicity.THRESHOLD for d, _ in planted if d >= 0]
    wrong = [scores[d] >= toxicity.THRESHOLD for d, _ in planted if d < 0]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.05


def test_signs_at_word_ends_and_single_letters():
    texts = ["clas5 of it", "id10+ x", "a a a a a a", "x b c", "hello!!", "end$", "OF!! THE!!", "1.2.3.4", "a.b.c.d"]
    data, offsets = textbytes.column_bytes(pa.array(texts))
    starts, ends = toxicity.hidden_spans(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert "x b c" in found and "a.b.c.d" in found
    assert not {"a a a a a a", "hello!!", "OF!!", "1.2.3.4"} & set(found)
