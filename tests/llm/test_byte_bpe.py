import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from awkward import TEXTS, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from offermarket.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})


def same(ranks, library, texts):
    ids, ends = byte_bpe.Encoder(ranks).encode(texts)
    for i, text in enumerate(texts):
        own = ids[ends[i] : ends[i + 1]]
        assert own.tolist() == library.encode_ordinary(text)
        assert bytes(byte_bpe.decode_ids(ranks, own.astype(np.int64))) == text.encode()


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"])))
def test_any_text(ranks, library, text):
    same(ranks, library, [text])


def test_awkward_texts(ranks, library):
    draw = random.Random(2)
    letters = "abc deé ñ\n\t 12３½Ⅷ'srelv.,!—  \x0b\x1c\x85日本한👍́‍"
    texts = ["", "a" * 3000, "ab" * 300 + " x", " " * 500 + "a", "日本語" * 200, "'s't'RE 'll d'd", "\n\n \t x  "]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(0, 300))) for _ in range(300)]
    same(ranks, library, texts)


def test_memory_starts_afresh(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", 3)
    encoder = byte_bpe.Encoder(ranks)
    for text in ("one two three four", "four five six", "one two"):
        ids, _ = encoder.encode([text])
        assert ids.tolist() == library.encode_ordinary(text)


def test_frames(spark, ranks, library):
    docs = clashing(spark, "ids", "_ids", "decoded")
    done = byte_bpe.decode(byte_bpe.encode(docs, ranks), ranks)
    assert done.columns == docs.columns
    rows = [(r.doc_id, r.ids, bytes(r.decoded)) for r in done.collect()]
    wanted = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in TEXTS]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
    assert byte_bpe.encode(documents(spark, []), ranks).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(none, ranks).collect()] == [b"", b""]
