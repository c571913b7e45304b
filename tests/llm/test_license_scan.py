import random
import re

from awkward import TEXTS, clashing, documents

from offermarket.llm import license_scan

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_words(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.split(GAP, text or "") if w]


def plain(text, templates=license_scan.TEMPLATES, share=0.9):
    """Every block against every template, by whole sets."""
    w = plain_words(text)
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    step = max(len(plain_words(t)) for _, t in templates)
    met = set()
    for start in range(0, max(1, len(w) - step), step):
        held = set(w[start : start + 2 * step])
        for number, (label, template) in enumerate(templates):
            tokens = set(plain_words(template))
            if len(held & tokens) >= share * len(tokens) - 1e-9:
                met.add((start, number, label, len(held & tokens) / len(tokens)))
    score = 1.0 if places else max((m[3] for m in met), default=0.0)
    return (
        len(w),
        len(places),
        min(places, default=None),
        max(places, default=None),
        sorted(base),
        sorted(base | {m[2] for m in met}),
        score,
        sorted(met),
    )


def result(docs, **options):
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    rows = license_scan.scan(docs, **options).collect()
    return [(r.doc_id, tuple([tuple(m) for m in r[n]] if n == "matches" else r[n] for n in names)) for r in rows]


def test_awkward_rows_and_clashes(spark):
    docs = clashing(spark, "words", "starts", "labels", "id", "block", "matches", "text_key", "token")
    got = result(docs)
    assert sorted(got, key=repr) == sorted(((d, plain(t)) for d, t in TEXTS), key=repr)
    assert license_scan.scan(documents(spark, [])).count() == 0
    kept = license_scan.scan(docs)
    assert "text" not in kept.columns and {r.words for r in kept.collect()} == {"clash"}


def test_templates_anywhere_wrapped_cut_short_and_beside_others(spark):
    draw = random.Random(3)
    filler = ["the", "of", "license", "under", "software", "version", "this", "is", "a", "work"] + [f"w{i}" for i in range(40)]
    texts = {}
    for i in range(240):
        words = [draw.choice(filler) for _ in range(draw.choice([0, 5, 40, 200, 900]))]
        for _ in range(draw.choice([0, 1, 2])):
            label, template = draw.choice(license_scan.TEMPLATES)
            own = re.split(r"\s+", template)
            for _ in range(draw.choice([0, 0, 1, 3])):
                own.pop(draw.randrange(len(own)))
            at = draw.randrange(len(words) + 1)
            words[at:at] = own
        if draw.random() < 0.2:
            words.insert(0, draw.choice(["CC BY", "General  Public\nLicense", "All rights-reserved", "cc-by cc by"]))
        texts[i] = draw.choice([" ", "\n", ", "]).join(words)
    got = dict(result(documents(spark, list(texts.items()))))
    wanted = {i: plain(t) for i, t in texts.items()}
    assert got == wanted
    assert sum(bool(w[7]) for w in wanted.values()) > 60


def test_other_templates_and_none(spark):
    texts = {i: f"alpha beta gamma delta {'epsilon' if i % 2 else 'zeta'} {i}" for i in range(40)}
    own = [("x", "alpha beta gamma delta epsilon"), ("y", "zeta"), ("none", " ... ")]
    docs = documents(spark, list(texts.items()))
    for share in (0.5, 0.8, 1.0):
        got = dict(result(docs, templates=own, containment=share))
        assert got == {i: plain(t, own[:2], share) for i, t in texts.items()}
    assert all(r.score == 0 and r.labels == [] for r in license_scan.scan(docs, templates=[], phrases={}).collect())


def test_no_python_and_no_cross_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
