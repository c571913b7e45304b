import hashlib

from awkward import TEXTS, clashing, documents

from offermarket.llm.exact_dedup import exact_groups


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for i, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), i == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(docs):
    df = exact_groups(docs, digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_awkward_rows(spark):
    assert result(documents(spark)) == plain(TEXTS)


def test_spaces_and_longest_original(spark):
    rows = [(1, "ab"), (2, "a b"), (3, "a\n b"), (4, "a \tb"), (5, "ba"), (6, "a b")]
    got = result(documents(spark, rows))
    assert got == plain(rows)
    assert [r[1] for r in got][:4] == [3, 3, 3, 3]


def test_same_prefix_and_length_differ_later(spark):
    rows = [(i, "p" * 100 + str(i % 3)) for i in range(30)]
    assert result(documents(spark, rows)) == plain(rows)


def test_hot_group(spark):
    rows = [(i, "copy of it" if i % 3 else f"text {i}") for i in range(3000)]
    assert result(documents(spark, rows)) == plain(rows)


def test_singles_without_digest_clashes_and_empty(spark):
    docs = clashing(spark, "length", "prefix", "slot", "bare", "copies", "kept")
    assert result(docs) == plain(TEXTS)
    single = exact_groups(documents(spark, [(1, "x y z"), (2, "something else")])).collect()
    assert all(r.kept and r.keep_id == r.doc_id for r in single)
    assert exact_groups(documents(spark, [])).count() == 0
