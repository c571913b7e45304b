from awkward import TEXTS, clashing, documents
from brute import UPPER

from offermarket.llm.line_dedup import drop_shared_lines

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=10, min_docs=2):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(BLANKS).translate(UPPER)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            ids = holders.get(line.strip(BLANKS).translate(UPPER), set())
            # The NULL id comes after all others.
            if len(ids) < min_docs or d == min(ids, key=lambda x: (x is None, x or 0)):
                kept.append(line)
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def result(docs, **options):
    df = drop_shared_lines(docs, **options)
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)


def test_awkward_rows(spark):
    assert result(documents(spark)) == plain(TEXTS)


def test_threshold(spark):
    rows = [(i, f"shared by three lines\nshared by all lines of it\nown line number {i}") for i in range(3)]
    rows.append((9, "shared by all lines of it"))
    assert result(documents(spark, rows), min_docs=4) == plain(rows, min_docs=4)


def test_hot_line_over_many_documents(spark):
    rows = [(i, f"this line is everywhere\nline {i} {'x' * 9}") for i in range(3000)]
    assert result(documents(spark, rows)) == plain(rows)


def test_clashing_columns_and_empty_table(spark):
    docs = clashing(spark, "line_hash", "lost", "keeper", "n_dropped", "text_key")
    df = drop_shared_lines(docs)
    assert df.columns == [*docs.columns, "n_lines"]
    assert {r.lost for r in df.collect()} == {"clash"} and result(docs) == plain(TEXTS)
    assert drop_shared_lines(documents(spark, [])).count() == 0


def test_n_chars_follows_the_text(spark):
    assert all(r.n_chars == len(r.text) for r in drop_shared_lines(documents(spark)).collect())
