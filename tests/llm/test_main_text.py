import pytest
from awkward import LONG

from offermarket.llm.main_text import extract, main_text

PROSE = "The fox of the house was in the garden and it is said that it was there for the whole of that day."
OTHER = "As for the dog, it was not with them, but it is one of those that are at home in all of the houses."

PAGES = {
    "article with all around it": (
        "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<header><h1>Site</h1></header><nav><ul><li><a href='/a'>A</a></li></ul></nav><!-- note -->"
        f"<div class='ad'>{PROSE}</div><article><h1>Title &amp; more</h1><p><b>{PROSE}<br><p>Short.</p>"
        f"<div class='advert'>{OTHER}</div><p>{OTHER}</p><section class='comments'><p>{PROSE}</p></section>"
        f"</article><aside>{PROSE}</aside><footer>&copy; {OTHER}</footer></body></html>",
        f"Title & more\n{PROSE}\nShort.\n{OTHER}",
    ),
    "named container": (
        f"<body><div id=header><p>{PROSE}</p></div><div class='main-content has-sidebar'><h2>Head</h2><p>{PROSE}</p>"
        f"<form><p>{OTHER}</p></form><p>Hi <i>th</i>ere.</p></div><div class='sidebar'><p>{OTHER}</p></div>"
        f"<div id='comments'><p>{OTHER}</p></div>",
        f"Head\n{PROSE}\nHi there.",
    ),
    "no marks at all": (
        f"<div><a href=/>Home</a> | <a href=/b>About us</a></div><div><h1>Title of it</h1><p>{PROSE}</p><p>Short.</p>"
        f"<p>{OTHER}</p></div><div>&copy; All rights reserved</div>",
        f"Title of it\n{PROSE}\nShort.\n{OTHER}",
    ),
    "advert left open before the article": (f"<div class=ad>Buy<article><p>Text.</article>", "Text."),
    "cut off": ("<article><p>Only &lt;b&gt; is <a href='x'>li", "Only <b> is li"),
    "cut off in a tag": ("<article><p>Words here.</p><p class='x", "Words here."),
    "white space": ("<article><p> a&nbsp;\t b\n\n c </p><p>d<br>e<br><br>f</p></article>", "a b c\nd e\nf"),
    "links inside": (
        f"<article><p>{PROSE} <a href=x>a link</a></p><ul><li><a href=1>one</a><li><a href=2>two</a></ul><p>{OTHER}</p></article>",
        f"{PROSE} a link\n{OTHER}",
    ),
    "other script": ("<article><p>日本語のテキスト。</p></article>", "日本語のテキスト。"),
    "hidden": (f"<article><p>Yes.</p><p hidden>{PROSE}</p><p style='display: none'>{PROSE}</p></article>", "Yes."),
    "several articles": (f"<article><p>Tea.</p></article><article><p>{PROSE}</p></article>", PROSE),
    "title outside the content": (
        f"<main><h1>Head</h1><div class='topnav'><p>{OTHER}</p></div><article><p>{PROSE}</p><article><p>{OTHER}</p></article>"
        f"<p>End.</p></article><h1>Not this</h1></main>",
        f"Head\n{PROSE}\nEnd.",
    ),
    "title in the header of a post": (
        f"<div class='post'><header class='entry-header'><h1>Head</h1></header><div class='entry-content'><p>{PROSE}</p>"
        f"<p>{OTHER}</p></div><div class='usercomments'><p>{PROSE}</p></div></div>",
        f"Head\n{PROSE}\n{OTHER}",
    ),
    "headings with names": (
        f"<article class='overflow-hidden'><h2 class='section-header'>Head</h2><p>{PROSE}</p></article>",
        f"Head\n{PROSE}",
    ),
    "shouting tags": (f"<DIV CLASS='AD'>{OTHER}</DIV><ARTICLE><P>{PROSE}</P></ARTICLE>", PROSE),
    "empty": ("", ""),
    "null": (None, ""),
    "no text": ("<html><body><img src=x></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, wanted = PAGES[name]
    assert extract(page) == wanted


def test_links_in_running_words_stay_and_link_lists_go():
    prose = "<p>It was the first time that the town had been seen by all of them in the morning and it was good.</p>"
    sentence = "<p><a href=x>See the full report on the matter here</a></p>"
    links = "<p><a href=a>Home</a> <a href=b>Archive</a> <a href=c>Sports</a></p>"
    text = extract(f"<article>{prose}{sentence}{prose}{links}<p>A short one.</p>{links}<h3>Topics</h3>{links}</article>").split("\n")
    first = prose[3:-4]
    assert text == [first, "See the full report on the matter here", first, "A short one."]


def test_names_of_chapters_are_judged_by_their_text():
    section = f"<section class='discussion'><h2>Discussion</h2><p>{PROSE} {PROSE} {OTHER}</p></section>"
    legal = f"<p class='legal'>{OTHER}</p>"
    links = "<div class='related'><a href=a>Ten best hats</a> <a href=b>Rain boots review</a></div>"
    comments = f"<section class='discussion'><div class='comment'><p>{OTHER}</p></div></section>"
    page = f"<article><p>{PROSE}</p>{section}<p>{OTHER}</p>{legal}{links}{comments}</article>"
    assert extract(page).split("\n") == [PROSE, "Discussion", f"{PROSE} {PROSE} {OTHER}", OTHER, OTHER]
    # Outside of a marked article the same names mark surroundings.
    assert extract(f"<div class='related'><p>{OTHER}</p></div><article><p>{PROSE}</p></article>") == PROSE


def unmarked(page):
    """The page without what names its parts."""
    import re

    return re.sub(r"</?(?:article|main|nav|footer|header|aside)\b[^>]*>", "<div>", re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^ >]+)", "", page))


def test_blocks_of_pages_without_marks(spark, sf_dir):
    """With all marks taken out, the rules find nearly the same blocks."""
    both = found = wanted = 0
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        true, got = extract(row.html).split("\n"), extract(unmarked(row.html)).split("\n")
        wanted, found = wanted + len(true), found + len(got)
        both += sum(block in true for block in got)
    assert 2 * both / (found + wanted) >= 0.95


@pytest.mark.parametrize("page", ["<" * 3000, "<a " * 2000, "<p class='" * 500, "<div>" * 3000 + "x", "&#x;&#99999999;&am", "<!--", "<script>x"])
def test_broken_markup_ends(page):
    assert isinstance(extract(page), str)


def test_frame(spark):
    rows = [(i, name, page) for i, (name, (page, _)) in enumerate(PAGES.items())] + [(None, None, f"<article><p>{LONG}")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    clash = pages.selectExpr("*", "'clash' as text", "'clash' as _x")
    got = {r.page_id: (r.text, r._x) for r in main_text(clash, carry=clash.columns).collect()}
    assert got[None] == (LONG.strip(), "clash")
    assert all(got[i] == (wanted, "clash") for i, (_, wanted) in enumerate(PAGES.values()))
    assert main_text(pages.limit(0), carry=["page_id"]).count() == 0


def test_whole_table_by_its_template(spark, sf_dir):
    """The given pages have one template, so a pattern finds the same article."""
    import html
    import re

    from offermarket.llm.queries import QUERIES

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op1_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        parts = [" ".join(html.unescape(p).split()) for p in re.split("</?p>|<br>|</?h1>", inner.replace("<b>", "").replace("</b>", ""))]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
