"""Main-text extraction: the tree on held-out pages, cases of boilerplate and article text, and odd tables."""

import random

import pytest

from quire.llm import htmltext


def docs_of(spark, rows, schema):
    return spark.createDataFrame(list(rows), schema)


#: Labelled like htmltext.LABELLED.
HELD_OUT = (
    "-x2/2 -x1/1 -x1/1 -x14! +h7@ +p20@ +p3/3@ +x10@ +p66/5@ -p9@! -p30 -x4/4",
    "-x1/1! -x2/2! +h3@ +p2@ -x16! -p5",
    "-x1/1 -x3/3 -x2/2 +h9 +p48/2 +p6 +p31 -x4/4 -x5/5",
    "+h6 +p3 +p2 +p77/6 +p12",
    "-x2/2 -x1/1 -x2/2 +x70/4 +x33 +p28 -x3/3 -x1/1",
    "-h1 -x3/3 -x2/2 -x4/4 +h6 +p52 +x7 +x11 +p19 -h2 -x6/6 -x5/5 -x7/7",
    "+h4 +p38/10 +h2 +p4 +p58 -p14! -x2/2 -x2/2",
    "-x1/1 -x1/1 +h11 +p90 +p1 +p24/3 -x6/6 -x4/4 -p7/6",
)


def test_tree_labels_held_out_blocks():
    tree, table = htmltext.trained(), htmltext.labelled(HELD_OUT)
    right = [htmltext.is_main(tree, tuple(row[:-1])) == bool(row[-1]) for row in table]
    assert sum(right) / len(right) >= 0.95


def splits(tree):
    return {htmltext.FEATURES[tree.feature]} | splits(tree.yes) | splits(tree.no) if isinstance(tree, htmltext.Split) else set()


def test_tree_uses_the_neighbours():
    assert {"words after", "link density after"} <= splits(htmltext.trained())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>One two three.</p><div class="post-ad-free">A paragraph of ours.</div></article>', "One two three.\nA paragraph of ours."),
        ('<article><section id="search-engines"><p>Search engines.</p></section></article>', "Search engines."),
        ("<article><p>See <a href=x>the full list of references here</a></p></article>", "See the full list of references here"),
        ("<article><p>Text first.</p><ul><li><a>one</a></li><li><a>two</a></li></ul></article>", "Text first.\none\ntwo"),
        ("<h1>Short title</h1><p>Yes.</p>", "Short title\nYes."),
        ('<article><p>Our text.</p><div class="ad">Buy this now</div><p>Goes on.</p></article>', "Our text.\nGoes on."),
        ('<article><p>Our text.</p><section class="comments-list"><p>First to comment here.</p></section></article>', "Our text."),
        ('<article><p>Our text.</p><div id="AdSlot-3"><p>Buy more things today.</p></div><form><p>Name</p></form></article>', "Our text."),
        ('<article><header class="article-header"><h2>Head &amp; more</h2></header><p>a\n b<br>c</p></article>', "Head & more\na b c"),
        ('<div class="cookie-notice">We use cookies on all of our pages.</div><article><p>Our text.</p></article><div hidden>gone</div>', "Our text."),
        ('<article><p>Our text.</p><div class="ad__label">Advert</div></article>', "Our text."),
        *[(f"<article><p>Our text.</p><p {a}>Goes on here.</p></article>", "Our text.\nGoes on here.") for a in ('data-id="menu"', 'title="the hidden truth"', "data-note='not hidden'", 'data-hidden="false"', 'data-testid="header"', 'alt="class=menu"', "x=\"id='nav'\"", "data-role=navigation")],
        *[(f"<article><p>Our text.</p><p {a}>Goes on here.</p></article>", "Our text.") for a in ("hidden", "HIDDEN=''", 'x="a>b" hidden', "class=menu", "data-x='1' ID = \"main-menu\"", 'style="display : none"')],
        ('<div role="main"><p>Our own text stands here.</p></div><p>Outside of it</p>', "Our own text stands here."),
        ("<article><h1>A title of it</h1><p>" + "word " * 20 + "</p><p>" + "word " * 20 + "</p></article>", "A title of it\n" + "word " * 19 + "word\n" + "word " * 19 + "word"),
    ],
)
def test_main_text_cases(page, text):
    assert htmltext.main_text(page, htmltext.trained()) == text


def test_pages_that_end_with_their_article_lose_nothing():
    rng, tree = random.Random(3), htmltext.trained()
    words = lambda n: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(n))
    for _ in range(400):
        paragraphs = [words(rng.randrange(5, 120)) for _ in range(rng.randrange(1, 9))]
        title, wrap = words(rng.randrange(2, 9)), rng.choice(["article", "main", "div"])
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f'<nav><a href="x">Home</a> <a href="y">About us</a></nav><{wrap}><h1>{title}</h1>{body}</{wrap}>'
        assert htmltext.main_text(page, tree) == "\n".join([title, *paragraphs])


def test_extract_defined_results(spark):
    schema = "page_id long, html string, HTML_size int, url string"
    rows = [(1, None, 1, "a"), (2, "", None, None), (3, "<article><p>" + "long text " * 200_000 + "</p></article>", 3, "c"), (None, "<p>Some words of a page that stand here</p>", 4, "d"), (None, "<p>Some words of a page that stand here</p>", 4, "d")]
    out = htmltext.extract(docs_of(spark, rows, schema))
    assert out.columns == ["page_id", "HTML_size", "url", "text"]
    texts = sorted((r.text for r in out.collect()), key=len)
    assert texts[:2] == ["", ""] and texts[2] == texts[3] == "Some words of a page that stand here" and texts[4].count("long text") == 200_000
    assert htmltext.extract(docs_of(spark, rows, schema).where("false")).count() == 0
    with pytest.raises(ValueError):
        htmltext.extract(docs_of(spark, rows, "page_id long, html string, n int, Text string"))
