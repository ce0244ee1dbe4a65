import html
import itertools
import math
import random
import re
import time

import pytest

from caseflow.llm import html_extract as he


def plain(h):
    """The article of a page of the tables by plain rules."""
    a = h.index("<article>") + 9
    z = h.index("</article>") if "</article>" in h else len(h)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", h[a:z]))
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(17)
    return he.fit([he.made_page(rng) for _ in range(400)])


def test_whole_table_against_plain_rules(spark, sf):
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in he.op4_html_extract(spark, sf).collect()}
    assert {i: (r.url, r.text) for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_marginals_equal_enumeration(model):
    page = he.Page("<div class=menu><p>one two.</p></div><article><p>three four five.</article>")
    u = model.unary(page)
    n, z, want = len(u), 0.0, [0.0] * len(u)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(u[i] for i in range(n) if y[i])
        s += sum(model.edges["text" if page.kind[i] is None else "element"][y[page.parent[i]]][y[i]] for i in range(1, n))
        z += math.exp(s)
        for i in range(n):
            want[i] += y[i] * math.exp(s)
    got, joint = model.marginals(page, pairs=True)
    assert got == pytest.approx([w / z for w in want])
    assert all(j[0][1] + j[1][1] == pytest.approx(p) for j, p in zip(joint[1:], got[1:], strict=True))


def test_held_out_made_pages(model):
    rng = random.Random(99)
    right = total = 0
    for _ in range(200):
        page, y = he.made_page(rng)
        for k, a, p in zip(page.kind, y, model.marginals(page), strict=True):
            if k is None:
                right, total = right + (a == (p > 0.5)), total + 1
    assert right / total > 0.98


def test_a_page_with_every_kind_of_part(model):
    source = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
    <header id="header"><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies to serve you better.</p></div>
    <div id="content"><h1>The  title &amp; more</h1><p>First&nbsp;paragraph of the story, with <a href=x>a link</a> in it.<br>And a line.
    <div class="ad">Buy now.</div><p>Second paragraph &lt;here&gt; with <b>bold <i>words</b></i>.</p><script>if (a<b) "</p>"</script>
    <ul><li>item one</li><li>item two</li></ul></div>
    <aside class="sidebar"><h3>Popular</h3><p>Another story that people read.</p></aside>
    <section id="comments"><div class="comment"><p>I liked this story very much.</p></div></section>
    <form class="newsletter"><label>Mail</label><input><button>Go</button></form><footer>© 2024 Company | Terms</footer></body></html>"""
    assert model.extract(source).split("\n") == [
        "The title & more",
        "First paragraph of the story, with a link in it. And a line.",
        "Second paragraph <here> with bold words.",
        "item one",
        "item two",
    ]


def test_nulls_broken_markup_repeats_and_empty(spark, model):
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "<article><p>a b c d.</p>", 3), (2, None, "<p" * 500 + "<<>&#x110000;</b></div>", 4), (3, "u", "<div>" * 30000 + "<p>deep text here.</p>", 5), (4, "u", "<article><p>" + "word " * 300000 + "</p></article>", 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = he.extract(spark, pages, model).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert sorted((r.page_id, r.text[:9]) for r in got if r.page_id in (1, 4)) == [(1, ""), (1, "a b c d."), (4, "word word")]
    assert he.extract(spark, pages.limit(0), model).count() == 0
    assert he.op4_html_extract


def runs(source):
    return [x for x in he.Page(source).text if x]


@pytest.mark.parametrize(
    "source,want",
    [
        ("<p data-x=it's>Hello world. It's fine</p><p>second</p>", ["Hello world. It's fine", "second"]),
        ("<!--><p>Hello</p>", ["Hello"]),
        ("<!---><p>Hello</p>", ["Hello"]),
        ("<!-- a -- > <p>in</p> --><p>out</p>", ["out"]),
        ('<a href="x>foo', ["foo"]),
        ('<p title="a>b">x</p>', ["x"]),
        ("<select><p>rest</p>", ["rest"]),
        ("<title>x<p>rest</p>", ["x", "rest"]),
        ("<script>if (a<b) {}</script>t<script>never closed <p>x</p>", ["t"]),
        ("a < b <p>c</p>", ["a < b", "c"]),
        ('<p a="1"b="2" =x>z</p>', ["z"]),
        ("<div><b>x<div>y</b>z</div>w</div>", ["x", "yz", "w"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("x<p a", ["x"]),
    ],
)
def test_broken_markup(source, want):
    assert runs(source) == want


@pytest.mark.parametrize(
    "source",
    ["<div></foo>" * 180000, "<b><div>" + "<i>" * 100000 + "</b>" * 100000, "<div>" * 100000 + "<li>" * 100000, '<a href="x>' * 180000, "<select>" * 200000, "<!--" * 400000, "<p " + "a=b " * 500000 + "<", "<table>" * 50000 + "<td>" * 200000],
    ids=["unmatched", "inline", "implied", "quotes", "unclosed", "comments", "attributes", "cells"],
)
def test_broken_markup_takes_linear_time(source):
    start = time.time()
    runs(source)
    assert time.time() - start < 20


def test_held_out_pages_without_article_elements(model):
    rng, hit, got, want = random.Random(991), 0, 0, 0
    pages = [he.made_page(rng) for _ in range(300)]
    pages = [(p, y) for p, y in pages if not any(k and k[0] in ("article", "main") for k in p.kind)]
    assert len(pages) > 100
    for page, y in pages:
        for text, x, label in zip(page.text, model.marginals(page), y, strict=True):
            if text is not None:
                got, want, hit = got + len(text) * (x > 0.5), want + len(text) * label, hit + len(text) * (label and x > 0.5)
    assert hit / got > 0.97 and hit / want > 0.97


@pytest.mark.parametrize("source,text", [("AT&<b>amp;</b>T and &l<i>t;</i>x", "AT&amp;T and &lt;x"), ("&am<!-- x -->p;", "&amp;"), ("a &lt; b &amp;amp; c &eacute;<b>&nbsp;</b>&#x41;", "a < b &amp; c é A"), ("1 < 2 &lt 3", "1 < 2 < 3")])
def test_references_are_decoded_within_a_piece_of_text(source, text):
    page = he.Page(f"<p>{source}</p>")
    assert [t for t in page.text if t is not None] == [text]
