"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text in it is a node with a hidden label: does it hold part of the article? Node potentials come from
tags, class, id and role words, lengths, links and punctuation; parent-child potentials connect a node with its element. Messages passed up
and down the tree (sum-product) give exact marginals, both for training, by gradient ascent on the likelihood of labelled pages, and for extraction.
"""

from __future__ import annotations

import functools
import html as htmllib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

#: Bounds of the training sample: pages of the table (only pages of up to so many characters), and made pages.
TRAIN_PAGES = 200
TRAIN_CHARS = 50_000
MADE_PAGES = 400

# HTML element classes (fixed values of the language)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript iframe svg canvas object textarea title select audio video xmp".split())
_CODE = frozenset("script style".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo picture map output".split())
_NO_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "body": ("head",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "body": ("html",)}

# Tags as the HTML standard reads them: a quote opens a value only after an equals sign, and a value without quotes may hold some.
# The first pattern takes tags of the usual kind at once; no pattern goes back over what it has matched.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s"'<>/=]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`]++))?)*+\s*+/?)>""")
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_NAME = re.compile(r"[\s/]*+(=?[^\s/>=]*+)\s*+")
_EQUALS = re.compile(r"=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""([^\s/=]++)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s]*+))?""")
_SHOWN = frozenset("class id role style hidden aria-hidden itemprop".split())
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@functools.cache
def _closer(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)


class Page:
    """Nodes in page order, parents first. kind[n] is the element's (tag, attributes) or None for a run of text."""

    def __init__(self, source: str):
        self.parent, self.kind, self.text, self.linked = [-1], [("#root", "")], [None], [0]
        stack = [("#root", 0)]  # (tag, block node)
        places: dict[str, list[int]] = {}  # where in the stack each open tag stands
        blocks = [0]  # where those that are no inline elements stand
        run: list[str] = []
        links = link_depth = 0
        pos, end = 0, len(source)
        never: set[str] = set()  # quotes and end tags that don't come again

        def flush():
            nonlocal run, links
            if run:
                # piece by piece: markup between two pieces never makes a character reference of them
                joined = " ".join("".join(map(htmllib.unescape, run)).split())
                if joined:
                    self._add(stack[-1][1], None, joined, links)
                run = []
            links = 0

        def open_(tag: str, node: int):
            if tag not in _INLINE:
                blocks.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))

        def close(to: int):
            nonlocal link_depth
            if blocks[-1] >= to:
                flush()
            while len(stack) > to:
                tag, _ = stack.pop()
                places[tag].pop()
                link_depth -= tag == "a"
                if blocks[-1] == len(stack):
                    blocks.pop()

        def last(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def slow_tag(at: int) -> int:
            """Where the attributes after ``at`` end (the place of their >), or -1. A value whose quote is never closed ends at the next >."""
            while True:
                m = _NAME.match(source, at)
                at = m.end()
                if at >= end:
                    return -1
                if m[1] and (e := _EQUALS.match(source, at)):
                    at, q = e.end(), source[e.end() : e.end() + 1]
                    if q in ('"', "'"):
                        close_at = -1 if q in never else source.find(q, at + 1)
                        if close_at < 0:
                            never.add(q)
                            return source.find(">", at)
                        at = close_at + 1
                    elif q != ">":
                        at = _BARE.match(source, at).end()
                if source[at : at + 1] == ">":
                    return at
                if not m[1] and source[at : at + 1] not in ("/", "="):
                    at += 1

        while pos < end:
            lt = source.find("<", pos)
            if lt < 0:
                lt = end
            if lt > pos:
                run.append(source[pos:lt])
                if link_depth:
                    links += lt - pos
            if lt == end:
                break
            if m := _PLAIN_TAG.match(source, lt):
                ending, tag, attributes, pos = m[1], m[2].lower(), m[3], m.end()
            elif m := _TAG_NAME.match(source, lt):
                ending, tag = source[lt + 1] == "/", m[1].lower()
                stop = slow_tag(m.end())
                if stop < 0:
                    break  # the page ends inside a tag
                attributes, pos = source[m.end() : stop], stop + 1
            elif source.startswith("<!--", lt):
                # a comment may be empty and end at once, as in <!--> and <!--->
                short = next((k for k in (5, 6) if source.startswith("<!--" + "-" * (k - 5) + ">", lt)), 0)
                m = None if short else _COMMENT_END.search(source, lt + 4)
                pos = lt + short if short else m.end() if m else end
                continue
            elif source[lt + 1 : lt + 2] in ("!", "?", "/"):
                stop = source.find(">", lt)
                pos = stop + 1 if stop >= 0 else end
                continue
            else:
                run.append("<")
                pos = lt + 1
                continue
            if ending:
                if tag == "br":
                    run.append(" ")
                elif (at := last((tag,))) and (tag not in _INLINE or at > blocks[-1]):
                    close(at)
                continue
            if tag in _VOID:
                if tag in _INLINE or tag in ("br", "wbr", "img"):
                    run.append("" if tag == "wbr" else " ")
                elif tag == "hr":
                    flush()
                continue
            if tag in _RAW:
                if attributes.rstrip().endswith("/") and tag == "svg":
                    continue
                done = None if tag in never else _closer(tag).search(source, pos)
                if done:
                    pos = done.end()
                else:
                    never.add(tag)
                    if tag in _CODE:
                        break  # code up to the end of the page
                run.append(" ")
                continue
            if tag in _INLINE:
                open_(tag, stack[-1][1])
                link_depth += tag == "a"
                continue
            if tag in _NO_P and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if tag in _CLOSES:
                while (at := last(_CLOSES[tag])) > last(_SCOPE[tag]):
                    close(at)
            flush()
            open_(tag, self._add(stack[-1][1], (tag, attributes), None, 0))
        flush()

    def _add(self, parent, kind, text, linked) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def shown_attributes(attributes: str) -> list[tuple[str, str]]:
    """(name, value) of the attributes that tell what an element is for."""
    return [(n, v.strip("\"'")) for n, v in ((n.lower(), v) for n, v in _ATTR.findall(attributes)) if n in _SHOWN]


def element_features(tag: str, attributes: str) -> list[str]:
    out = ["bias", f"tag={tag}"]
    for name, value in shown_attributes(attributes):
        if name in ("hidden", "aria-hidden"):
            out += ["hidden"] * (value.lower() != "false")
        elif name == "style":
            out += ["hidden"] * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        else:
            for w in _TOKENS.findall(value):
                w = w.lower()
                out += [f"w={w}"] + [f"w{k}={w[:k]}" for k in (4, 6) if len(w) > k]
    return out


def text_features(text: str, linked: int, tag: str) -> list[str]:
    n = len(text)
    return ["text", f"in={tag}", f"n={min(10, n.bit_length())}", f"link={min(10, 10 * linked // n)}", f"end={text[-1] in '.!?…。:;'}", f"words={min(8, (text.count(' ') + 1).bit_length())}", f"mark={'©' in text or '|' in text}"]


class TreeModel:
    """Weights: log-odds of content per feature, and a 2x2 table of parent-child potentials for elements and for text."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.edges = {"element": [[0.0, 0.0], [0.0, 0.0]], "text": [[0.0, 0.0], [0.0, 0.0]]}
        self._known: dict[tuple, float] = {}

    def __getstate__(self):
        return self.weights, self.edges

    def __setstate__(self, state):
        self.weights, self.edges = state
        self._known = {}

    def unary(self, page: Page) -> list[float]:
        out, w = [], self.weights
        for n, kind in enumerate(page.kind):
            if kind is None:
                tag = page.kind[page.parent[n]][0]
                out.append(sum(w.get(f, 0.0) for f in text_features(page.text[n], page.linked[n], tag)))
            else:
                if (s := self._known.get(kind)) is None:
                    if len(self._known) > 50_000:
                        self._known.clear()
                    s = self._known[kind] = sum(w.get(f, 0.0) for f in element_features(*kind))
                out.append(s)
        return out

    def marginals(self, page: Page, unary: list[float] | None = None, pairs: bool = False):
        """P(content) of every node; with ``pairs`` also the joint of every node's parent and itself."""
        unary = self.unary(page) if unary is None else unary
        n, parent = len(unary), page.parent
        e = {k: [[math.exp(x) for x in row] for row in t] for k, t in self.edges.items()}
        edge = [e["text" if k is None else "element"] for k in page.kind]
        pot = [_soft(u) for u in unary]
        up0, up1 = [p[0] for p in pot], [p[1] for p in pot]
        msg = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            t = edge[i]
            m0 = t[0][0] * up0[i] + t[0][1] * up1[i]
            m1 = t[1][0] * up0[i] + t[1][1] * up1[i]
            s = m0 + m1
            m0, m1 = m0 / s, m1 / s
            msg[i] = (m0, m1)
            p = parent[i]
            a, b = up0[p] * m0, up1[p] * m1
            s = a + b
            up0[p], up1[p] = a / s, b / s
        down = [(1.0, 1.0)] * n
        out, joint = [0.0] * n, [None] * n
        for i in range(n):
            a, b = up0[i] * down[i][0], up1[i] * down[i][1]
            out[i] = b / (a + b)
            if i:
                p, t = parent[i], edge[i]
                # the parent's belief without this child's message
                q0, q1 = up0[p] * down[p][0] / msg[i][0], up1[p] * down[p][1] / msg[i][1]
                if pairs:
                    j = [[q0 * t[0][0] * up0[i], q0 * t[0][1] * up1[i]], [q1 * t[1][0] * up0[i], q1 * t[1][1] * up1[i]]]
                    s = sum(map(sum, j))
                    joint[i] = [[x / s for x in row] for row in j]
                d0, d1 = q0 * t[0][0] + q1 * t[1][0], q0 * t[0][1] + q1 * t[1][1]
                s = d0 + d1
                down[i] = (d0 / s, d1 / s)
                a, b = up0[i] * down[i][0], up1[i] * down[i][1]
                out[i] = b / (a + b)
        return (out, joint) if pairs else out

    def extract(self, source: str | None) -> str:
        """Blocks of text with a marginal above one half, in page order, one a line."""
        if not source:
            return ""
        page = Page(source)
        p = self.marginals(page)
        return "\n".join(t for t, x in zip(page.text, p, strict=True) if t is not None and x > 0.5)


def _soft(u: float) -> tuple[float, float]:
    """Potentials (0, 1) in proportion 1 : exp(u), away from zero."""
    u = max(-30.0, min(30.0, u))
    return (1.0, math.exp(u)) if u < 0 else (math.exp(-u), 1.0)


def fit(labelled: list[tuple[Page, list[bool]]], epochs: int = 8, rate: float = 0.4, l2: float = 1e-4, seed: int = 3) -> TreeModel:
    """Gradient ascent (per-weight steps) on the log-likelihood of labelled pages; labels[n] tells whether node n holds content."""
    model, sq = TreeModel(), {}
    sq_edge = {k: [[1e-3, 1e-3], [1e-3, 1e-3]] for k in model.edges}
    feats = [[element_features(*k) if k is not None else text_features(p.text[n], p.linked[n], p.kind[p.parent[n]][0]) for n, k in enumerate(p.kind)] for p, _ in labelled]
    rng, order = random.Random(seed), list(range(len(labelled)))
    w = model.weights
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            page, y = labelled[i]
            p, joint = model.marginals(page, [sum(w.get(f, 0.0) for f in fs) for fs in feats[i]], pairs=True)
            grad: dict[str, float] = {}
            for fs, label, x in zip(feats[i], y, p, strict=True):
                if abs(g := label - x) > 1e-6:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + g
            for f, g in grad.items():
                g -= l2 * w.get(f, 0.0)
                sq[f] = sq.get(f, 1e-3) + g * g
                w[f] = w.get(f, 0.0) + rate * g / math.sqrt(sq[f])
            sums = {k: [[0.0, 0.0], [0.0, 0.0]] for k in model.edges}
            for n in range(1, len(y)):
                s = sums["text" if page.kind[n] is None else "element"]
                for a in (0, 1):
                    for b in (0, 1):
                        s[a][b] += (y[page.parent[n]] == a and y[n] == b) - joint[n][a][b]
            for k, s in sums.items():
                for a in (0, 1):
                    for b in (0, 1):
                        sq_edge[k][a][b] += s[a][b] ** 2
                        model.edges[k][a][b] += rate * s[a][b] / math.sqrt(sq_edge[k][a][b])
    return model


def holds_content(page: Page, text_labels: dict[int, bool]) -> list[bool]:
    """Node labels from the labels of the runs of text: an element holds content if a run below it does."""
    y = [bool(text_labels.get(n, False)) for n in range(len(page.parent))]
    for n in range(len(y) - 1, 0, -1):
        if y[n]:
            y[page.parent[n]] = True
    return y


_PARTS = frozenset("nav aside footer form header menu dialog".split())
_WORDS = re.compile(r"\b(nav|menu|sidebar|footer|header|masthead|advert\w*|ad|ads|promo|sponsor\w*|cookie\w*|notice|banner|comments?|share|related|breadcrumbs?|newsletter|subscribe|popup|modal)\b", re.I)


def label_page(source: str) -> tuple[Page, list[bool]] | None:
    """A labelled page, if it marks its article by an article or main element; None if it doesn't."""
    page = Page(source)
    inside, out = [False] * len(page.parent), [False] * len(page.parent)
    for n in range(1, len(page.parent)):
        up = page.parent[n]
        inside[n], out[n] = inside[up], out[up]
        if page.kind[n] is not None:
            tag, attributes = page.kind[n]
            inside[n] = inside[n] or tag in ("article", "main")
            words = " ".join(w for name, w in shown_attributes(attributes) if name in ("class", "id", "role"))
            out[n] = out[n] or (tag in _PARTS and not (tag == "header" and inside[up])) or bool(_WORDS.search(words))
    if not any(inside):
        return None
    return page, holds_content(page, {n: inside[n] and not out[n] for n, k in enumerate(page.kind) if k is None})


def made_page(rng: random.Random) -> tuple[Page, list[bool]]:
    """A page put together at random from usual parts; runs of text of the article begin with a mark, which is taken off again."""
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8)))
    some = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    mark = "⁣"
    link = lambda: f'<a href="/{word()}">{some(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8))) + "</ul>"
    sentence = lambda: mark + some(3, 40).capitalize() + rng.choice("....!?:")

    def wrap(names: str, inner: str) -> str:
        """One of the given tag.class or tag#id forms around it."""
        tag, sep, name = re.match(r"(\w+)([.#]?)(.*)", rng.choice(names.split())).groups()
        attr = {"": "", ".": f' class="{name}"', "#": f' id="{name}"'}[sep]
        return f"<{tag}{attr}>{inner}</{tag}>"

    plain = lambda a=4, b=30: f"<p>{some(a, b).capitalize()}.</p>"

    def block() -> str:
        kind = rng.random()
        if kind < 0.6:
            inner = sentence()
            if rng.random() < 0.3:
                inner += f" {link()} {some(2, 12)}."
            if rng.random() < 0.2:
                inner = f"<b>{inner}</b>"
            return f"<p>{inner}</p>"
        if kind < 0.7:
            return f"<h{(h := rng.randint(2, 4))}>{mark}{some(1, 6)}</h{h}>"
        if kind < 0.8:
            return "<ul>" + "".join(f"<li>{mark}{some(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote><p>{sentence()}</p></blockquote>"
        if kind < 0.9:
            return f"<pre>{mark}{some(3, 20)}</pre>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{mark}{some(1, 3)}</td><td>{mark}{some(1, 3)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.97:
            return f'<figure><img src="x"><figcaption>{mark}{some(3, 10)}</figcaption></figure>'
        return f'<div>{sentence()}</div>'

    advert = lambda: wrap("div.ad div.ads div.advert div.advertisement div.sponsored div.promo div#banner-ad aside.ad section.promo div.ad-slot div.adsbygoogle p.ad", rng.choice((plain, lambda: some(2, 25), links))())
    article = f"<h1>{mark}{some(2, 9)}</h1>"
    if rng.random() < 0.3:
        article = f"<header>{article}</header>"
    for _ in range(rng.randint(1, 14)):
        article += block() + advert() * (rng.random() < 0.08)
    share = wrap("div.share div.social div.share-buttons ul.social-links div.related section.related div.tags div.author-links div.related-posts", links()) if rng.random() < 0.4 else ""
    comments = wrap("div.comments section#comments ol.commentlist div#disqus_thread section.comments div.comment-list div.reader-comments div.user-comments div#responses", "".join(wrap("div.comment li.comment article.comment div.comment-body", plain()) for _ in range(rng.randint(1, 5)))) if rng.random() < 0.5 else ""
    inner = article + share * (rng.random() < 0.5) + comments * (rng.random() < 0.4)
    body = wrap("article article main div.content div#content div.post div.entry-content section.story div.article-body div#main div.post-content div.text div", inner)
    if rng.random() < 0.3:
        body = wrap("main div#main div.container div.wrapper div", body)
    parts = []
    if rng.random() < 0.6:
        parts.append(wrap("header div#header div.header div.masthead div.site-header div.topbar header.site-header", rng.choice((some(1, 5), f"<h1>{some(1, 3)}</h1>", plain(2, 8) + links()))))
    if rng.random() < 0.8:
        parts.append(wrap("nav nav div.menu div.navigation ul.nav div#menu div.navbar nav.main-menu div.breadcrumbs div.topnav", links()))
    if rng.random() < 0.5:
        parts.append(wrap("div.cookie-notice div.notice div#cookie-banner div.gdpr div.alert div.banner section.notice div.consent dialog div.popup div.modal p.notice", rng.choice((plain, lambda: some(5, 30)))()))
    if rng.random() < 0.5:
        parts.append(advert())
    parts.append(body)
    if rng.random() < 0.5:
        parts.append(wrap("aside aside.sidebar div.sidebar div#sidebar div.rightcol div.widget section.sidebar div.side", rng.choice((links, plain, lambda: f"<h3>{some(1, 3)}</h3>" + plain() + links()))()))
    parts += [comments] * (comments not in inner)
    if rng.random() < 0.4:
        parts.append(wrap("form form.newsletter form.search form#login", f"<label>{some(1, 3)}</label><input type=text><p>{some(2, 12)}</p><button>{word()}</button>"))
    if rng.random() < 0.8:
        parts.append(wrap("footer footer div#footer div.footer div.site-footer div.bottom div.copyright", rng.choice((f"© {some(2, 8)}", links() + plain(3, 12), plain(2, 14)))))
    page = Page("<html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>")
    labels = {n: t.startswith(mark) for n, t in enumerate(page.text) if t is not None}
    page.text = [t and t.lstrip(mark) for t in page.text]
    page.text = [t if t or k is not None else "x" for t, k in zip(page.text, page.kind, strict=True)]
    return page, holds_content(page, labels)


def train(pages: DataFrame, max_pages: int = TRAIN_PAGES, max_chars: int = TRAIN_CHARS, made: int = MADE_PAGES) -> TreeModel:
    """Fit on made pages and on a bounded sample of the table: pages that mark their article themselves, in the order of a hash of their html."""
    short = pages.select("html").filter((F.length("html") <= max_chars) & F.lower("html").rlike("<(article|main)[\\s>]")).withColumn("h", F.xxhash64("html"))
    # first the hashes alone, then the pages of these
    chosen = [tuple(r) for r in short.select("h").distinct().orderBy("h").limit(max_pages).collect()]
    sample = []
    if chosen:
        picked = pages.sparkSession.createDataFrame(chosen, "h long")
        sample = [r.html for r in sorted(short.join(F.broadcast(picked), "h").groupBy("h").agg(F.min("html").alias("html")).collect(), key=lambda r: r.h)]
    rng = random.Random(17)
    return fit([made_page(rng) for _ in range(made)] + [x for s in sample if (x := label_page(s)) is not None])


def extract(spark: SparkSession, pages: DataFrame, model: TreeModel) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole html.

    Null or empty html gives an empty text. Ids and urls may be null or repeat. Empty tables give no rows; other columns are not read.
    """
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            sources = b.column(2).to_pylist()
            for a, z in text_slices([len(s or "") for s in sources], 1 << 22):
                texts = [sent.value.extract(s) for s in sources[a:z]]
                yield pa.record_batch([b.column(0)[a:z], b.column(1)[a:z], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(spark, pages, train(pages))


QUERIES = {"op4_html_extract": op4_html_extract}
ORACLE_SQL: dict[str, str] = {}
