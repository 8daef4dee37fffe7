"""Node tables against trees walked in plain Python."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from broadsheet.operators import dom
from broadsheet.operators.contract import MODULE_LABEL, UTILITY_SENTENCE
from broadsheet.sources import dom as source

VOID = {"br", "img", "meta", "link", "input", "hr"}


class Node:
    def __init__(self, tag, attrs, up, text=None):
        self.tag, self.attrs, self.up, self.text, self.down = tag, attrs, up, text, []

    def all(self):
        for d in self.down:
            yield d
            yield from d.all()

    def said(self):
        return " ".join(" ".join(n.text.split()) for n in (self, *self.all()) if n.tag == "#text")


class Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("top", {}, None)
        self.at = self.top

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.down.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.up and n.tag != tag:
            n = n.up
        if n.up:
            self.at = n.up

    def handle_data(self, data):
        if data.strip():
            self.at.down.append(Node("#code" if self.at.tag in ("script", "style") else "#text", {}, self.at, data))


def walked(html):
    w = Walk()
    w.feed(html or "")
    w.close()
    return w.top


def some_html(rng, deep=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        words = " ".join(rng.choices("council approves budget for new bridge over river today again".split(), k=rng.choice((1, 4, 6, 12))))
        if kind < 0.3 or deep > 4:
            out.append(rng.choice((f"<p>{words}.</p>", f"<p>{words}", words, f"<li>{words}</li>", f'<a href="/x">{words}</a>', "<br>", '<img src="/i.png">', f"<h2>{words}</h2>", "<!-- c -->", "<script>var p='<p>';</script>", "</div>", "&amp; x")))
        elif kind < 0.45:
            out.append(f'<div>{"".join(f"""<a href="/{i}">City council approves bridge plan {i}</a><img src="/{i}.png">""" for i in range(rng.choice((2, 3, 4))))}{rng.choice(("", "<div>Read more</div>", "<ul><li>Trending now</li></ul>"))}</div>')
        elif kind < 0.55:
            out.append(f"<{rng.choice(('div', 'section', 'ul'))}>{rng.choice(('Related stories', 'Most read', 'Newsletter', 'Advertisement', 'Budget'))}</div>")
        else:
            tag = rng.choice(("div", "section", "article", "main", "nav", "aside", "ul", "b"))
            attrs = rng.choice(("", "", "", ' class="article-body x"', ' class="relatedStories"', ' id="ad-slot"', " hidden", ' style="display: none"', ' role="complementary"', ' itemprop="articleBody"', ' aria-hidden="TRUE"'))
            out.append(f"<{tag}{attrs}>{some_html(rng, deep + 1)}{rng.choice((f'</{tag}>', f'</{tag}>', ''))}")
    return "".join(out)


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(21)
    rows = [(i, some_html(rng)) for i in range(60)] + [(100, None), (101, ""), (102, "plain words"), (103, "</p></div>")]
    return rows, spark.createDataFrame(rows, "page_id long, html string")


def test_nodes_and_sums(pages):
    rows, df = pages
    n = dom.with_chars(source.nodes(df), links=(F.col("tag") == "a").cast("int"))
    got: dict = {}
    for r in n.collect():
        got.setdefault(r["page"], []).append((r["pre"], r["last"], r["tag"], r["chars"], r["links"]))
    for i, html in rows:
        top = walked(html)
        order = list(top.all())
        at = {id(x): k for k, x in enumerate(order)}
        want = [(k, max([k, *(at[id(y)] for y in x.all())]), x.tag, len(x.said()) if x.tag != "#code" else 0, sum(y.tag == "a" for y in (x, *x.all()))) for k, x in enumerate(order)]
        assert sorted(got.get(i, [])) == want


def score(x):
    said = sum(len(y.said()) for y in x.all() if y.tag in dom.TEXT_TAGS)
    return said + 90 * sum(y.tag == "p" for y in x.all()) - int(0.35 * sum(len(y.said()) for y in x.all() if y.tag == "a"))


def test_choose_root(pages):
    rows, df = pages
    own = ("div.x",)
    selectors = [("div.x", lambda x: x.tag == "div" and "x" in x.attrs.get("class", "").split()), ("[itemprop='articleBody']", lambda x: x.attrs.get("itemprop") == "articleBody")]
    inside = lambda x, tag: x.up is not None and (x.up.tag == tag or inside(x.up, tag))
    selectors += [("article .article-body", lambda x: "article-body" in x.attrs.get("class", "").split() and inside(x, "article")), ("article", lambda x: x.tag == "article"), ("main .article-body", lambda x: "article-body" in x.attrs.get("class", "").split() and inside(x, "main")), ("main", lambda x: x.tag == "main")]
    want = {}
    for i, html in rows:
        order = list(walked(html).all())
        found = [(score(x) + (1500 if k == 0 else 0), -k, -at, s) for k, (s, match) in enumerate(selectors) for at, x in enumerate(order) if not x.tag.startswith("#") and match(x) and score(x) > 80]
        if found:
            total, _, at, s = max(found)
            want[i] = (-at, s, total)
    got = {r["page"]: (r["pre"], r["selector"], r["score"]) for r in dom.choose_root(source.nodes(df), own).collect()}
    assert got == want and len(want) > 20


def test_prune(pages, spark):
    import re

    from broadsheet.config import DEFAULT

    rows, df = pages
    word = re.compile(r"\w+")
    label, utility = (re.compile(x) for x in (MODULE_LABEL, UTILITY_SENTENCE))

    def signal(x):
        raw = " ".join(x.attrs[a] for a in dom.SIGNATURE if a in x.attrs)
        words = re.sub("[^a-z0-9]+", " ", re.sub("([a-z])([A-Z])", r"\1 \2", raw).lower()).strip()
        return any(f" {p} " in f" {words} " for p in (*DEFAULT.module_attributes, "ad", "ads"))

    def hidden(x):
        style = x.attrs.get("style", "").lower().replace(" ", "")
        return "hidden" in x.attrs or x.attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style

    sentence = lambda t: len(word.findall(t)) >= 8 and t[-1:] in ".!?"
    headline = lambda t: 4 <= len(word.findall(t)) <= 24 and 18 <= len(t) <= 220  # noqa: E731  (no commas here)

    def card(x):
        links = [y.said() for y in x.all() if y.tag == "a" and "href" in y.attrs]
        total = x.said()
        if len(links) < 3 or not 50 <= len(total) <= 4500:
            return False
        prose = sum(sentence(y.said()) for y in x.all() if y.tag == "p")
        return sum(map(len, links)) / len(total) >= 0.62 and sum(map(headline, links)) >= 3 and prose <= 1 and sum(y.tag == "img" for y in x.all()) >= 2

    def labelled(x):
        t = x.said()
        return bool(t) and len(word.findall(t)) <= 14 and bool(label.search(t) or utility.search(t)) and sum(y.tag == "p" for y in x.all()) <= 1

    want = {}
    for i, html in rows:
        top = walked(html)
        order = list(top.all())
        for x in order:
            if x.tag in dom.REMOVE_TAGS or hidden(x):
                if x in x.up.down:
                    x.up.down.remove(x)
        depth = lambda x: 0 if x.up is None else 1 + depth(x.up)
        alive = set(map(id, top.all()))
        for x in sorted((y for y in top.all() if y.tag in dom.CONTAINERS), key=depth, reverse=True):
            if id(x) in alive and (x.attrs.get("role", "").lower() in ("navigation", "complementary") or signal(x) or labelled(x) or card(x)):
                x.up.down.remove(x)
                alive = set(map(id, top.all()))
        left = [k for k, x in enumerate(order) if id(x) in alive]
        if left:
            want[i] = left
    got: dict = {}
    for r in dom.prune(source.nodes(df)).collect():
        got.setdefault(r["page"], []).append(r["pre"])
    assert {k: sorted(v) for k, v in got.items()} == want


def test_selectors_that_are_not_simple(spark):
    with pytest.raises(ValueError):
        dom._simple("div > p")


def test_references_without_semicolon_are_text(spark):
    """As in the SQL of dom_totals."""
    html = "<html><title>a &amp</title><p>b &amp; &copy; &copy &ampx; && &#65; &#65</p><a href='/?x=1&copy=2&amp;y'>c</a><script>if (a && b) x = '&amp;&lt'</script></html>"
    rows = [(r[3], r[4], r[5]) for r in source.tree(html)]
    assert [x for t, _, x in rows if t == "#text"] == ["a &amp", "b & © &copy &ampx; && A &#65", "c"]
    assert [a for t, a, _ in rows if t == "a"] == [{"href": "/?x=1&copy=2&y"}]
    assert [x for t, _, x in rows if t == "#code"] == ["if (a && b) x = '&amp;&lt'"]
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r["chars"] for r in dom.with_chars(source.nodes(df)).where("tag = 'html'").collect()] == [len("a &amp b & © &copy &ampx; && A &#65 c")]
