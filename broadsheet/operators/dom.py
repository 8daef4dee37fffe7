"""Choosing and pruning in tables of nodes (see sources/dom): sums over subtrees, roots of articles, modules that go.

A sum over a subtree is a difference of two prefix sums in document order, at its start and its end; a node lies in a
subtree if its number does. Nothing walks a tree, and a page never leaves its partition's sort.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import collapse, unicode_word_count
from ..sources.scratch import folder, forget, saved
from .contract import MODULE_LABEL, UTILITY_SENTENCE, headline, sentence

#: Elements whose text makes an article's score (fixed values).
TEXT_TAGS = ("p", "h2", "h3", "blockquote", "li")
REMOVE_TAGS = ("script", "style", "noscript", "nav", "footer", "form", "button")
CONTAINERS = ("aside", "section", "div", "ul", "ol", "figure", "footer", "nav")
SIGNATURE = ("id", "class", "role", "aria-label", "data-testid", "data-component", "data-module", "data-type", "data-content-type")
#: Least score of a root, and what a source's own selector adds.
LEAST, OWN = 80, 1500


def subtree_sums(nodes: DataFrame, **weights: Column) -> DataFrame:
    """nodes with a column for each weight: its sum over the node's descendants and itself.

    Weights add up along the page; where a subtree ends, a mark without weight reads the sum. Nodes may have been taken out
    before: an end needs no node.
    """
    run = Window.partitionBy("page").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = nodes.select("page", "pre", F.col("pre").alias("at"), F.lit(0).alias("side"), *[F.coalesce(w, F.lit(0)).cast("long").alias(n) for n, w in weights.items()])
    ends = nodes.select("page", "pre", F.col("last").alias("at"), F.lit(1).alias("side"), *[F.lit(0).cast("long").alias(n) for n in weights])
    both = starts.unionByName(ends).withColumns({f"upto_{n}": F.sum(n).over(run) for n in weights})
    between = {n: F.sum(F.when(F.col("side") == 1, F.col(f"upto_{n}")).otherwise(F.col(n) - F.col(f"upto_{n}"))) for n in weights}
    return nodes.join(both.groupBy("page", "pre").agg(*[c.alias(n) for n, c in between.items()]), ["page", "pre"])


def with_chars(nodes: DataFrame, **more: Column) -> DataFrame:
    """nodes with chars, the length of a subtree's text, its pieces joined by one space; and more sums."""
    piece = F.when(F.col("tag") == "#text", F.length(collapse("text")) + 1)
    return subtree_sums(nodes, chars=piece, **more).withColumn("chars", F.greatest(F.col("chars") - 1, F.lit(0)))


def texts(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(page, pre, last) -> page, pre, said: the text of each subtree, pieces joined by one space."""
    pieces = nodes.where("tag = '#text'").select("page", F.col("pre").alias("at"), collapse("text").alias("piece"))
    inside = wanted.select("page", "pre", "last").join(pieces, "page").where("at between pre and last")
    return inside.groupBy("page", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), " ").alias("said"))


_SIMPLE = re.compile(r"(?P<tag>[a-z0-9]+)?(?:#(?P<id>[\w-]+))?(?P<classes>(?:\.[\w-]+)*)(?:\[(?P<name>[\w-]+)(?:(?P<op>[*^$]?=)'(?P<value>[^']*)'(?P<fold> i)?)?\])?")


def _simple(selector: str) -> Column:
    """Whether a node is what a selector without descendants names: tag, #id, .class, [name='value'] and [name*='value' i]."""
    m = _SIMPLE.fullmatch(selector)
    if not m or not selector:
        raise ValueError(f"not a simple selector: {selector}")
    out = ~F.startswith("tag", F.lit("#"))
    if m["tag"]:
        out &= F.col("tag") == m["tag"]
    if m["id"]:
        out &= F.col("attrs")["id"] == m["id"]
    for c in (m["classes"] or "").split(".")[1:]:
        out &= F.array_contains(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), c)
    if m["name"]:
        value, want = F.col("attrs")[m["name"]], m["value"] or ""
        value, want = (F.lower(value), want.lower()) if m["fold"] else (value, want)
        tests = {"=": lambda: value == want, "*=": lambda: F.contains(value, F.lit(want)), "^=": lambda: F.startswith(value, F.lit(want)), "$=": lambda: F.endswith(value, F.lit(want)), None: value.isNotNull}
        out &= tests[m["op"]]()
    return F.coalesce(out, F.lit(False))


def selected(nodes: DataFrame, selectors: tuple[str, ...]) -> DataFrame:
    """(page, pre, priority): what each selector matches; parts of one, apart by a space, lie inside each other.

    A node is inside a match if an earlier one reaches beyond it: the greatest end so far, over nodes in order.
    """
    before = Window.partitionBy("page").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    found = []
    for i, s in enumerate(selectors):
        level = nodes.withColumn("hit", F.lit(True))
        for k, part in enumerate(s.split()):
            inside = F.col("pre") <= F.coalesce(F.max(F.when(F.col("hit"), F.col("last"))).over(before), F.lit(-1))
            level = level.withColumn("hit", _simple(part) & (inside if k else F.lit(True)))
        found.append(level.where("hit").select("page", "pre", F.lit(i).alias("priority")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def root_scores(nodes: DataFrame) -> DataFrame:
    """nodes with chars, and score: text of paragraphs and the like below, 90 for each paragraph, less 0.35 of the links' text."""
    sized = with_chars(nodes)
    tag, below = F.col("tag"), lambda c: F.when(c, F.col("chars"))
    summed = subtree_sums(sized, said=below(tag.isin(*TEXT_TAGS)), linked=below(tag == "a"), paragraphs=(tag == "p").cast("int"))
    own = lambda n, c, w: F.col(n) - F.when(c, w).otherwise(0)  # noqa: E731  a node isn't below itself
    said, linked, ps = own("said", tag.isin(*TEXT_TAGS), F.col("chars")), own("linked", tag == "a", F.col("chars")), own("paragraphs", tag == "p", F.lit(1))
    return summed.withColumn("score", said + ps * 90 - F.floor(linked * 0.35)).drop("said", "linked", "paragraphs")


def choose_root(nodes: DataFrame, own: tuple[str, ...] = (), config: Config = DEFAULT) -> DataFrame:
    """page, pre, last, selector, score: the best root of each page that has one. Own selectors come first and have a bonus; of equals the earlier selector, then the earlier node."""
    selectors = tuple(dict.fromkeys((*own, *config.generic_roots)))
    scored = root_scores(nodes).select("page", "pre", "last", "score").where(F.col("score") > LEAST)
    met = scored.join(selected(nodes, selectors), ["page", "pre"]).withColumn("total", F.col("score") + F.when(F.col("priority") < len(own), OWN).otherwise(0))
    best = met.groupBy("page").agg(F.max_by(F.struct("pre", "last", "priority", "total"), F.struct("total", -F.col("priority"), -F.col("pre"))).alias("r"))
    return best.select("page", "r.pre", "r.last", F.get(F.array(*[F.lit(s) for s in selectors]), F.col("r.priority")).alias("selector"), F.col("r.total").alias("score"))


def without(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """nodes but for the subtrees of those marked(page, pre)."""
    upto = Window.partitionBy("page").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = nodes.join(marked.select("page", "pre", F.lit(True).alias("marked")).distinct(), ["page", "pre"], "left")
    covered = F.coalesce(F.max(F.when(F.col("marked"), F.col("last"))).over(upto), F.lit(-1))
    return told.withColumn("covered", covered).where("covered < pre").select(*nodes.columns)


def hidden() -> Column:
    style = F.replace(F.lower(F.coalesce(F.col("attrs")["style"], F.lit(""))), F.lit(" "), F.lit(""))
    return F.map_contains_key("attrs", "hidden") | F.coalesce(F.lower(F.col("attrs")["aria-hidden"]) == "true", F.lit(False)) | F.contains(style, F.lit("display:none")) | F.contains(style, F.lit("visibility:hidden"))


def module_signal(config: Config = DEFAULT) -> Column:
    """Whether the names of an element say that it is a module: words of its id, classes, role and the like."""
    raw = collapse(F.array_join(F.filter(F.array(*[F.col("attrs")[a] for a in SIGNATURE]), lambda v: v.isNotNull()), " "))
    words = F.trim(F.regexp_replace(F.lower(F.regexp_replace(raw, "([a-z])([A-Z])", "$1 $2")), "[^a-z0-9]+", " "))
    phrases = (*config.module_attributes, "ad", "ads", "outbrain", "taboola")
    return F.rlike(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(f" (?:{'|'.join(phrases)}) "))


def _modules(nodes: DataFrame) -> DataFrame:
    """(page, pre): containers that are a module by what they show, none of them inside another: a short label, or cards of links."""
    tag = F.col("tag")
    sized = with_chars(nodes, links=((tag == "a") & F.map_contains_key("attrs", "href")).cast("int"), ps=(tag == "p").cast("int"), images=(tag == "img").cast("int"), pieces=(tag == "#text").cast("int"), words=F.when(tag == "#text", unicode_word_count(collapse("text"))))
    boxes = saved(sized.where(tag.isin(*CONTAINERS) & (F.col("pieces") > 0)), path := folder(nodes.sparkSession, "boxes"))
    short = boxes.where("words <= 14 and ps <= 1").select("page", "pre", "last")
    label = texts(nodes, short).where(F.rlike("said", F.lit(MODULE_LABEL)) | F.rlike("said", F.lit(UTILITY_SENTENCE))).select("page", "pre")
    cards = boxes.where("links >= 3 and images >= 2 and chars between 50 and 4500").select("page", "pre", "last", "chars")
    inner = nodes.where((tag == "p") | ((tag == "a") & F.map_contains_key("attrs", "href"))).select("page", "pre", "last", "tag")
    said = inner.join(texts(nodes, inner), ["page", "pre"]).select("page", F.col("pre").alias("at"), "tag", "said")
    link = F.col("tag") == "a"
    told = cards.join(said, "page").where("at > pre and at <= last").groupBy("page", "pre", "chars").agg(F.count_if(link).alias("n"), F.sum(F.when(link, F.length("said"))).alias("linked"), F.count_if(link & headline("said")).alias("heads"), F.count_if(~link & sentence("said")).alias("prose"))
    card = told.where("n >= 3 and heads >= 3 and prose <= 1 and linked / greatest(1, chars) >= 0.62").select("page", "pre")
    found = saved(label.unionByName(card).distinct().join(boxes.select("page", "pre", "last"), ["page", "pre"]), folder(nodes.sparkSession, "modules"))
    forget(nodes.sparkSession, path)
    # deepest first: one that holds another is looked at again without it
    inside = found.alias("a").join(found.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("b.pre") > F.col("a.pre")) & (F.col("b.pre") <= F.col("a.last")), "left_anti")
    return inside.select("page", "pre")


def prune(nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """nodes without scripts, hidden elements and modules: by tag, style, role, names, and from the inside out by what they show.

    Each round takes the innermost modules of all pages at once, so there are as many rounds as modules lie inside each other.
    """
    spark, tag = nodes.sparkSession, F.col("tag")
    role = F.lower(F.coalesce(F.col("attrs")["role"], F.lit(""))).isin("navigation", "complementary")
    at_once = tag.isin(*REMOVE_TAGS) | hidden() | (tag.isin(*CONTAINERS) & (role | module_signal(config)))
    now = saved(without(nodes, nodes.where(at_once)), path := folder(spark, "nodes"))
    while not (found := _modules(now)).isEmpty():
        then = saved(without(now, found), after := folder(spark, "nodes"))
        forget(spark, path)
        now, path = then, after
    return now
