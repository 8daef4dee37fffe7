"""Feeds and pages as columns: RSS and Atom entries, links of landing pages, fallback chains.

Fetching is not this engine's part: documents come as rows, with the text that a fetch returned.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bind, clean, collapse
from ..functions.urls import canonical, host, path, resolve

ENTRY = "source string, position int, title string, url string, summary string, published string"


def _entries(xml: str) -> Iterator[tuple]:
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, TypeError, ValueError):
        return
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    for n, item in enumerate(e for e in root.iter() if name(e) in ("item", "entry")):
        got: dict[str, str] = {}
        for child in item:
            k = name(child)
            value = child.attrib.get("href") if k == "link" and child.attrib.get("href") else "".join(child.itertext())
            got.setdefault(k, (value or "").strip())
        yield n, got.get("title", ""), got.get("link", ""), got.get("description") or got.get("summary", ""), got.get("pubDate") or got.get("published") or got.get("updated", "")


def feed_entries(feeds: DataFrame, most: int = 25) -> DataFrame:
    """feeds(source, xml) -> the first entries of each feed, cleaned; a broken feed has none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, *e) for s, x in zip(b["source"], b["xml"]) for e in _entries(x) if e[0] < most]
            yield pd.DataFrame(rows, columns=["source", "position", "title", "url", "summary", "published"])

    raw = feeds.select("source", "xml").mapInPandas(parse, ENTRY)
    return raw.withColumns({"title": clean("title"), "summary": clean("summary", 360), "url": canonical("url")})


def links(html: Column | str, base: Column | str) -> Column:
    """Addresses of a page's links, as seen from it, each once, in order of first appearance."""
    found = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'<>]+)[\"']"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: canonical(resolve(u, base))))


def page_links(pages: DataFrame, allow: str = "", most: int = 30) -> DataFrame:
    """pages(page_id, url, html) -> links to other pages of the same host whose path fits a pattern, the first of each page."""
    rows = pages.select("page_id", "url", F.posexplode(links("html", "url")).alias("position", "link"))
    rows = rows.where((host("link") == host("url")) & (F.length(path("link")) > 1))
    if allow:
        rows = rows.where(path("link").rlike(allow))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def page_title(html: Column | str) -> Column:
    return collapse(clean(F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def first_route(candidates: DataFrame, key: list[str], priority: str = "route") -> DataFrame:
    """Rows of each key's best route that has rows: primary feed, then alternates, then landing page."""
    best = F.min(priority).over(Window.partitionBy(*key))
    return candidates.withColumn("__best", best).where(F.col(priority) == F.col("__best")).drop("__best")


def newest_per_source(entries: DataFrame, most: int, order: Column | None = None) -> DataFrame:
    """The bounded increment: at most so many entries of each source."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(order if order is not None else F.col("position")))
    return entries.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def first_outbound(html: Column | str, base: Column | str, wanted_host: str = "") -> Column:
    """Redirect pages: the first link to another host, one of the wanted host before others; null if there is none."""
    out = F.filter(links(html, base), lambda u: (host(u) != "") & (host(u) != host(base)))
    wanted = F.filter(out, lambda u: (host(u) == wanted_host) | F.endswith(host(u), F.lit("." + wanted_host))) if wanted_host else out
    return F.coalesce(F.get(wanted, F.lit(0)), F.get(out, F.lit(0)))


def json_ld(html: Column | str, depth: int = 5) -> Column:
    """The JSON-LD objects of a page as text, level by level; members of arrays and of a @graph stand for themselves, down to `depth` levels, and a @graph without a type for its members alone. What is no JSON counts as none."""
    raw = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    none = F.array().cast("array<string>")
    graph = lambda j: F.from_json(F.get_json_object(j, "$['@graph']"), "array<string>")
    array = lambda j: F.when(F.startswith(F.trim(j), F.lit("[")), F.from_json(j, "array<string>"))
    members = lambda j: F.coalesce(array(j), graph(j))

    def levels(now: Column, left: int) -> Column:
        if not left:
            return now
        alone = F.filter(now, lambda j: members(j).isNull() | F.get_json_object(j, "$['@type']").isNotNull())
        inside = F.flatten(F.transform(now, lambda j: F.coalesce(members(j), none)))
        return F.concat(alone, bind(inside, lambda x: F.when(F.size(x) > 0, levels(x, left - 1)).otherwise(none)))

    whole = F.filter(raw, lambda j: F.get_json_object(j, "$").isNotNull())
    return F.flatten(F.transform(whole, lambda j: bind(F.array(j), lambda x: levels(x, depth))))


def json_ld_field(html: Column | str, field: str, kinds: tuple[str, ...] = ("Article", "NewsArticle", "Report", "BlogPosting")) -> Column:
    """A field of the first object of one of the kinds."""
    found = F.filter(json_ld(html), lambda j: F.get_json_object(j, "$['@type']").isin(*kinds))
    return F.get_json_object(F.get(found, F.lit(0)), f"$.{field}")
