"""Pages as ordered content blocks, by the standard library's HTML parser in Arrow batches; rows stay rows until exploded."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, truncate

BLOCK = "struct<type:string,text:string,level:int,ordered:boolean,items:array<string>,url:string,alt:string>"
#: Elements whose content is no prose (fixed values).
SKIP = {"script", "style", "noscript", "nav", "footer", "form", "button", "iframe", "aside"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TEXT = {"p": "paragraph", "blockquote": "quote", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.skipped: list[str] = []
        self.open: dict | None = None
        self.lists: list[dict] = []
        self.item: list[str] | None = None

    def _close(self) -> None:
        if self.open:
            text = " ".join("".join(self.open.pop("parts")).split())
            if text:
                self.out.append(self.open | {"text": text})
        self.open = None

    def _end_item(self) -> None:
        if self.item is not None and self.lists:
            text = " ".join("".join(self.item).split())
            if text:
                self.lists[-1]["items"].append(text)
        self.item = None

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.append(tag)
            return
        if tag in SKIP:
            self._close()
            self.skipped.append(tag)
            return
        got = dict(attrs)
        if tag in _TEXT:
            self._close()
            self.open = {"type": _TEXT[tag], "level": int(tag[1]) if tag[0] == "h" else None, "parts": []}
        elif tag in ("ul", "ol"):
            self._close()
            self._end_item()
            self.lists.append({"type": "list", "ordered": tag == "ol", "items": []})
        elif tag == "li":
            self._end_item()
            self.item = []
        elif tag == "img" and got.get("src"):
            self._close()
            self.out.append({"type": "image", "url": got["src"], "alt": got.get("alt") or ""})
        elif tag == "br":
            self.handle_data(" ")
        elif tag not in _VOID and tag in ("div", "section", "article", "main", "table"):
            self._close()

    def handle_endtag(self, tag):
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
            return
        if tag in _TEXT:
            self._close()
        elif tag == "li":
            self._end_item()
        elif tag in ("ul", "ol") and self.lists:
            self._end_item()
            done = self.lists.pop()
            if done["items"]:
                self.out.append(done)

    def handle_data(self, data):
        if self.skipped:
            return
        if self.item is not None:
            self.item.append(data)
        elif self.open:
            self.open["parts"].append(data)


def blocks_of(html: str | None) -> list[dict]:
    """Paragraphs, headings, quotes, lists and images of a page in order; navigation, scripts and the like are left out."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p._close()
    p._end_item()
    for rest in p.lists:
        if rest["items"]:
            p.out.append(rest)
    keys = ("type", "text", "level", "ordered", "items", "url", "alt")
    return [{k: b.get(k) for k in keys} for b in p.out]


def with_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with content_blocks."""
    names = pages.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content_blocks=[blocks_of(h) for h in b[html]])

    return pages.mapInPandas(run, f"{kinds}, content_blocks array<{BLOCK}>").select(*names, "content_blocks")


def social_shell(title: Column | str, summary: Column | str, url: Column | str, image: Column | str) -> Column:
    """A page's head with what previews read: an expression, so a shell for each story is one projection."""

    def safe(x):
        out = F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    t, s = safe(title), safe(truncate(collapse(summary), 200))
    picture = F.when(safe(image) != "", F.concat(F.lit('<meta property="og:image" content="'), safe(image), F.lit('">'))).otherwise("")
    return F.concat(F.lit("<title>"), t, F.lit('</title><meta property="og:title" content="'), t, F.lit('"><meta property="og:description" content="'), s, F.lit('"><meta property="og:url" content="'), safe(url), F.lit('">'), picture)
