"""Ordered transforms of content blocks: arrays of structs, by higher-order functions, so a row never leaves its task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind, blank, collapse, key, split_count, unicode_word_count

TEXTUAL = ("paragraph", "heading", "quote")


def text_blocks(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"].isin(*TEXTUAL))


def paragraphs(blocks: Column) -> Column:
    """Texts of paragraphs, headings, quotes and list items, in order."""
    each = F.transform(blocks, lambda b: F.when(b["type"].isin(*TEXTUAL), F.array(blank(b["text"]))).when(b["type"] == "list", F.coalesce(b["items"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    return F.filter(F.flatten(each), lambda t: t != "")


def body(blocks: Column, limit: int | None = None) -> Column:
    out = F.array_join(paragraphs(blocks), "\n\n")
    return F.substring(out, 1, limit) if limit else out


def stats(blocks: Column) -> Column:
    """Words, text blocks, rich blocks, images."""
    count = lambda *kinds: F.size(F.filter(blocks, lambda b: b["type"].isin(*kinds)))
    return F.struct(
        F.aggregate(F.transform(paragraphs(blocks), split_count), F.lit(0), lambda a, n: a + n).alias("words"),
        count("paragraph").alias("paragraphs"),
        count("heading", "quote", "list").alias("rich"),
        count("image").alias("images"),
        F.aggregate(F.filter(blocks, lambda b: b["type"] == "list"), F.lit(0), lambda a, b: a + F.size(b["items"])).alias("items"),
    )


def unique(blocks: Column) -> Column:
    """Blocks whose text or address hasn't come before."""
    name = lambda b: F.concat_ws("|", b["type"], key(b["text"]), blank(b["url"]), F.array_join(F.coalesce(b["items"], F.array().cast("array<string>")), "|"))
    names = F.transform(blocks, name)
    return F.filter(blocks, lambda b, i: F.array_position(names, name(b)) == i + 1)


def sanitize(blocks: Column, starts: str, least_prose: int = 12, most_skipped: int = 16) -> Column:
    """Leave out modules: a block that reads as a module's start, and what follows until prose comes back or enough is skipped."""
    kind = "array<struct<type:string,text:string,level:int,ordered:boolean,items:array<string>,url:string,alt:string>>"
    start = F.struct(F.lit(0).alias("skipping"), F.array().cast(kind).alias("kept"))

    def step(s, b):
        module = F.coalesce(F.lower(collapse(b["text"])).rlike(starts), F.lit(False))
        prose = (b["type"] == "paragraph") & (split_count(b["text"]) >= least_prose)
        keep = F.struct(F.lit(0).alias("skipping"), F.concat(s["kept"], F.array(b)).alias("kept"))
        skip = F.struct((s["skipping"] + 1).alias("skipping"), s["kept"].alias("kept"))
        return F.when(module, F.struct(F.lit(1).alias("skipping"), s["kept"].alias("kept"))).when((s["skipping"] > 0) & ~prose & (s["skipping"] <= most_skipped), skip).otherwise(keep)

    return F.aggregate(blocks.cast(kind), start, step)["kept"]


def repair_fragments(texts: Column) -> Column:
    """A paragraph that goes on in lower case joins the one before, if that has no end mark."""

    def step(acc, p):
        last = F.element_at(acc, -1)
        goes_on = (p != "") & (last != "") & p.rlike(r"^\p{Ll}") & ~last.rlike("[.!?;:”\"']$")
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), p)))
        return F.when(F.size(acc) == 0, F.array(p)).when(F.coalesce(goes_on, F.lit(False)), joined).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(F.transform(texts, collapse), F.array().cast("array<string>"), step)


def interleave(texts: Column, images: Column, every: int = 3) -> Column:
    """Texts as paragraphs with an image after each `every` of them; the images left go to the end."""
    groups = F.transform(texts, lambda t, i: F.concat(F.array(F.struct(F.lit("paragraph").alias("type"), t.alias("value"))), F.when(((i + 1) % every == 0) & ((i + 1) / every <= F.size(images)), F.array(F.struct(F.lit("image").alias("type"), F.get(images, ((i + 1) / every - 1).cast("int")).alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))))
    used = F.least(F.floor(F.size(texts) / every).cast("int"), F.size(images))
    rest = F.transform(F.when(F.size(images) > used, F.slice(images, used + 1, F.size(images))).otherwise(F.array().cast("array<string>")), lambda u: F.struct(F.lit("image").alias("type"), u.alias("value")))
    return F.concat(F.flatten(groups), rest)


def split_wall(text: Column, least: int = 95, tail: int = 30, sentences: int = 4) -> Column:
    """A long paragraph as several: sentences packed to some words; a short last piece goes back to the one before.

    A text of fewer sentences stays whole. Sentences begin with a capital, a digit or a quotation mark.
    """

    def packed(parts):
        # each sentence's piece: a new one begins once the words since the last beginning reach `least`
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("piece"), F.array().cast("array<int>").alias("at"))

        def step(s, p):
            words = s["words"] + unicode_word_count(p)
            full = words >= least
            return F.struct(F.when(full, 0).otherwise(words).alias("words"), (s["piece"] + F.when(full, 1).otherwise(0)).alias("piece"), F.concat(s["at"], F.array(s["piece"])).alias("at"))

        def joined(at):
            last = F.array_max(at)
            whole = lambda k: F.array_join(F.filter(parts, lambda p, i: F.get(at, i) == k), " ")
            short = (last > 0) & (unicode_word_count(whole(last)) < tail)
            return F.transform(F.sequence(F.lit(0), F.when(short, last - 1).otherwise(last)), lambda k: F.when(short & (k == last - 1), F.concat_ws(" ", whole(k), whole(last))).otherwise(whole(k)))

        return F.when(F.size(parts) < sentences, F.array(collapse(text))).otherwise(bind(F.aggregate(parts, start, step)["at"], joined))

    return bind(F.filter(F.split(collapse(text), r"(?<=[.!?])\s+(?=[A-Z0-9‘'\"“])"), lambda s: s != ""), packed)


def insert_after(blocks: Column, anchors: Column) -> Column:
    """Anchored blocks behind the block whose place they name; places are those of the input, so inserts don't shift each other."""
    return F.flatten(F.transform(blocks, lambda b, i: F.concat(F.array(b), F.transform(F.filter(anchors, lambda a: a["at"] == i), lambda a: a["block"]))))
