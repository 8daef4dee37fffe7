"""Scores as column expressions; all are whole numbers from 0 to 100 unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import apostrophe_key, bind, phrase_hits, spelled


def clamp(x: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def steps(x: Column, *cuts: tuple[int, int]) -> Column:
    """Points of the first cut that x reaches, largest first."""
    out = F.when(x >= cuts[0][0], cuts[0][1])
    for at, points in cuts[1:]:
        out = out.when(x >= at, points)
    return out.otherwise(0)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def extraction_quality(words: Column, text_blocks: Column, rich_blocks: Column, image: Column, image_blocks: Column, author: Column, published: Column, method: Column, removed: Column, truncated: Column, error: Column) -> Column:
    """How complete an extraction looks: additive points for length, structure, method and metadata, less penalties."""
    points = (
        F.lit(12)
        + steps(words, (700, 35), (400, 30), (250, 25), (150, 18), (80, 9))
        + steps(text_blocks, (10, 16), (6, 13), (3, 9), (2, 5))
        + F.least(F.lit(6), 2 * rich_blocks)
        + F.when(image, 6).otherwise(0)
        + F.least(F.lit(5), 2 * image_blocks)
        + F.when(author, 5).otherwise(0)
        + F.when(published, 3).otherwise(0)
        + _method_points(method)
        - F.when((removed > 0.55) & (words < 180), 12).when((removed > 0.35) & (words < 120), 7).otherwise(0)
        - F.when(truncated, 8).otherwise(0)
        - F.when(error, 30).otherwise(0)
    )
    return clamp(points).cast("int")


def _method_points(method: Column) -> Column:
    """Points for how a body was found: a publisher's own root, a generic root, structured data, a fallback."""
    dom = F.startswith(method, F.lit("dom:")) & ~F.contains(method, F.lit(":none"))
    structured = F.startswith(method, F.lit("jsonld:")) | F.startswith(method, F.lit("embedded-json:"))
    return F.when(dom & F.contains(method, F.lit(":generic:")), 6).when(dom | structured, 9).when(F.startswith(method, F.lit("trafilatura")), 4).otherwise(0)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 65, "good").when(score >= 45, "partial").otherwise("poor")


def content_status(score: Column, words: Column, paragraphs: Column, trusted: Column | None = None) -> Column:
    full = (score >= 55) & ((words >= 120) | (paragraphs >= 3))
    if trusted is not None:
        full = full | (trusted & (score >= 45) & (words >= 90) & (paragraphs >= 2))
    return F.when(full, "full").when(words >= 55, "partial").otherwise("summary")


def local_relevance(text: Column, prior: Column, config) -> tuple[Column, Column]:
    """(score, up to six reasons): a prior of the source, term groups that a text names, negative groups.

    Reasons go by the size of their weight; equals keep the order of the rules: prior, groups, bare mention, negative groups.
    """
    from ..config import CORE_LABELS

    def of(k):
        hit = lambda terms: F.size(phrase_hits(k, [spelled(t) for t in terms])) > 0
        named = F.array(*[F.when(hit(terms), label) for _, label, terms in config.local_terms])
        core = F.arrays_overlap(F.filter(named, lambda v: v.isNotNull()), F.array(*[F.lit(v) for v in CORE_LABELS]))
        bare = F.contains(F.concat(F.lit(" "), k, F.lit(" ")), F.lit(" london ")) & ~core
        rule = lambda when, weight, reason: F.when(when, F.struct(weight.cast("int").alias("w"), reason.alias("reason")))
        rules = [rule(prior != 0, prior, F.concat(F.lit("local publisher +"), prior.cast("string")))]
        rules += [rule(hit(terms), F.lit(w), F.lit(f"{label} +{w}")) for w, label, terms in config.local_terms]
        rules += [rule(bare, F.lit(12), F.lit("London mention +12"))]
        rules += [rule(hit(terms), F.lit(w), F.lit(f"{label} {w}")) for w, label, terms in config.negative_terms]
        return F.array(*rules)

    found = bind(apostrophe_key(text), of)
    groups = len(config.local_terms) + 1
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda t, r: t + F.coalesce(r["w"], F.lit(0)))

    def judged(rules):
        plus, minus = total(F.slice(rules, 2, groups)), total(F.slice(rules, groups + 2, len(config.negative_terms)))
        score = clamp(F.greatest(prior, F.least(F.lit(100), prior + plus)) + minus).cast("int")
        placed = F.transform(rules, lambda r, i: F.struct((-F.abs(r["w"])).alias("size"), i.alias("i"), r["reason"].alias("reason")))
        order = F.array_sort(F.filter(placed, lambda r: r["size"].isNotNull()))
        return F.struct(score.alias("score"), F.transform(F.slice(order, 1, 6), lambda r: r["reason"]).alias("reasons"))

    both = bind(found, judged)
    return both["score"], both["reasons"]


def prior_of(source: Column, priors: dict[str, int]) -> Column:
    """The score that a source's rows start from."""
    known = F.create_map(*[F.lit(v) for kv in priors.items() for v in kv]) if priors else None
    return F.coalesce(F.try_element_at(known, source), F.lit(0)) if priors else F.lit(0)


def image_score(image: Column, focus: Column, alt: Column) -> Column:
    return F.when(image, 72 + F.when(focus, 14).otherwise(0) + F.when(alt, 8).otherwise(0)).otherwise(0)


def coverage(sources: Column, table: tuple) -> Column:
    return F.when(sources <= 0, 0).otherwise(F.get(F.array(*[F.lit(x) for x in table]), F.least(sources, F.lit(len(table))).cast("int") - 1))


def rank(local: Column, fresh: Column, covered: Column, quality: Column, image: Column) -> Column:
    return clamp(F.bround(0.25 * local + 0.35 * fresh + 0.25 * covered + 0.10 * quality + 0.05 * image, 0)).cast("int")


def representative(quality: Column, local: Column, image: Column, direct: Column, status: Column) -> Column:
    """Which member should stand for a cluster; a number, not clamped."""
    return 0.42 * quality + 0.28 * local + 0.16 * image + F.when(direct, 8).otherwise(0) + F.when(status == "full", 6).when(status == "partial", 2).otherwise(0)


def article_score(status: Column, words: Column, quality: Column, media: Column, structure: Column, schema: Column) -> Column:
    """Which of two versions of a body is better; a large number."""
    level = F.when(status == "full", 3).when(status == "partial", 2).when(status == "summary", 1).otherwise(0)
    return 10000 * level + F.least(words, F.lit(5000)) + 8 * F.least(quality, F.lit(100)) + 180 * media + 70 * structure + 250 * schema


def read_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(words / 220, 0)).cast("int")
