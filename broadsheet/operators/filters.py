"""Row filters and predicates. Each keeps to expressions, so that Catalyst can push what it can to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, key
from ..functions.urls import host, path


def retained(df: DataFrame, now: Column, days: int = 7, ts: str = "published") -> DataFrame:
    """Rows newer than the horizon; the boundary itself and rows without a date are dropped."""
    return df.where(F.col(ts) > now - F.make_dt_interval(F.lit(days)))


def gate(df: DataFrame, thresholds: dict[str, int], junk: str = "", retired: tuple[str, ...] = (), score: str = "local_score") -> DataFrame:
    """df with drop_reason: null for what passes. Split it by that column; both sides come from one scan."""
    reason = F.when(F.lit(bool(junk)) & F.lower(F.trim(blank("title"))).rlike(junk or "$^"), "junk title").when(F.col("source").isin(*retired) if retired else F.lit(False), "retired source")
    if thresholds:
        least = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
        need = F.try_element_at(least, F.col("source"))
        reason = reason.when(need.isNotNull() & (F.coalesce(F.col(score), F.lit(0)) < need), "local score")
    return df.withColumn("drop_reason", reason)


def discovered_locally(df: DataFrame, least: int = 25) -> DataFrame:
    """Rows that were found by discovery need a local score."""
    return df.where(F.col("discovery_via").isNull() | (F.col("discovery_via") == "") | (F.coalesce(F.col("local_score"), F.lit(0)) >= least))


def unusable_shell(title: Column, url: Column, generic: tuple[str, ...], aggregators: tuple[str, ...]) -> Column:
    """A generic title, or an address that still is an aggregator's."""
    return key(title).isin(*generic) | host(url).isin(*aggregators)


def roundup(df: DataFrame, patterns: dict[str, str]) -> Column:
    """Whether a title is one of its source's redundant round-ups."""
    out = F.lit(False)
    for source, pattern in patterns.items():
        out = out | ((F.col("source") == source) & F.lower(blank("title")).rlike(pattern))
    return out


def section(url: Column, sections: dict[str, str], other: str = "") -> Column:
    """The section that an address's path names."""
    out = None
    for part, name in sections.items():
        hit = F.contains(F.lower(path(url)), F.lit(part))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other) if out is not None else F.lit(other)


def article_path(url: Column, deny: str = r"/(?:category|tag|author|video|photos?|newsletters?|subscribe)(?:/|$)") -> Column:
    """Two path segments or a long slug, and none of the index pages."""
    p = path(url)
    return ((F.regexp_count(p, F.lit("/")) >= 2) | p.rlike("-.*-")) & ~F.lower(p).rlike(deny)


def scope(source: Column, local: tuple[str, ...]) -> Column:
    return F.when(source.isin(*local), "local").otherwise("canada")


def scope_category(scope_: Column, category: Column) -> Column:
    """Categories that contradict the scope are put right."""
    return F.when((scope_ == "local") & (category == "Canada"), "Local").when((scope_ == "canada") & F.coalesce(category, F.lit("")).isin("", "Local"), "Canada").otherwise(category)


def stale(schema: Column, wanted: int, has_body: Column, scraped: Column, now: Column, hours: int = 12) -> Column:
    """Whether a cached body must be made again."""
    return (F.coalesce(schema, F.lit(-1)) != wanted) | ~F.coalesce(has_body, F.lit(False)) | scraped.isNull() | (scraped <= now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def needs_work(schema: Column, wanted: int, attempted: Column, now: Column, retry_hours: int) -> Column:
    """Rows of an older pass whose last attempt is long enough ago."""
    return (F.coalesce(schema, F.lit(0)) < wanted) & (attempted.isNull() | (attempted <= now - F.make_dt_interval(F.lit(0), F.lit(retry_hours))))


def home_feed(df: DataFrame, hidden: tuple[str, ...] = (), scope_: str | None = None, category: str | None = None) -> DataFrame:
    """Representatives, unless all sources of their cluster are hidden."""
    out = df.where("cluster_representative")
    if hidden:
        gone = F.array(*[F.lit(h.lower()) for h in hidden])
        out = out.where(~F.forall("cluster_sources", lambda s: F.array_contains(gone, F.lower(s))))
    if scope_:
        out = out.where(F.col("scope") == scope_)
    if category:
        out = out.where(F.col("category") == category)
    return out


def unread(df: DataFrame, read: DataFrame, key_: str = "id") -> DataFrame:
    return df.join(read.select(key_), key_, "left_anti")


def all_terms(text: Column, query: str) -> Column:
    """Every word of a query stands somewhere in the lower-cased text."""
    out = F.lit(True)
    for term in query.lower().split():
        out = out & F.contains(F.lower(blank(text)), F.lit(term))
    return out


def usable_body(blocks: Column, status: Column, quality: Column) -> Column:
    return (F.coalesce(F.size(blocks), F.lit(0)) > 0) & ~status.isin("failed", "summary") & (F.coalesce(quality, F.lit(0)) >= 45)


def hero_eligible(health: Column, status: Column, quality: Column, local: Column, image: Column) -> Column:
    return (health == "healthy") & status.isin("full", "partial") & (quality >= 55) & (local >= 25) & (F.coalesce(image, F.lit("")) != "")


def valid_derivative(optimised: Column, recorded_source: Column, source: Column) -> Column:
    """An optimised image only while it was made of what is the source now."""
    return F.when(recorded_source == source, optimised)
