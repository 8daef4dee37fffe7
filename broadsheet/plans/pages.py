"""Queries over the node tables of pages. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dom
from ..sources import dom as source
from ..sources.scratch import folder, saved
from ..sources.tables import table
from .queries import _COLLAPSE
from .registry import query


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return saved(source.nodes(table(spark, d, "pages")), folder(spark, "pagenodes"))


_PLAIN = "replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_BARE = r"regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g')"
_PIECE = _COLLAPSE.format(_PLAIN.format("x"))


@query(rf"""WITH b AS (SELECT page_id, {_BARE} AS h FROM pages), t AS (SELECT page_id, h, list_filter(list_transform(regexp_extract_all(h, '>([^<]+)', 1), lambda x: {_PIECE}), lambda x: x <> '') AS x,
  list_transform(regexp_extract_all(h, '(?is)<a\b[^>]*>([^<]*)</a>', 1), lambda x: {_PIECE}) AS l FROM b)
SELECT page_id AS page, CAST(len(regexp_extract_all(h, '(?i)<a\b')) AS BIGINT) AS links, CAST(coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS link_chars, CAST(len(regexp_extract_all(h, '(?i)<p\b')) AS BIGINT) AS paragraphs,
  CAST(greatest(0, coalesce(list_sum(list_transform(x, lambda x: length(x) + 1)), 0) - 1) AS BIGINT) AS chars FROM t""")
def dom_totals(spark: SparkSession, d: str) -> DataFrame:
    """B1: pages as nodes, and what whole trees hold: sums over the subtree of each page's <html>."""
    n = dom.with_chars(_nodes(spark, d))
    tag = F.col("tag")
    n = dom.subtree_sums(n, links=(tag == "a").cast("int"), link_chars=F.when(tag == "a", F.col("chars")), paragraphs=(tag == "p").cast("int"))
    return n.where("tag = 'html'").select("page", "links", "link_chars", "paragraphs", "chars")


@query()
def dom_roots(spark: SparkSession, d: str) -> DataFrame:
    """The root of each page's article, by its text, paragraphs and links."""
    return dom.choose_root(_nodes(spark, d)).select("page", "pre", "last", "selector", "score")


@query()
def dom_pruned(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each page without navigation, hidden elements and modules."""
    left = dom.with_chars(dom.prune(_nodes(spark, d)))
    return left.where("tag = 'html'").select("page", "chars").join(left.groupBy("page").agg(F.count("*").alias("nodes")), "page")
