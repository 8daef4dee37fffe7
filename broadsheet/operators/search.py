"""Full-text search: conjunctive substrings, an inverted index, prefixes, bounded typos, a score of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import read_minutes
from ..functions.text import blank, collapse
from .filters import all_terms

#: Weights of the fields (fixed values).
BOOSTS = {"title": 5.0, "summary": 2.5, "source": 2.0, "category": 2.0, "body": 1.0}


def search_all(df: DataFrame, query: str, fields: list[str], limit: int = 80, newest: str = "published") -> DataFrame:
    """Rows that hold every word of the query as a substring of some field, newest first."""
    hay = F.concat_ws(" ", *[blank(f) for f in fields])
    return df.where(all_terms(hay, query)).orderBy(F.desc(newest), "id").limit(limit)


def index(df: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(token, field, id, tf): one row for each token of a field of a row."""
    pieces = F.array(*[F.struct(F.lit(f).alias("field"), blank(f).alias("text")) for f in fields])
    rows = df.select(key, F.explode(pieces).alias("p")).select(key, "p.field", F.explode(F.regexp_extract_all(F.lower("p.text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("token"))
    return rows.groupBy("token", "field", key).agg(F.count("*").alias("tf"))


def ranked(inverted: DataFrame, query: str, boosts: dict[str, float] | None = None, prefix: bool = True, fuzzy: float = 0.0, key: str = "id") -> DataFrame:
    """Rows that match every word (whole, as a prefix, or within edits of fuzzy * length), scored by field weight and match.

    A word's score in a row is the sum over matching tokens of weight * tf * (1, or 0.5 where the match isn't whole).
    """
    boosts = boosts or BOOSTS
    terms = list(dict.fromkeys(query.lower().split()))
    weight = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    pieces = []
    for term in terms:
        whole = F.col("token") == term
        hit = whole
        if prefix:
            hit = hit | F.startswith("token", F.lit(term))
        if fuzzy and int(fuzzy * len(term)):
            hit = hit | (F.levenshtein("token", F.lit(term), int(fuzzy * len(term))) >= 0)
        pieces.append(inverted.where(hit).groupBy(key).agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("field")), F.lit(1.0)) * F.col("tf") * F.when(whole, 1.0).otherwise(0.5)).alias("part")).withColumn("term", F.lit(term)))
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("part").alias("score"), F.count("*").alias("terms")).where(F.col("terms") == len(terms)).drop("terms")


def _body(limit: int = 1800) -> Column:
    return F.substring(collapse(F.array_join(F.transform(F.slice("paragraphs", 1, 16), collapse), " ")), 1, limit)


def _minutes() -> Column:
    return F.when(F.coalesce(F.col("words"), F.lit(0)) > 0, read_minutes(F.col("words")))


def _shared() -> list[Column]:
    """What both projections hold; df has id, title, summary, source, category, published and words."""
    return [F.col("id").cast("string").alias("id"), collapse("title").alias("title"), collapse("summary").alias("summary"), F.col("source"), F.coalesce(F.nullif(collapse("category"), F.lit("")), F.lit("Local")).alias("category"), F.col("published")]


def documents(df: DataFrame) -> DataFrame:
    """The search index's documents: rows with a title, their scope, topics, the beginning of the body, minutes to read."""
    topics = F.filter(F.transform(F.coalesce("topics", F.array().cast("array<string>")), collapse), lambda t: t != "")
    return df.where(collapse("title") != "").select(*_shared(), F.when(F.lower(collapse("scope")) == "canada", "canada").otherwise("local").alias("scope"), topics.alias("topics"), _body().alias("body"), collapse("image").alias("image"), _minutes().alias("read_minutes"))


def cards(df: DataFrame) -> DataFrame:
    """The story cards' projection: no body."""
    return df.where(collapse("title") != "").select(*_shared(), collapse("image").alias("image"), collapse("image_alt").alias("image_alt"), _minutes().alias("read_minutes"))


def search(df: DataFrame, query: str, fields: list[str], scope: str | None = None, category: str | None = None, source: str | None = None, since: Column | None = None, limit: int = 80, ts: str = "published", tie: str = "id") -> DataFrame:
    """Rows with all words of a query, within a scope, category, source and time, newest first."""
    out = df
    for name, value in (("scope", scope), ("category", category), ("source", source)):
        if value:
            out = out.where(F.lower(F.col(name)) == value.lower())
    if since is not None:
        out = out.where(F.col(ts) >= since)
    return out.where(all_terms(F.concat_ws(" ", *fields), query)).orderBy(F.desc(ts), tie).limit(limit)
