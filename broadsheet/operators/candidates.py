"""Choosing among candidates: scores of extracted bodies, the best one, work queues, metadata after removals, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bind, blank, unicode_word_count
from ..functions.urls import host, path


def richness(blocks: Column) -> Column:
    """How many blocks of each kind a body has."""
    count = lambda kind: F.size(F.filter(blocks, lambda b: b["type"] == kind))
    return F.struct(*[count(k).alias(n) for n, k in (("paragraphs", "paragraph"), ("headings", "heading"), ("quotes", "quote"), ("lists", "list"), ("images", "image"), ("embeds", "media"))])


def block_words(blocks: Column) -> Column:
    """Words of texts and list items."""
    none = F.array().cast("array<string>")
    said = F.transform(blocks, lambda b: F.when(b["type"] == "list", F.array_join(F.coalesce(b["items"], none), " ")).when(b["type"].isin("paragraph", "heading", "quote"), blank(b["text"])).otherwise(""))
    return F.aggregate(said, F.lit(0), lambda t, x: t + unicode_word_count(x))


def candidate_score(blocks: Column) -> Column:
    """What a candidate body is worth: its words, and points for structure and media."""
    return bind(richness(blocks), lambda r: block_words(blocks) + 5 * r["paragraphs"] + 35 * r["headings"] + 25 * r["quotes"] + 28 * r["lists"] + 70 * r["images"] + 130 * r["embeds"])


def root_score(text_chars: Column, paragraphs: Column, link_chars: Column) -> Column:
    """What an element is worth as an article's root: text and paragraphs, less what is links."""
    return (text_chars + 90 * paragraphs - F.floor(link_chars * 0.35)).cast("int")


def choose_root(roots: DataFrame, key: str, least: int = 80, bonus: int = 1500) -> DataFrame:
    """roots(key, selector, priority, own, score) -> the best root of each key: a publisher's own selectors get a bonus, ties go to the earlier one."""
    good = roots.where(F.col("score") > least).withColumn("total", F.col("score") + F.when(F.col("own"), bonus).otherwise(0))
    best = F.max_by(F.struct("selector", "total"), F.struct("total", -F.col("priority"))).alias("best")
    return good.groupBy(key).agg(best).select(key, "best.selector", "best.total")


def choose_candidate(df: DataFrame, key: str, least_gain: float = 0.0, share: float = 0.72) -> DataFrame:
    """df(key, method, words, score, current) -> one row for each key: the best candidate, or the current body.

    A candidate must keep its share of the current body's words and gain on its score; ties go to the smaller method.
    """
    now = df.where("current").groupBy(key).agg(F.max("words").alias("now_words"), F.max("score").alias("now_score"), F.max("method").alias("now_method"))
    best = df.where("not current").join(now, key, "left")
    best = best.where(F.col("now_score").isNull() | ((F.col("words") >= share * F.col("now_words")) & (F.col("score") > F.col("now_score") + least_gain)))
    best = best.groupBy(key).agg(F.min_by(F.struct("method", "words", "score"), F.struct(-F.col("score"), "method")).alias("best"))
    out = now.join(best, key, "full")
    pick = lambda a, b: F.coalesce(F.col(f"best.{a}"), F.col(b)).alias(a)
    return out.select(key, pick("method", "now_method"), pick("words", "now_words"), pick("score", "now_score"), F.col("best").isNotNull().alias("replaced"))


def work_queue(df: DataFrame, now: Column, recent_hours: int, plain: Column, limit: int, tie: str = "id") -> DataFrame:
    """The rows that a pass should do first: recent ones, the newest first, plain ones before rich ones of the same age; undated last."""
    age = (F.unix_micros(now) - F.unix_micros("published")) / 3_600_000_000
    hours = F.coalesce(age, F.lit(99999.0))
    ranked = df.withColumns({"recent": F.when(hours <= recent_hours, 1).otherwise(0), "age_hours": hours, "plain": F.when(plain, 1).otherwise(0)})
    return ranked.orderBy(F.desc("recent"), "age_hours", F.desc("plain"), tie).limit(limit)


def newest_per_user(df: DataFrame, user: str, ts: str, tie: str, most: int = 1000) -> DataFrame:
    """A bounded history: each user's newest rows."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(user).orderBy(F.desc(ts), F.desc(tie)))).where(F.col("__r") <= most).drop("__r")


def clean_metadata(clusters: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """clusters(cluster_id, representative_id, member_ids, source_count) without removed ids.

    Clusters that lose all members go; a lost representative gives way to the first member that stays. Members travel as
    rows, so the removed ids are joined and never collected.
    """
    members = clusters.select("cluster_id", F.posexplode("member_ids").alias("at", key)).join(removed.select(key).distinct(), key, "left_anti")
    left = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("at", key))).alias("m"))
    left = left.select("cluster_id", F.transform("m", lambda x: x[key]).alias("left"))
    out = clusters.join(left, "cluster_id")
    head = F.when(F.array_contains("left", F.col("representative_id")), F.col("representative_id")).otherwise(F.get("left", F.lit(0)))
    return out.withColumns({"representative_id": head, "member_ids": F.col("left"), "member_count": F.size("left")}).drop("left")


def metadata_counts(clusters: DataFrame) -> DataFrame:
    """One row: clusters, and those of several sources."""
    return clusters.agg(F.count("*").alias("cluster_count"), F.count_if(F.col("source_count") > 1).alias("multi_source_cluster_count"))


def scope_of(scope: Column, health_scope: Column) -> Column:
    """A row's scope: its own, else its source's, else local."""
    return F.coalesce(F.nullif(F.trim(scope), F.lit("")), F.nullif(F.trim(health_scope), F.lit("")), F.lit("local"))


def safe_name(key: Column) -> Column:
    """A file name for a key: the key itself where it is plain, else a digest."""
    return F.concat(F.when(key.rlike(r"\A[A-Za-z0-9_-]{1,80}\z"), key).otherwise(F.sha1(key.cast("string"))), F.lit(".json"))


def largest_area(variants: Column) -> Column:
    """The area of the largest variant (struct with width and height) of an image; 0 without any."""
    return F.coalesce(F.array_max(F.transform(variants, lambda v: F.coalesce(v["width"], F.lit(0)).cast("long") * F.coalesce(v["height"], F.lit(0)))), F.lit(0).cast("long"))


def embed_identity(url: Column | str) -> Column:
    """struct(provider, id): what an embedded address shows, the same for all spellings of it; null for others."""
    u, h, p = blank(url), host(url), path(url)
    tube = F.coalesce(*[F.nullif(F.regexp_extract(x, r, 1), F.lit("")) for x, r in ((u, r"[?&]v=([A-Za-z0-9_-]{6,})"), (p, r"^/(?:embed|shorts|live|v)/([A-Za-z0-9_-]{6,})"), (F.when(h == "youtu.be", p), r"^/([A-Za-z0-9_-]{6,})"))])
    vimeo = F.nullif(F.regexp_extract(p, r"/(?:video/)?(\d{5,})", 1), F.lit(""))
    post = F.nullif(F.regexp_extract(p, r"/status(?:es)?/(\d+)", 1), F.lit(""))
    of = lambda provider, id_: F.when(id_.isNotNull(), F.struct(F.lit(provider).alias("provider"), id_.alias("id")))
    return F.when(h.rlike(r"(?:^|\.)(?:youtube\.com|youtu\.be|youtube-nocookie\.com)$"), of("youtube", tube)).when(h.rlike(r"(?:^|\.)vimeo\.com$"), of("vimeo", vimeo)).when(h.rlike(r"(?:^|\.)(?:twitter|x)\.com$"), of("post", post))


def referenced_paths(columns: list[Column], pattern: str) -> Column:
    """Every match of a pattern in any string of a row, each once: what the row refers to."""
    whole = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(whole, F.lit(pattern), F.lit(1))))
