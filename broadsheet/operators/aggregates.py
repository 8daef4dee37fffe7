"""Grouped summaries: editions, sources, clusters, repeated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def edition_counters(df: DataFrame) -> DataFrame:
    """One row: stories, full and partial ones, mean quality, sources."""
    return df.agg(
        F.count("*").alias("story_count"),
        F.count_if(F.col("content_status") == "full").alias("full_story_count"),
        F.count_if(F.col("content_status") == "partial").alias("partial_story_count"),
        F.round(F.avg("quality"), 6).alias("mean_quality"),
        F.count_distinct("source").alias("source_count"),
    )


def source_health(df: DataFrame, order: list[Column], sample: int = 30, runs: DataFrame | None = None) -> DataFrame:
    """Each source's newest rows: counts, ratios, status. df has source, content_status, quality, error, published, and may have grade.

    runs(source, found, run_error) has the last run of each source, those without rows among them: they are waiting, or in
    error; an error beside rows degrades a source.
    """
    newest = df.withColumn("__r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("__r") <= sample)
    failed = (F.col("content_status") == "failed") | F.coalesce(F.col("error"), F.lit(False))
    status_is = lambda s: F.count_if(F.col("content_status") == s)
    counts = {"full_": status_is("full"), "partial": status_is("partial"), "summary": status_is("summary"), "failed": F.count_if(failed), **{g: F.count_if(F.col("grade") == g) for g in ("excellent", "good", "poor") if "grade" in df.columns}}
    out = newest.groupBy("source").agg(F.count("*").alias("tracked"), *[c.alias(n) for n, c in counts.items()], F.round(F.avg("quality"), 6).alias("mean_quality"), F.max("published").alias("latest"))
    out = out.join(runs, "source", "full") if runs is not None else out.withColumns({"found": F.lit(0), "run_error": F.lit("")})
    out = out.withColumns({"found": F.coalesce("found", F.lit(0)), "last_error": F.coalesce("run_error", F.lit(""))}).drop("run_error")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tracked", *counts)})
    rows, error = F.greatest(F.lit(1), F.col("tracked")), F.col("last_error") != ""
    usable, failure = (F.col("full_") + F.col("partial")) / rows, F.col("failed") / rows
    none = F.col("tracked") == 0
    status = F.when(error & none, "error").when(error, "degraded").when(none, "waiting").when((usable >= 0.70) & (failure <= 0.10), "healthy").otherwise("degraded")
    return out.withColumns({"usable_ratio": F.round(usable, 6), "failure_ratio": F.round(failure, 6), "status": status})


def cluster_summary(df: DataFrame) -> DataFrame:
    """Clusters of df(cluster, id, source, published, local, rep_score): representative, dates, sources, members newest first."""
    members = F.array_sort(F.collect_list(F.struct((-F.unix_micros("published")).alias("k"), "id", "source")))
    out = df.groupBy("cluster").agg(
        F.max_by("id", F.struct("rep_score", -F.col("id"))).alias("representative_id"),
        F.min_by("id", F.struct("published", "id")).alias("oldest_id"),
        F.min("published").alias("first_published"),
        F.max("published").alias("latest_published"),
        F.max("local").alias("cluster_local"),
        F.count("*").alias("member_count"),
        members.alias("__m"),
    )
    sources = F.array_distinct(F.filter("__m.source", lambda s: F.coalesce(s, F.lit("")) != ""))
    return out.select(
        F.concat(F.lit("cluster-"), F.substring(F.sha1(F.col("oldest_id").cast("string")), 1, 12)).alias("cluster_id"),
        "representative_id", "first_published", "latest_published", "cluster_local", "member_count",
        F.col("__m.id").alias("member_ids"), sources.alias("sources"), F.size(sources).alias("source_count"),
    )


def source_directory(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.max("published").alias("latest"), F.count("*").alias("stories")).orderBy(F.desc("latest"), "source")


def category_order(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Distinct categories: preferred ones in their order, then the others by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("category")), F.lit(0)), F.lit(999))
    return df.select("category").distinct().withColumn("rank", rank.cast("int")).orderBy("rank", "category")


def pipeline_stats(df: DataFrame, now: Column, ts: str = "published") -> DataFrame:
    hour = F.col(ts) > now - F.make_dt_interval(F.lit(0), F.lit(1))
    return df.agg(F.count("*").alias("total"), F.count_if(hour & (F.col(ts) <= now)).alias("last_hour"), F.count_distinct("source").alias("sources"))


def scope_counts(df: DataFrame) -> DataFrame:
    """Rows by scope with the total, from one pass."""
    return df.rollup("scope").agg(F.count("*").alias("stories")).select(F.coalesce("scope", F.lit("all")).alias("scope"), "stories")


def repeated_values(df: DataFrame, group: str, value: str, order: list[Column], sample: int = 30, least: int = 3, share: float = 0.34) -> DataFrame:
    """Of each group's first rows the most common value, where it is common enough to be furniture rather than content."""
    first = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= sample)
    sized = first.groupBy(group, value).agg(F.count("*").alias("n"))
    mode = sized.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(group).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), F.col(value))).alias("m"))
    rows = first.groupBy(group).agg(F.count("*").alias("rows"))
    return mode.join(rows, group).select(group, F.col(f"m.{value}").alias(value), F.col("m.n").alias("n"), "rows").where((F.col("n") >= least) & (F.col("n") / F.col("rows") >= share))


def clear_repeated(df: DataFrame, found: DataFrame, group: str, value: str) -> DataFrame:
    """df with the values that repeated_values found taken out of their groups' rows."""
    marks = found.select(group, F.col(value).alias("__repeated"))
    return df.join(marks, group, "left").withColumn(value, F.when(F.col("__repeated").isNull() | (F.col(value) != F.col("__repeated")), F.col(value))).drop("__repeated")


def duplicate_paragraphs(df: DataFrame, key: list[str], paragraphs: Column, normal, least: int = 45) -> DataFrame:
    """Paragraphs that a row has more than once, by their normal form."""
    rows = df.select(*key, F.explode(paragraphs).alias("p")).withColumn("paragraph", normal(F.col("p"))).where(F.length("paragraph") >= least)
    return rows.groupBy(*key, "paragraph").agg(F.count("*").alias("n")).where("n > 1")


def complete_sources(df: DataFrame, least_words: int = 80) -> DataFrame:
    """Sources with a complete report in each cluster."""
    good = F.col("content_status").isin("full", "partial") & (F.col("words") >= least_words)
    return df.where(good).groupBy("cluster_id").agg(F.array_sort(F.collect_set("source")).alias("complete_sources"))
