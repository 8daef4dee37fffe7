"""Data-quality audit: rules as one array of issues per row, scores, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import bind, collapse, key
from ..functions.urls import is_http
from .windows import run_in_array, tail

ISSUE = "array<struct<severity:string,code:string,message:string>>"


def _issue(severity: str, code: str, when: Column, message: str | None = None) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message or code.replace("_", " ")).alias("message")))


def issues(df: DataFrame, now: Column, config: Config = DEFAULT) -> DataFrame:
    """df with issues: an array in order of the rules, without repeats.

    Columns read where present: title, url, published, error, content_status, words, content, quality, source, author, image,
    local_score, paragraphs, content_blocks. A column that isn't there raises none of its issues.
    """
    has = set(df.columns)
    c = F.col
    found: list[Column] = []  # arrays of issues, null where a rule raises none

    def rule(severity: str, code: str, needs: tuple[str, ...], when) -> None:
        if has.issuperset(needs):
            found.append(F.array(_issue(severity, code, when())))

    publisher = c("source").isin(*config.publishers) if config.publishers else F.lit(False)
    rule("critical", "missing_title", ("title",), lambda: collapse("title") == "")
    rule("critical", "invalid_url", ("url",), lambda: ~is_http("url"))
    rule("warning", "missing_date", ("published",), lambda: c("published").isNull())
    rule("warning", "future_date", ("published",), lambda: c("published") > now + F.make_dt_interval(F.lit(0), F.lit(6)))
    rule("critical", "scrape_error", ("error",), lambda: F.coalesce(c("error").cast("string"), F.lit("")).isin("", "false") == F.lit(False))
    rule("critical", "failed_body", ("content_status",), lambda: c("content_status") == "failed")
    rule("critical", "status_mismatch", ("content_status", "words"), lambda: (c("content_status") == "full") & (c("words") < 80))
    rule("warning", "short_body", ("content_status", "words", "source"), lambda: publisher & c("content_status").isin("summary", "unknown") & (c("words") < 55))
    rule("warning", "short_partial_body", ("content_status", "words", "source"), lambda: publisher & (c("content_status") == "partial") & (c("words") < 95))
    rule("warning", "oversized_body", ("words",), lambda: c("words") > 4500)
    rule("warning", "truncated_ending", ("content", "words"), lambda: collapse("content").rlike(r"(?:\.\.\.|…)$") & (c("words") >= 50))
    rule("warning", "low_quality", ("quality",), lambda: (c("quality") > 0) & (c("quality") < 25))
    rule("info", "missing_quality", ("quality", "words"), lambda: (F.coalesce(c("quality"), F.lit(0)) == 0) & (c("words") > 0))
    if "content_blocks" in has:
        heads = F.concat(F.transform(F.filter("content_blocks", lambda b: b["type"] == "heading"), lambda b: collapse(b["text"])), F.flatten(F.transform(F.filter("content_blocks", lambda b: b["type"] == "list"), lambda b: F.coalesce(b["items"], F.array().cast("array<string>")))))
        heads = F.transform(heads, lambda x: F.lower(F.coalesce(x, F.lit(""))))
        found.append(bind(heads, lambda hs: F.array(*[_issue("warning", code, F.exists(hs, _like(pattern))) for code, pattern in config.module_headings])))
        images = F.filter("content_blocks", lambda b: b["type"] == "image")
        rule("warning", "too_many_images", ("content_blocks",), lambda: F.size(images) > 8)
        rule("warning", "image_gallery_leak", ("content_blocks",), lambda: run_in_array(c("content_blocks"), lambda b: b["type"] == "image") >= 3)
        rule("warning", "invalid_inline_image", ("content_blocks",), lambda: F.exists(images, lambda b: ~is_http(b["url"])))
    if "paragraphs" in has:
        # furniture is looked for in the tail as one text
        last = F.lower(F.array_join(tail(F.filter(F.transform("paragraphs", collapse), lambda p: p != "")), " "))
        found.append(bind(last, lambda said: F.array(*[_issue("warning", code, said.rlike(pattern)) for code, pattern in config.tail_furniture])))
        long = F.filter(F.transform("paragraphs", lambda p: key(p)), lambda p: F.length(p) >= 45)
        found.append(bind(long, lambda keys: F.array(_issue("warning", "duplicate_body", F.size(F.array_distinct(keys)) < F.size(keys)))))
    if "image" in has:
        hero = F.coalesce(c("image"), F.lit(""))
        rule("warning", "invalid_hero_image", ("image",), lambda: (hero != "") & ~is_http(hero) & ~F.startswith(hero, F.lit("/")))
        rule("info", "missing_hero_image", ("image",), lambda: hero == "")
    rule("info", "missing_author", ("author", "source"), lambda: publisher & (collapse("author") == ""))
    official = c("source").isin(*config.official_sources) if "source" in has and config.official_sources else F.lit(False)
    rule("info", "low_local_relevance", ("local_score",), lambda: (c("local_score") < 20) & ~official)
    return df.withColumn("issues", F.array_distinct(F.filter(F.concat(*found), lambda i: i.isNotNull())))


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


def scored(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """df with audit_score and audit_status from its issues."""
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s))
    loss = sum((count(s) * w for s, w in config.severity_weight.items()), F.lit(0))
    score = F.greatest(F.lit(0), 100 - loss).cast("int")
    status = F.when(count("critical") > 0, "fail").when(count("warning") > 0, "review").otherwise("pass")
    return df.withColumns({"audit_score": score, "audit_status": status})


def cluster_aware(df: DataFrame, complete: DataFrame) -> DataFrame:
    """short_body becomes cluster_covered_summary where another source of the cluster has a complete report."""
    out = df.join(complete, "cluster_id", "left")
    other = F.size(F.array_except(F.coalesce("complete_sources", F.array().cast("array<string>")), F.array("source"))) > 0
    swap = F.transform("issues", lambda i: F.when(other & (i["code"] == "short_body"), F.struct(F.lit("info").alias("severity"), F.lit("cluster_covered_summary").alias("code"), F.lit("covered by another source").alias("message"))).otherwise(i))
    return out.withColumn("issues", F.array_distinct(swap)).drop("complete_sources")


def exploded(df: DataFrame, key_: str = "id") -> DataFrame:
    """A row for each issue, worst first within a row."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return df.select(key_, "source", F.explode("issues").alias("i")).select(key_, "source", "i.severity", "i.code", "i.message").withColumn("severity_rank", rank)


def source_report(df: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Each source's audited rows: passes, whole rates, averages without zeros, commonest method, issues by severity, status.

    df has audit_status, content_status, quality, words, issues, published and method (those of a missing column are left
    out); health(source, collector_status, ...) adds what the collectors say, and sources without rows, which are waiting.
    """
    whole = lambda x: F.bround(x, 0).cast("int")
    passed, failed, review = (F.count_if(F.col("audit_status") == s) for s in ("pass", "fail", "review"))
    per = lambda s: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s))).alias(f"{s}_issues")
    issues_ = [per(s) for s in ("critical", "warning", "info")]
    usable = F.count_if(F.col("content_status").isin("full", "partial"))
    out = df.groupBy("source").agg(
        F.count("*").alias("sampled"), passed.alias("passed"), review.alias("review"), failed.alias("failed"),
        whole(passed / F.count("*") * 100).alias("pass_rate"), whole(usable / F.count("*") * 100).alias("usable_rate"),
        whole(F.avg(F.when(F.col("quality") > 0, F.col("quality")))).alias("mean_quality"), whole(F.avg(F.when(F.col("words") > 0, F.col("words")))).alias("mean_words"),
        *issues_, F.max("published").alias("latest"),
    )
    methods = df.where(F.coalesce("method", F.lit("")).isin("", "unknown") == F.lit(False)).groupBy("source", "method").agg(F.count("*").alias("n"))
    methods = methods.groupBy("source").agg(F.min_by("method", F.struct(-F.col("n"), "method")).alias("primary_method"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("method_counts"))
    if health is not None:
        out = out.join(health, "source", "full")
    else:
        out = out.withColumn("collector_status", F.lit(None).cast("string"))
    out = out.join(methods, "source", "left")
    counted = ("sampled", "passed", "review", "failed", "pass_rate", "usable_rate", "mean_quality", "mean_words", "critical_issues", "warning_issues", "info_issues", *(("found_this_run",) if "found_this_run" in out.columns else ()))
    waiting = F.col("sampled").isNull()
    poor = (F.col("failed") > 0) & (F.col("pass_rate") < 60)
    mixed = (F.col("failed") + F.col("review") > 0) | (F.col("pass_rate") < 80)
    said = F.coalesce("collector_status", F.lit("unknown"))
    status = F.when(waiting, "waiting").when((said == "error") | poor, "error").when((said == "degraded") | mixed, "review").otherwise("healthy")
    out = out.withColumn("status", status).withColumns({"collector_status": said, "primary_method": F.coalesce("primary_method", F.lit("unknown"))})
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})


def overview(df: DataFrame) -> DataFrame:
    """One row of counts over all audited rows."""
    per = lambda s: F.sum(F.size(F.filter("issues", lambda i: i["severity"] == s))).alias(f"{s}_issues")
    return df.agg(F.count("*").alias("stories"), *[F.count_if(F.col("audit_status") == s).alias(s) for s in ("pass", "review", "fail")], per("critical"), per("warning"), per("info"))
