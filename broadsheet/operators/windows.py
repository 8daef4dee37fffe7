"""Per-group order: top rows, runs, cut-offs, and folds that depend on what was kept before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity
from ..functions.text import split_count


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank; Spark limits each task's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def page(df: DataFrame, order: list[Column], size: int, number: int) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(size * number).limit(size)


def gap_dedupe(df: DataFrame, key: list[str], ts: str, tie: str, gap_seconds: int, newest_first: bool = True, exempt: Column | None = None) -> DataFrame:
    """Rows of each key that aren't within a gap of the last kept one: a fold over the key's sorted times.

    Times alone travel in the fold's array, (time, tie) pairs; a key's rows must fit in a task, as with any ordered fold.
    """
    if exempt is not None:  # rows whose key tells too little pass
        rows = df.withColumn("__exempt", F.coalesce(exempt, F.lit(False)))
        told = gap_dedupe(rows.where("not __exempt").drop("__exempt"), key, ts, tie, gap_seconds, newest_first)
        return told.unionByName(rows.where("__exempt").select(*told.columns))
    at = F.unix_micros(ts)
    seq = F.sort_array(F.collect_list(F.struct(at.alias("at"), F.col(tie).alias("tie"))), asc=not newest_first)
    folded = df.where(F.col(ts).isNotNull()).groupBy(*key).agg(seq.alias("seq"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<struct<at:bigint,tie:{df.schema[tie].dataType.simpleString()}>>").alias("kept"))
    fold = F.aggregate(
        "seq",
        start,
        lambda s, x: F.when(s["last"].isNull() | (F.abs(s["last"] - x["at"]) > gap_seconds * 1_000_000), F.struct(x["at"].alias("last"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s),
    )
    return folded.select(*key, F.explode(fold["kept"]).alias("k")).select(*key, F.timestamp_micros("k.at").alias(ts), F.col("k.tie").alias(tie))


def collapse_clusters(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first member of clusters with several sources; all others pass."""
    multi = (F.coalesce(F.col("cluster_source_count"), F.lit(1)) >= 2) & F.col("cluster_id").isNotNull()
    part = F.when(multi, F.col("cluster_id")).otherwise(F.concat(F.lit("one:"), F.col("id").cast("string")))
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(~multi | (F.col("__r") == 1)).drop("__r")


def longest_run(df: DataFrame, group: list[str], order: str, value: Column) -> DataFrame:
    """Length of the longest run of consecutive rows for which value holds: gaps and islands."""
    w = Window.partitionBy(*group).orderBy(order)
    marked = df.withColumn("__on", F.coalesce(value, F.lit(False))).withColumn("__i", F.row_number().over(w))
    island = F.col("__i") - F.row_number().over(Window.partitionBy(*group, "__on").orderBy(order))
    runs = marked.withColumn("__island", island).groupBy(*group, "__on", "__island").agg(F.count("*").alias("__n"))
    return runs.groupBy(*group).agg(F.coalesce(F.max(F.when(F.col("__on"), F.col("__n"))), F.lit(0)).alias("longest_run"))


def run_in_array(items: Column, holds) -> Column:
    """Longest run of consecutive items for which holds(item) is true."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(items, start, lambda s, x: F.when(F.coalesce(holds(x), F.lit(False)), F.struct((s["now"] + 1).alias("now"), F.greatest(s["best"], s["now"] + 1).alias("best"))).otherwise(F.struct(F.lit(0).alias("now"), s["best"].alias("best"))))["best"]


def cut_at_marker(paragraphs: Column, is_marker, least_words: int = 45, least_blocks: int = 2) -> Column:
    """Paragraphs up to the first marker that follows enough prose; markers before that stay."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("blocks"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("kept"))

    def step(s, p):
        enough = (s["words"] >= least_words) | (s["blocks"] >= least_blocks)
        stop = s["done"] | (enough & F.coalesce(is_marker(p), F.lit(False)))
        return F.struct((s["words"] + split_count(p)).alias("words"), (s["blocks"] + 1).alias("blocks"), stop.alias("done"), F.when(stop, s["kept"]).otherwise(F.concat(s["kept"], F.array(p))).alias("kept"))

    return F.aggregate(paragraphs, start, step)["kept"]


def drop_recent_repeats(items: Column, look_back: int = 12) -> Column:
    """Items that aren't near-duplicates (text.near_duplicate) of one of the last kept ones: each item's key is made once."""
    return similarity.not_repeated(items, look_back, by_ratio=False)


def tail(items: Column, least: int = 2) -> Column:
    """The last third of an array, a few items at least."""
    n = F.greatest(F.lit(least), F.floor(F.size(items) / 3).cast("int"))
    return F.when(F.size(items) <= n, items).otherwise(F.slice(items, -n, n))
