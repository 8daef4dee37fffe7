"""Reading the tables, and documents as stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_count

#: The instant that stands for "now", and the newest story's time, in the queries over the given tables.
NOW = "2024-06-01 06:00:00"
BASE = "2024-06-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are UTC instants."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    naive = [f.name for f in df.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def now(at: str = NOW) -> Column:
    return F.lit(at).cast("timestamp")


def stories(spark: SparkSession, folder: str, with_labels: bool = False) -> DataFrame:
    """documents as stories: the first line is the title, the second the summary; ids run back in time by minutes."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    df = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.get(lines, F.lit(0)).alias("title"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("summary"),
        "source",
        "lang",
        (F.lit(BASE).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("published"),
        lines.alias("paragraphs"),
        split_count("text").alias("words"),
    )
    if with_labels:
        labels = table(spark, folder, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        df = df.join(labels, "id", "left")
    return df
