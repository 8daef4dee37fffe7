"""Snapshots: reading with defaults, writing whole editions, per-key parts and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_snapshot(spark: SparkSession, path: str, schema: StructType, kind: str = "json") -> DataFrame:
    """A snapshot's rows; a missing one has none, and a broken JSON row is one of nulls that is dropped."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    if kind == "json":
        marked = StructType([*schema.fields]).add("_corrupt_record", "string")
        rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
        return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return spark.read.schema(schema).parquet(path)


def write_snapshot(df: DataFrame, path: str, kind: str = "parquet", newest: str = "published") -> None:
    """All rows, newest first within each range of files, in place of what was there."""
    df.repartitionByRange(F.col(newest).desc_nulls_last()).sortWithinPartitions(F.col(newest).desc_nulls_last()).write.mode("overwrite").format(kind).save(path)


def write_parts(df: DataFrame, path: str, key: str = "id", buckets: int = 256) -> None:
    """Rows by key for point look-ups: folders by a hash of the key (a folder for each key would not scale), sorted inside."""
    df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


#: Columns of the readers' feed (fixed values).
FEED = (
    "id", "title", "summary", "source", "discovery_via", "scope", "category", "published", "cluster_latest_published", "card_image_source",
    "card_image_variants", "card_image_small", "card_image", "image", "image_alt", "image_focus_x", "image_focus_y", "image_caption",
    "word_count", "cluster_sources", "cluster_source_count", "cluster_id", "cluster_representative", "quality", "content_status", "author",
    "url", "story_topics",
)


def feed(df: DataFrame) -> DataFrame:
    """The feed's projection: its columns in their order, those that df has."""
    return df.select(*[c for c in FEED if c in df.columns])


def write_report(report: DataFrame, issues: DataFrame, overview: DataFrame, path: str) -> None:
    """An audit's three tables side by side, each in place of the one before."""
    for name, df in (("report", report), ("issues", issues), ("overview", overview)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def lookup(spark: SparkSession, path: str, key: str, value, buckets: int = 256) -> DataFrame:
    """One key's rows: one folder is read, and of it the row groups that may hold the key."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets))).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == F.lit(value))).drop("bucket")
