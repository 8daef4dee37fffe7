"""Mixing sources to target weights.

Rows get a hash-random key (md5 of the id); within each source they are sorted by key range, sizes are summed up along
that order with distributed prefix sums (totals of key ranges first, then rows inside a range), and each source is cut at
its exact budget. A budget beyond the source's size repeats whole epochs.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that share an id keep
the order of their texts' sizes (where they are very many, one that their places in the input give); rows without an id are keyed by their text, so that they spread over the key ranges; a very
long text is counted whole and may be cut anywhere between two words; an empty table gives an empty mix; columns of any
other name are not read, and mix_documents returns them as they are, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, durable, inside, table, width

WEIGHTS = (5, 2, 1)
#: Rows of a key range that is summed up in one piece; a range of CROWDED times as many is dealt over several.
RANGE_ROWS, CROWDED = 4096, 4


def text_size(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size) with rank and target.

    Sources by code point, null last, take the weights in turn. Targets sum to share of all sizes, none above most times
    its source's size; the excess goes to the others by weight until none is above. Each round is one distributed
    aggregation of one row, so the number of sources doesn't matter.
    """
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    # ranks: ranges of names in order, then rows of a range; no task sees all sources
    ranged = durable(sources.repartitionByRange(width(spark), *order).withColumn("range", F.spark_partition_id()), "sources")
    before = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    before = before.withColumn("before", F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1 + F.col("before")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = durable(ranged.join(F.broadcast(before.select("range", "before")), "range").withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int"))).drop("range", "before"), "ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level, fixed = 0.0, -1
    while True:
        capped = cap <= F.col("weight") * F.lit(level)
        n, caps, free = ranked.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if n == fixed or not free:
            break
        fixed, level = n, (float(total) * share - caps) / free
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix_sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """sized(doc_id, source, size; tie, a hash of the text, where rows may lack an id) and the columns named in keep, with source_size, target, taken, and first: the taken size of the last, cut epoch alone.

    taken = whole epochs * size + what the cut epoch takes; over a source it sums to the whole part of its target.
    """
    unnamed = F.concat(F.lit("null:"), F.coalesce(F.col("tie").cast("string"), F.lit(""))) if "tie" in sized.columns else F.lit("null")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), unnamed)))
    rows = sized.select("doc_id", "source", "size", *keep, key.alias("key"))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = durable(source_targets(per, weights, share, most), "targets")
    # key ranges of a source: as many as its rows need, so a source with a third of all rows has a third of all ranges
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") / RANGE_ROWS))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 32)))
    keyed = rows.withColumn("same", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    small = targets.withColumn("same", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).select("same", "source_size", "target", ranges.alias("ranges"))
    keyed = keyed.join(small, "same").withColumn("bucket", bucket)
    # rows of one key share a range, however many; where that crowds it, its rows are dealt over several
    counted = durable(keyed.groupBy("same", "bucket").agg(F.count("*").alias("m")).where(F.col("m") > CROWDED * RANGE_ROWS), "crowded")
    if counted.isEmpty():
        keyed = keyed.withColumn("part", F.lit(0))
    else:
        salted = keyed.withColumn("salt", F.monotonically_increasing_id()).join(counted, ["same", "bucket"], "left")
        keyed = salted.withColumn("part", F.coalesce(F.pmod(F.xxhash64("key", "salt"), F.ceil(F.col("m") / RANGE_ROWS)), F.lit(0)).cast("int")).drop("salt", "m")
    totals = keyed.groupBy("same", "bucket", "part").agg(F.sum("size").alias("inside"))
    run = Window.partitionBy("same").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("inside").over(run), F.lit(0))).drop("inside")
    inner = Window.partitionBy("same", "bucket", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("upto", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(totals, ["same", "bucket", "part"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - whole * F.col("source_size")
    first = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("upto")))
    return summed.select("doc_id", "source", "size", *keep, "source_size", "target", (whole * F.col("size") + first).cast("long").alias("taken"), whole.cast("int").alias("epochs"), first.cast("long").alias("first"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each epoch of a document; the row at a source's cut holds its first words, up to the budget.

    The columns of docs (doc_id, source and text among them) stay as they are; a cut text's words are joined by one space.
    """
    own = inside(docs, "doc_id", "source", "text", "n_chars")
    rows = durable(own.withColumns({"row": F.monotonically_increasing_id(), "size": text_size(F.col("text"))}), "mixrows")
    sized = rows.select("doc_id", "source", "size", F.xxhash64("text").alias("tie"), "row")
    taken = mix_sources(sized, keep=("row",), **options).where("epochs > 0 or first > 0").select("row", "epochs", "first")
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("first").cast("int")))
    copies = F.concat(F.array_repeat(F.lit(True), F.col("epochs")), F.when(F.col("first") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    out = rows.join(taken, "row").withColumn("whole", F.explode(copies))
    out = out.withColumn("text", F.when(F.col("whole") | (F.col("first") >= F.col("size")), F.col("text")).otherwise(cut))
    if "n_chars" in own.columns:
        out = out.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    return out.select(*own.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the mix of all documents."""
    sized = durable(table(spark, sf_dir, "documents").select("doc_id", "source", text_size(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("tie")), "sizes")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken")


_SPACES = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM per),
steps AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
    coalesce(sum(source_size * 2.0::DOUBLE) OVER w, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free, sum(source_size) OVER () * 1.5::DOUBLE AS total, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS rn
    FROM ranked WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT arg_min((total - caps) / free, rn) FILTER (cap > weight * ((total - caps) / free)) AS level FROM steps),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM steps, lev),
s AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken FROM s
"""
