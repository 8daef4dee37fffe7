"""N-gram Jaccard join of documents: size-banded tiles with hashed bitmap signatures, exact intersection of sorted arrays.

A document's set is that of its distinct k-word shingles over the whole lower-cased text; with fewer words, the whole
sequence as one; without words, empty. Tiles come from shared rare shingles (see setjoin), so that a document meets those
of its size band that share one, not all of its band: a band alone would be a quadratic join.

Defined results: null texts have no words; empty sets link with nothing; rows that share an id are one node (a link of any
of them links all); a null id takes part under no id: it returns with a null component unless it links to others; an
empty table gives no rows; very long texts are read whole, one at a time where they are larger than a step; other columns
are not read. Shingles are told apart by 48 bits of hash, and classes of equal sets by 64 bits over theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, durable, flat, inside, scratch, spans, table
from .setjoin import Units, link, linked_components, survey
from .words import STEP, shingles, word_hashes

WORDS, PERCENT = 5, 75


def document_units(k: int):
    """Reader of batches with a column text: a unit for each row with words; the extra column row is its number in the batch."""

    def read(b: pa.RecordBatch) -> Iterator[tuple[Units, dict]]:
        data, at = flat(b.column("text"))
        for i, j in spans(at, STEP):
            for i2 in range(i, j, 60_000):
                j2 = min(j, i2 + 60_000)
                words, counts = word_hashes(data[at[i2] : at[j2]], at[i2 : j2 + 1] - at[i2])
                hashes, places = shingles(words, counts, k)
                full = np.flatnonzero(np.diff(places))
                yield Units(hashes, np.append(places[:-1][full], len(hashes))), {"row": full + i2}

    return read


def _grouped(docs: DataFrame, keys: list[str], k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs(keys, long numbers; text) -> the rows with words (keys, n, c), and the classes of equal sets (c, g, first): the group that links make, and the least keys."""
    read = document_units(k)
    with scratch() as kept:
        surveyed = survey(docs, read, {x: pa.int64() for x in keys}, lambda b, found: [b.column(x).take(pa.array(found["row"])) for x in keys])
        rows = durable(surveyed.where("piece is null").select(*keys, "n", "c"), "rows")
        first = F.min(keys[0]) if len(keys) == 1 else F.min(F.struct(*keys))
        classes = durable(rows.groupBy("c").agg(first.alias("first")), "classes")
        named = linked_components(*link(docs.select("text"), read, surveyed, classes, percent, last=True), percent)
        groups = durable(classes.join(named, "c", "left").select("c", F.coalesce("component", "c").alias("g"), "first"), "groups")
        kept += [rows, groups]
    return rows, groups


def near_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: groups of documents with Jaccard of percent/100 or more, chained."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told, groups = _grouped(docs, ["doc_id"], k, percent)
    none = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select("doc_id", F.lit(0).alias("n"), F.lit(None).cast("long").alias("c"))
    rows = told.unionByName(none)
    # ids that stand in several classes tie these together
    ids = rows.where("doc_id is not null and c is not null").select("doc_id", "c").distinct()
    shared = ids.groupBy("doc_id").agg(F.count("*").alias("m"), F.min("c").alias("least")).where("m > 1")
    if not shared.isEmpty():
        from .components import components

        ties = ids.join(shared, "doc_id").join(groups.select("c", "g"), "c").select(F.col("least"), "g").join(groups.select(F.col("c").alias("least"), F.col("g").alias("g2")), "least")
        tied = durable(components(ties.select(F.col("g").alias("u"), F.col("g2").alias("v"))), "tied").toDF("g", "g3")
        groups = durable(groups.join(tied, "g", "left").select("c", F.coalesce("g3", "g").alias("g"), "first"), "groups")
    least = groups.groupBy("g").agg(F.min("first").alias("component_id"))
    final = durable(groups.join(least, "g").select("c", "component_id"), "final")
    out = rows.join(final, "c", "left")
    # a copy without words of an id that has words elsewhere is that node too
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-equal texts: that of the least id, then of the least hash of its text and of its other columns.

    Groups are of texts, so rows that share an id but not their texts are apart; equal rows are one group. Rows without an
    id stay, and so do texts without words, one row of those that are equal in all columns.
    """
    own = inside(docs, "doc_id", "text")
    id_ = F.col("doc_id").cast("long")
    others = [c for c, t in own.dtypes if c != "text" and not t.startswith("map")]
    keyed = own.withColumns({"id": id_, "text_hash": F.xxhash64("text"), "row_hash": F.xxhash64(*others)})
    # map-like columns can't be hashed: rows that differ in them alone are taken as equal
    keys = ["id", "text_hash", "row_hash"]
    named = id_.isNotNull() & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    told, groups = _grouped(keyed.where(named).select(*keys, "text"), keys, k, percent)
    kept = durable(groups.groupBy("g").agg(F.min("first").alias("first")).select("first.*"), "kept")
    out = keyed.where(named).join(kept, keys, "left_semi")
    if told.join(kept, keys, "left_semi").count() > kept.count():
        out = out.dropDuplicates(keys)
    wordless = keyed.where(id_.isNotNull() & ~named).dropDuplicates(keys)
    return out.unionByName(wordless).unionByName(keyed.where(id_.isNull())).drop(*keys).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: near-duplicate groups of all documents."""
    return near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
walk AS (SELECT doc_id AS root, doc_id AS node FROM d UNION SELECT w.root, p.b FROM walk w JOIN p ON p.a = w.node),
c AS (SELECT root, min(node) AS component_id FROM walk GROUP BY root)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d JOIN c ON c.root = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
