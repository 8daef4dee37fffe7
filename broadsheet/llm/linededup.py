"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct 5-word shingles over the lower-cased line; a line of fewer words has its whole sequence as
one, so it goes only after an equal sequence. They are ordered by rarity over the corpus;
prefixes propose pairs, lengths and bitmaps filter them, sorted arrays verify Jaccard (see setjoin). A line goes if a line
of PERCENT Jaccard or more, an equal one included, comes before it: in a document of a smaller id, or earlier in its own.
Lines without a word have no token and stay.

Defined results: a null text has no lines and stays null; lines are what newlines part, and the others keep their places;
null ids come last, in order of text hashes; repeated rows (same id and text) are one document, so each keeps the same
lines; an empty table gives no rows; very long texts are cut into lines whole; other columns stay as they are, whatever
their names, but for n_chars, which follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, durable, flat, inside, scratch, spans, table
from .setjoin import Units, crowded, families, link, rest, stars, survey
from .words import STEP, shingles, word_hashes

WORDS, PERCENT = 5, 75
_LAST = (1 << 63) - 1


def line_units(k: int):
    """Reader of batches with a column text: a unit for each line that has words, with the numbers of its row and line."""

    def read(b: pa.RecordBatch) -> Iterator[tuple[Units, dict]]:
        data, at = flat(b.column("text"))
        for i, j in spans(at, STEP):
            piece, rows = data[at[i] : at[j]], at[i : j + 1] - at[i]
            breaks = np.flatnonzero(piece == 10) + 1
            place = np.concatenate([breaks, rows[:-1]])
            kind = np.concatenate([np.zeros(len(breaks), np.int8), np.ones(j - i, np.int8)])
            order = np.lexsort((kind, place))
            place, kind = place[order], kind[order]
            row = np.cumsum(kind) - 1
            line = np.arange(len(row)) - np.flatnonzero(kind)[row]
            words, counts = word_hashes(piece, np.append(place, len(piece)))
            told = np.flatnonzero(np.diff(counts))
            for a in range(0, len(told), 60_000):
                some = told[a : a + 60_000]
                lo, hi = some[0], some[-1] + 1
                hashes, places = shingles(words, counts[lo : hi + 1], k) if lo == 0 else shingles(words[counts[lo] :], counts[lo : hi + 1] - counts[lo], k)
                keep = np.zeros(hi - lo, bool)
                keep[some - lo] = True
                on = np.repeat(keep, np.diff(places))
                sizes = np.diff(places)[keep]
                yield Units(hashes[on], np.concatenate([[0], np.cumsum(sizes)])), {"row": row[some] + i, "line": line[some]}

    return read


def _keyed(docs: DataFrame, id_: str = "__id", text: str = "__text") -> DataFrame:
    """docs with an id (null ids last) and a hash of the text, under the names given: together they name a document."""
    return docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(text, F.xxhash64("text"))


def repeated_lines(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> (__id, __text, gone): numbers of the lines to remove, for documents that have some."""
    keyed = _keyed(docs.select("doc_id", "text")).select("__id", "__text", "text")
    read = line_units(k)

    extra = {"id": pa.int64(), "h": pa.int64(), "line": pa.int32()}

    def more(b: pa.RecordBatch, found: dict) -> list:
        row = pa.array(found["row"])
        return [b.column("__id").take(row), b.column("__text").take(row), pa.array(found["line"].astype(np.int32))]

    with scratch() as kept:
        surveyed = survey(keyed, read, extra, more, signed=False)
        lines = surveyed.where("piece is null").select("id", "h", "line", "c")
        classes = durable(lines.groupBy("c").agg(F.min(F.struct("id", "h", "line")).alias("first"), F.count("*").alias("m")), "lineclasses")
        members, sets_ = link(keyed.select("text"), read, surveyed, classes, percent, small=True)
        order = durable(members.select("c", "first").distinct(), "order")

        def later(pairs: DataFrame) -> DataFrame:
            both = pairs.join(order.toDF("a", "fa"), "a").join(order.toDF("b", "fb"), "b")
            return both.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("c")).distinct()

        pairs = sets_.may(stars(members, percent))
        sets_.fetch(pairs)
        gone = durable(later(sets_.exact(pairs)), "gone")
        # in tiles of three and more, who hasn't gone, but for the first member, still meets everyone before it: at once where
        # these are few, else first the likeliest one, which settles nearly all, then all
        crowd, asking = durable(crowded(members), "crowd"), None
        for best in (True, False):
            state = crowd.join(gone.withColumn("gone", F.lit(True)), "c", "left").withColumn("open", F.col("gone").isNull())
            if asking is not None:
                state = state.join(asking, "c", "left").withColumn("open", F.col("open") & F.coalesce("asks", F.lit(False))).drop("asks")
            heads = crowd.groupBy("t").agg(F.min(F.struct("first", "c")).alias("head"))
            waiting = state.where("open").join(heads, "t").where("c <> head.c").select("t").distinct()
            waiting = durable(state.join(waiting, "t").drop("gone"), "waiting")
            if waiting.isEmpty():
                break
            found = rest(families(waiting), sets_.signs, percent, best=best)
            others, asking = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("c"), F.lit(True).alias("asks"))
            sets_.fetch(others)
            gone = durable(gone.unionByName(later(sets_.exact(others))).distinct(), "gone")
            if asking.isEmpty():
                break
        gone = gone.withColumn("gone", F.lit(True))
        known = durable(classes.join(gone, "c", "left").where("m > 1 or gone").select("c", "first", F.coalesce("gone", F.lit(False)).alias("gone")), "known")
        out = lines.join(known, "c").where(F.col("gone") | (F.struct("id", "h", "line") > F.col("first")))
        found = durable(out.groupBy(F.col("id").alias("__id"), F.col("h").alias("__text")).agg(F.collect_set("line").alias("gone")), "gonelines")
        kept.append(found)
    return found


def drop_lines(docs: DataFrame, gone: DataFrame, n_lines: str, n_gone: str) -> DataFrame:
    """docs (from inside()) with what is left of text, and the numbers of all lines and of those gone, under the names given."""
    id_, text, out_ = apart(docs, "id", "hash", "gone")
    # hashing the small side spares sorting the texts; its keys are unique, so a partition holds its share of it and no more
    out = _keyed(docs, id_, text).join(gone.toDF(id_, text, out_).hint("shuffle_hash"), [id_, text], "left")
    # the lines are a lambda's argument: named inside the inner one, the text would be split again for each of them
    without = lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out_)), lambda i: F.get(lines, i)), "\n")
    kept = F.get(F.transform(F.array(F.split("text", "\n", -1)), without), F.lit(0))
    out = out.withColumn(n_lines, F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"))
    out = out.withColumn(n_gone, F.coalesce(F.size(out_), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col(out_).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, n_lines, n_gone)


def dedup_lines(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without their repeated lines."""
    own = inside(docs, "doc_id", "text", "n_chars")
    gone = repeated_lines(own.select("doc_id", "text"), k, percent)
    return drop_lines(own, gone, "n_lines", "n_gone").drop("n_lines", "n_gone").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents without lines that come again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs, repeated_lines(docs), "n_lines", "n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
l AS (SELECT doc_id, i, l[i] AS line FROM d, unnest(generate_series(1, len(l))) AS t(i)),
w AS (SELECT doc_id, i, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
s AS (SELECT DISTINCT doc_id, i, md5(array_to_string(w[j:j + 4], ' ')) AS h FROM w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(j) WHERE len(w) > 0),
k AS (SELECT doc_id, i, md5(string_agg(h, '' ORDER BY h)) AS c, count(*) AS n FROM s GROUP BY 1, 2),
f AS (SELECT c, min(n) AS n, min((doc_id, i)) AS first FROM k GROUP BY c),
cs AS (SELECT DISTINCT k.c, s.h FROM s JOIN k USING (doc_id, i) JOIN f ON f.c = k.c AND f.first = (k.doc_id, k.i)),
o AS (SELECT a.c AS a, b.c AS b, count(*) AS k FROM cs a JOIN cs b ON a.h = b.h AND a.c <> b.c GROUP BY 1, 2),
g AS (SELECT DISTINCT o.b AS c FROM o JOIN f x ON x.c = o.a JOIN f y ON y.c = o.b WHERE 100 * o.k >= 75 * (x.n + y.n - o.k) AND x.first < y.first),
gone AS (SELECT k.doc_id, k.i FROM k JOIN f USING (c) WHERE (k.doc_id, k.i) > f.first OR k.c IN (SELECT c FROM g))
SELECT d.doc_id, CAST(coalesce(len(d.l), 0) AS BIGINT) AS n_lines, count(gone.i) AS n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY d.doc_id, d.l
"""
