"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over WINDOW bytes marks the boundaries of a text's chunks: where it is -1 modulo the block size. Boundaries at
twice a block size are among those at the size itself, so an edit moves only boundaries beside it. Each chunk is hashed to a
character; a fingerprint is the block size, the characters at it, and those at its double. The block size is the least
SMALLEST * 2**k at which MOST chunks of it hold the text, halved while it cuts the text into fewer than LEAST chunks, so that
texts of like length have compatible sizes. A signature holds MOST characters at most: its last chunk then reaches to the end
of the text, so every byte counts.

Likeness compares signatures of one block size by edit distance (insertions and deletions, as a share of both lengths);
fingerprints whose sizes are neither equal nor one the other's double have none in common, and so have signatures
without a run of RUN characters in common, not all the same, which unrelated texts rarely share. Equal fingerprints have likeness 1.

Defined results: a null text is fingerprinted as an empty one, "3::"; equal texts have equal fingerprints; a text is read
whole, however long, one at a time. For `edited`, documents follow each other by id (null ids first), those of one id by a
hash of their texts, and after the last comes the first, a lone document itself; repeated rows follow each other; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import durable, lean, mix, table, width
from .words import INVERSE, powers

WINDOW, SMALLEST, LEAST, MOST, RUN = 7, 3, 32, 64, 7
#: The characters of signatures.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(LETTERS.encode(), np.uint8)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of it and the WINDOW - 1 before it (zeros before the first): their sum, their sum by place, and their bits shifted over each other."""
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    plain, placed, shifted = (np.zeros(len(data), np.uint32) for _ in range(3))
    for k in range(WINDOW):
        at = wide[k : k + len(data)]
        plain += at
        placed += np.uint32(k + 1) * at
        shifted ^= at << np.uint32(5 * (WINDOW - 1 - k))
    return plain + placed + shifted


def signature(sums: np.ndarray, ends: np.ndarray) -> str:
    """A character for each chunk, from the running sums of its bytes' values; what follows MOST - 1 chunks is one."""
    if len(sums) < 2:
        return ""
    stops = np.append(ends[: MOST - 1] + 1, len(sums) - 1)
    stops = stops[:-1] if len(stops) > 1 and stops[-2] == stops[-1] else stops
    starts = np.concatenate([[0], stops[:-1]])
    hashes = mix((sums[stops] - sums[starts]) * powers(len(sums), INVERSE)[starts] + (stops - starts).astype(np.uint64))
    return _LETTERS[hashes >> np.uint64(58)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode(), np.uint8)
    hashes = rolling(data)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[: len(data)], out=sums[1:])
    cuts = lambda s: np.flatnonzero(hashes % np.uint32(s) == s - 1)
    size = SMALLEST
    while size * MOST < len(data):
        size *= 2
    while size > SMALLEST and len(cuts(size)) + 1 < LEAST:
        size //= 2
    return f"{size}:{signature(sums, cuts(size))}:{signature(sums, cuts(2 * size))}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all columns of a in one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = every = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & every
    return len(a) - row.bit_count()


def _runs(a: str) -> set[str]:
    """Runs of RUN characters that aren't all the same."""
    return {x for i in range(len(a) - RUN + 1) if len(set(x := a[i : i + RUN])) > 1}


def alike(a: str, b: str) -> float:
    """Likeness of two signatures of one block size."""
    if a == b:
        return 1.0
    if _runs(a).isdisjoint(_runs(b)):
        return 0.0
    distance = len(a) + len(b) - 2 * common_subsequence(a, b)
    return 1 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1, the same in either order."""
    if a == b:
        return 1.0
    (n, x, y), (m, u, v) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(alike(x, u) if x and u else 0.0, alike(y, v) if y and v else 0.0)
    if n == 2 * m:
        return alike(x, v) if x and v else 0.0
    if m == 2 * n:
        return alike(y, u) if y and u else 0.0
    return 0.0


@F.arrow_udf(StringType())
def fingerprints(text: pa.Array) -> pa.Array:
    """Fingerprint of each text, as a column."""
    return pa.array([fingerprint(x) for x in text.to_pylist()], pa.string())


@F.arrow_udf(DoubleType())
def fingerprint_likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    """Likeness of two columns of fingerprints."""
    return pa.array([likeness(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def edit(text: str, after: str) -> str:
    """The text with its second half, floor(n / 2) code points, replaced by as many of the first of the one after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("pid", pa.int64()), ("edge", pa.int32()), ("text", pa.string())])
_SQL = "doc_id long, n_chars long, edited string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, pid long, edge int, text string"
_RESULT = [f.name for f in _OUT][:8]
FIRST, LAST = 0, 1
#: Code points of texts that go out in one batch.
STEP = 1 << 20


def _row(texts: bool, doc_id: int | None, text: str, mark: str, after: str, after_mark: str) -> dict:
    new = edit(text, after)
    other = fingerprint(new)
    digest = hashlib.sha256(new.encode()).hexdigest()
    return {"doc_id": doc_id, "n_chars": len(text), "edited": new if texts else None, "edited_sha256": digest, "fingerprint": mark, "edited_fingerprint": other, "near_edited": likeness(mark, other), "near_next": likeness(mark, after_mark)}


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_OUT)


def _in_order(texts: bool):
    """A partition's documents in order: what each makes with the one after it, and its first and its last for other partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, held = None, [], 0
        for b in batches:
            for pid, doc_id, text in zip(b["pid"], b["doc_id"], b["text"]):
                pid, doc_id, text = pid.as_py(), doc_id.as_py(), text.as_py() or ""
                mark = fingerprint(text)
                rows.append({"pid": pid, "edge": FIRST, "text": text, "fingerprint": mark} if last is None else _row(texts, *last[1:], text, mark))
                last = pid, doc_id, text, mark
                held += len(text)
                if held > STEP:
                    yield _arrow(rows)
                    rows, held = [], 0
        if last is not None:
            rows.append({"pid": last[0], "doc_id": last[1], "edge": LAST, "text": last[2], "fingerprint": last[3]})
            yield _arrow(rows)

    return run


def _at_edges(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield _arrow([_row(texts, r["doc_id"], r["text"], r["fingerprint"], r["next_text"], r["next_fingerprint"])])

    return run


def edited(docs: DataFrame, texts: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited (its text, null without texts), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are ranged by id, so that a partition holds neighbours; only its first and its last go on to other ones.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # equal rows have nothing else to be dealt by
    rows = rows.withColumns({"tie": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "salt"]
    rows = rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order)
    found = durable(rows.select(F.spark_partition_id().cast("long").alias("pid"), "doc_id", "text").mapInArrow(lean(_in_order(texts)), _SQL), "fingerprints")
    edges = found.where("edge is not null").select("pid", "edge", "doc_id", "text", "fingerprint")
    firsts, lasts = edges.where(F.col("edge") == FIRST).drop("edge", "doc_id"), edges.where(F.col("edge") == LAST).drop("edge")
    # two numbers for each partition
    after = F.coalesce(F.lead("pid").over(Window.orderBy("pid")), F.min("pid").over(Window.partitionBy()))
    met = lasts.join(firsts.select("pid", after.alias("next")), "pid").join(firsts.toDF("next", "next_text", "next_fingerprint"), "next")
    met = met.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_at_edges(texts), _SQL)
    return found.where("edge is null").unionByName(met).select(*_RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: fingerprints of all documents and of their edited texts."""
    return edited(table(spark, sf_dir, "documents"), texts=False).drop("edited")
