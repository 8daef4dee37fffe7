"""Spelling variant grouping: words that differ in one code point, found by Aho-Corasick automata over halves of words.

A word of length L has two segments, its first L // 2 code points and the rest. One inserted, deleted or replaced code point
leaves one of them whole, so every word near it holds that segment: the first at its start, or the second at its end, and is
as long give or take one. Automaton shards hold the segments of all words; every word is scanned by the shards that can hold
its own, and each segment found is checked for offset and length before the distance of the two words is verified.

Shards are dealt by a segment's three outer code points, those of a head with many segments further by the segment, so a shard
has about SHARD of them. A segment of more than HOT words leaves the automata: what is beside it in its words is compared by
hashes of all that one deletion makes of it, and the strings are verified, so that a hot half isn't expanded into its pairs.

A word's form is its near word of largest count, where that is RATIO times its own at least; so counts rise along forms, the
chains have logarithmic length and no circle, and roots are found by doubling.

Defined results: null texts have no words; a null id is written as an empty one; runs are maximal, whatever their length,
and texts are read whole; repeated rows count each; ties go to the smallest in code-point order; a word without near words has
no form and is its own root; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, forget, lean, lean_group, mix, table, width
from .words import INVERSE, powers

LETTERS = "a-zÀ-ÿ"
#: A run loses a code point where SLIP divides its crc32. Words have SHORTEST code points and SELDOM occurrences at least.
SLIP, SHORTEST, SELDOM, RATIO = 199, 6, 5, 5
#: Segments in a shard, about; words that may share a segment in one.
SHARD, HOT = 20_000, 200
HEAD = SHORTEST // 2
FIRST, SECOND = 0, 1
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Different words that a task counts before it sends them on.
_HELD = 500_000


def words(docs: DataFrame, seldom: int = SELDOM) -> DataFrame:
    """docs(doc_id, text) -> word, n: the distinct words after slips, and how often they occur."""
    run = re.compile(f"[{LETTERS}]{{{SHORTEST},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("id").to_pylist(), b.column("text")):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{doc_id}:".encode())
                lowered = text.as_buffer().to_pybytes().translate(_LOWER).decode()
                for word, n in Counter(run.findall(lowered)).items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % SLIP:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < SHORTEST:
                            continue
                    total[word] += n
                if len(total) > _HELD:
                    yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})
                    total.clear()
        if total:
            yield pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return rows.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= seldom)


def near(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if abs(len(a) - len(b)) > 1:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # to where they first differ, by halves
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a != b and a[lo + (len(a) >= len(b)) :] == b[lo + (len(b) >= len(a)) :]


def _segment(kind: int, word: Column, length: Column, of: Column) -> Column:
    """The part of the word (of this length) that is a segment of a near one of length `of`."""
    half = F.floor(of / 2).cast("int")
    return F.substring(word, F.lit(1), half) if kind == FIRST else F.substring(word, length - (of - half) + 1, of - half)


def segments(found: DataFrame) -> DataFrame:
    """(kind, seg, word, n): the two segments of each word."""
    word, m = F.col("word"), F.length("word")
    both = F.array(*[F.struct(F.lit(k).alias("kind"), _segment(k, word, m, m).alias("seg")) for k in (FIRST, SECOND)])
    return found.select("word", "n", F.explode(both).alias("s")).select("s.kind", "s.seg", "word", "n")


def asked(found: DataFrame) -> DataFrame:
    """(kind, seg, word, n): what a word holds where it may be a near word's segment."""
    word, m = F.col("word"), F.length("word")
    all_ = [F.struct(F.lit(k).alias("kind"), _segment(k, word, m, m + d).alias("seg")) for k in (FIRST, SECOND) for d in (-1, 0, 1) if SHORTEST + d >= 0]
    fits = lambda s: F.length(s.seg) >= HEAD  # noqa: E731  the segments of shorter words don't count
    return found.select("word", "n", F.explode(F.filter(F.array_distinct(F.array(*all_)), fits)).alias("s")).select("s.kind", "s.seg", "word", "n")


def _head() -> Column:
    return F.when(F.col("kind") == FIRST, F.substring("seg", 1, HEAD)).otherwise(F.right("seg", F.lit(HEAD)))


class Automaton:
    """Segments of words, and which of the words are near one that is scanned."""

    def __init__(self, rows: Iterator[tuple[int, str, str, int]]):
        self.held: dict[str, tuple[dict, dict]] = {}
        for kind, seg, word, n in rows:
            self.held.setdefault(seg, ({}, {}))[kind].setdefault(len(word), []).append((word, n))
        self.scanner = ahocorasick.Automaton()
        for seg in self.held:
            self.scanner.add_word(seg, seg)
        if self.held:
            self.scanner.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        m = len(word)
        for end, seg in self.scanner.iter(word) if self.held else ():
            sides = self.held[seg]
            for kind, fits in ((FIRST, end + 1 == len(seg)), (SECOND, end + 1 == m)):
                for length in (m - 1, m, m + 1) if fits else ():
                    for other, n in sides[kind].get(length, ()):
                        # a pair that both segments show counts by the first
                        if (kind == FIRST or not word.startswith(other[: length // 2])) and near(word, other):
                            yield other, n


_PAIRS = "word string, n long, near string, near_n long"


def _scan(t: pa.Table) -> pa.Table:
    rows = list(zip(*[t[c].to_pylist() for c in ("kind", "seg", "word", "n")]))
    automaton = Automaton(r for r in rows if r[1] is not None)
    out = [(word, n, other, k) for word, n in {(r[2], r[3]) for r in rows if r[1] is None} for other, k in automaton.near(word)]
    word, n, other, k = zip(*out) if out else ((),) * 4
    return pa.table({"word": pa.array(word, pa.string()), "n": pa.array(n, pa.int64()), "near": pa.array(other, pa.string()), "near_n": pa.array(k, pa.int64())})


def _by_automata(parts: DataFrame, asks: DataFrame) -> DataFrame:
    """(word, n, near, near_n) from segments and what words hold."""
    spark = parts.sparkSession
    heads = durable(parts.groupBy("kind", _head().alias("head")).agg(F.count("*").alias("m")), "heads")
    shards = max(width(spark), (heads.agg(F.sum("m")).first()[0] or 0) // SHARD + 1)
    # heads of more than a shard: fewer than shards
    split = heads.where(F.col("m") > SHARD).select("kind", "head", F.ceil(F.col("m") / SHARD).cast("int").alias("blocks"))

    def dealt(rows: DataFrame) -> DataFrame:
        at = rows.withColumn("head", _head()).join(split, ["kind", "head"], "left")
        block = F.pmod(F.xxhash64("seg"), F.coalesce("blocks", F.lit(1)))
        return at.withColumn("shard", F.pmod(F.xxhash64("kind", "head", block), F.lit(shards)).cast("int"))

    held = dealt(parts).select("shard", "kind", "seg", "word", "n")
    scanned = dealt(asks).select("shard", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("string").alias("seg"), "word", "n")
    return held.unionByName(scanned).groupBy("shard").applyInArrow(lean_group(_scan), _PAIRS)


def shortened(rests: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several strings: hashes of what each deletion of a code point leaves, with the string's number and the place, and the hash of each whole."""
    codes = np.frombuffer("".join(rests).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.array([len(x) for x in rests], np.int64)
    end = np.cumsum(lens)
    start, which, at = end - lens, np.repeat(np.arange(len(rests)), lens), np.arange(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * powers(len(codes) + 1)[: len(codes)], out=sums[1:])
    back = powers(len(codes) + 2, INVERSE)
    low, high = sums[start[which]], sums[end[which]]
    less = (sums[at] - low + (high - sums[at + 1]) * back[1]) * back[start[which]]
    return less, which, at - start[which], (sums[end] - sums[start]) * back[start]


REPLACED, LONGER, SHORTER = 0, 1, 2


def _shortenings(held: bool):
    """Keys that near words share of what they have beside a hot segment. Of a held word that is the longer one by a code point, a deletion leaves what the asking word has; of a shorter one the other way round."""
    wholes, cut = (SHORTER, LONGER) if held else (LONGER, SHORTER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in ("kind", "seg", "word")])
            rests = [word[len(seg) :] if kind == FIRST else word[: len(word) - len(seg)] for kind, seg, word in rows]
            less, which, place, whole = shortened(rests)
            order = np.lexsort((less, which))
            other = order[np.concatenate([[True], (which[order][1:] != which[order][:-1]) | (less[order][1:] != less[order][:-1])])[: len(order)]]
            n = [len(less), len(other), len(whole)]
            row = pa.array(np.concatenate([which, which[other], np.arange(len(whole))]))
            what = pa.array(np.repeat([REPLACED, cut, wholes], n), pa.int32())
            at = pa.array(np.concatenate([place, np.full(n[1] + n[2], -1)]), pa.int32())
            key = pa.array(np.concatenate([less, less[other], whole]).view(np.int64))
            same = {c: b.column(c).take(row) for c in ("kind", "seg", "id")}
            yield pa.RecordBatch.from_pydict({"kind": same["kind"], "seg": same["seg"], "what": what, "place": at, "key": key, "id": same["id"]})

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [b.column(c).to_pylist() for c in ("kind", "word", "near")]
        keep = pa.array([near(x, y) and (kind == FIRST or not x.startswith(y[: len(y) // 2])) for kind, x, y in zip(*rows)], pa.bool_())
        yield b.select(["word", "n", "near", "near_n"]).filter(keep)


def _by_shortening(parts: DataFrame, asks: DataFrame) -> DataFrame:
    """(word, n, near, near_n) from the rows of hot segments. Words are named by a hash until they are verified, so long ones don't travel with each of their keys."""
    sides = []
    for rows, held in ((asks, False), (parts, True)):
        named = rows.select("kind", "seg", "word", F.xxhash64("word").alias("id"))
        sides.append(named.mapInArrow(lean(_shortenings(held)), "kind int, seg string, what int, place int, key long, id long"))
    met = sides[0].withColumnRenamed("id", "asks").join(sides[1].withColumnRenamed("id", "holds"), ["kind", "seg", "what", "place", "key"])
    both = parts.unionByName(asks).select("word", "n").distinct().withColumn("id", F.xxhash64("word"))
    named = met.select("kind", "asks", "holds").distinct().join(both.toDF("word", "n", "asks"), "asks").join(both.toDF("near", "near_n", "holds"), "holds")
    return named.select("kind", "word", "n", "near", "near_n").mapInArrow(_verify, _PAIRS)


def near_words(found: DataFrame, hot: int = HOT) -> DataFrame:
    """found(word, n), each word once -> (word, n, near, near_n): each word with every word near it."""
    parts, asks = segments(found), asked(found)
    crowded = durable(parts.groupBy("kind", "seg").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("kind", "seg"), "hotsegments")
    if crowded.isEmpty():
        return _by_automata(parts, asks)
    on = ["kind", "seg"]
    one = _by_automata(parts.join(crowded, on, "left_anti"), asks.join(crowded, on, "left_anti"))
    return one.unionByName(_by_shortening(parts.join(crowded, on, "left_semi"), asks.join(crowded, on, "left_semi")))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> (word, root), for words that have a form. Each round doubles how far a word has followed."""
    now = durable(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.agg(F.max("moved")).first()[0]:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = durable(now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        now = then
    return now.drop("moved")


def variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) -> word, form, root, n, n_near, form_n."""
    found = durable(words(docs), "words")
    pairs = near_words(found, hot)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near_ = durable(pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")), "nearwords")
    enough = -F.col("best.less") >= RATIO * F.col("n")
    formed = near_.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    named = roots(formed.where("form is not null"))
    out = found.join(formed, "word", "left").join(named, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: spelling variants among the words of all documents."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: DuckDB has no crc32: bytes meet a table of 256 numbers.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') AS w FROM documents),
runs AS (SELECT id, word, count(*) AS k FROM d, unnest(w) AS t(word) WHERE length(word) >= 6 GROUP BY 1, 2),
bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
hexed AS (SELECT *, hex(encode(id || ':' || word)) AS x FROM runs),
coded AS (SELECT *, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)) AS code FROM hexed),
crc AS (SELECT word, k, xor(list_reduce(code, lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295), 4294967295) AS h FROM coded, bits),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN left(word, CAST(h % length(word) AS INT)) || substr(word, CAST(h % length(word) AS INT) + 2) ELSE word END AS word, k FROM crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(generate_series(1, length(word))) AS t(i)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON b.word = a.rest UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON b.word = a.rest),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS step FROM v UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(here, step) AS root FROM walk GROUP BY word) r USING (word)
"""
