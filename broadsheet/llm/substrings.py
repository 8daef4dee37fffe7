"""Removal of repeated substrings by column-wise suffix construction over many documents.

A byte goes if a SPAN-byte string that covers it also starts in a document of a smaller id. Bytes are UTF-8, matches never
cross documents, strings are judged on the input. Texts that are equal are one class; only the class of the least id is read.

1. anchors   Of every SPAN-byte window, the GRAM-byte string of least hash is its anchor (winnowing): equal windows have the
             same anchor at the same place, whatever surrounds them. Anchors meet by hash; those of two or more different
             texts are told to their texts.
2. contexts  Each shared anchor sends its surroundings, wide enough for all windows that chose it, to its bucket.
3. columns   A bucket builds the order of its contexts' suffixes column by column from the right, in every round putting one
             more symbol in front of each context: a stable distribution by that symbol of the order so far (as in a
             collection's Burrows-Wheeler transform), with longest common prefixes carried along. Windows that share SPAN
             bytes are then neighbours; the least id of each run decides.

The construction by columns over whole documents would need as many rounds as the longest document has bytes, each over
sequential files of all documents; anchors bring the same strings together in contexts of bounded width, so the rounds are
2*SPAN-GRAM at any size, and a bucket's columns fit in memory. What a task can settle by itself (equal contexts of a very
common passage) it answers at once and sends on only the occurrence of the least id, so no bucket grows with the number of
equal copies. A passage whose neighbours differ each time has a context of WIDTH bytes for each text at its edge anchors,
and these meet in one bucket.

Defined results: a null text is empty; rows without an id lose nothing and take nothing from others; rows that share an id
take nothing from each other; texts under SPAN bytes stay; very long texts are read whole, one at a time; an empty table
gives no rows; other columns are not read. Equal texts are told by a 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, flat, forget, mix, settle, spans, table, width
from .words import INVERSE, powers

SPAN, GRAM = 50, 20
REACH = SPAN - GRAM  # grams of a window: REACH + 1
WIDTH = SPAN + REACH
STEP = 1 << 20
FLUSH = 1 << 20
_U = np.uint64
_SIGN = mix(np.arange(3, 259, dtype=_U) * _U(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the rows in data: row, place, hash, and first and last window (places of their first bytes) of each anchor."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(data) - GRAM + 1
    if n <= REACH:
        return none
    p = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_SIGN[data] * p[: len(data)], out=total[1:])
    # a gram's sum, brought back to the powers from 0
    grams = mix((total[GRAM:] - total[:-GRAM]) * powers(n, INVERSE)[:n])
    # leftmost least of each window, by doubling: the hash's low bits give way to the place
    size = REACH + 1
    best = np.arange(n)
    done, low = 1, grams
    while done < size:
        step = min(done, size - done)
        m = len(low) - step
        right = low[step:] < low[:m]
        best = np.where(right, best[step:], best[:m])
        low = np.where(right, low[step:], low[:m])
        done += step
    # windows start anywhere a whole one fits into its row
    start = np.concatenate([np.arange(a, b - SPAN + 1) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if b - a >= SPAN] or [np.zeros(0, np.int64)])
    if not len(start):
        return none
    place = best[start]
    row = np.searchsorted(at, start, side="right") - 1
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(head[1:], len(start)) - 1
    return row[head], place[head], grams[place[head]], start[head], start[last]


def _rows(batch: pa.RecordBatch, name: str = "text"):
    data, at = flat(batch.column(name))
    for i, j in spans(at, STEP):
        yield i, data[at[i] : at[j]], at[i : j + 1] - at[i]


def _answers(k: np.ndarray, targets: int, *values: np.ndarray) -> pa.Table:
    """Answers to texts k as one row of packed columns for each target that has some: a row for each text would be many small ones."""
    to = np.mod(k, targets)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(targets + 1))
    on = [t for t in range(targets) if cuts[t] < cuts[t + 1]]
    packed = {n: pa.array([v[order[cuts[t] : cuts[t + 1]]].tobytes() for t in on], pa.binary()) for n, v in zip("kxy", (k, *values))}
    return pa.table({"target": pa.array(on, pa.int32()), **packed})


_SENT = "bucket int, direct boolean, a binary, b binary, c binary, d binary, e binary"
_SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("direct", pa.bool_()), *((x, pa.binary()) for x in "abcde")])


def _parcels(to: np.ndarray, buckets: int, direct: bool, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with its values packed."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    on = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    cols = [pa.array([v[order[cuts[b] : cuts[b + 1]]].tobytes() for b in on], pa.binary()) for v in values]
    cols += [pa.nulls(len(on), pa.binary())] * (5 - len(cols))
    return pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array([direct] * len(on), pa.bool_()), *cols], schema=_SENT_SCHEMA)


def shared_anchors(texts: DataFrame) -> DataFrame:
    """texts(k, text) -> (target, k, x): packed, texts and hashes of their anchors that other texts have too."""
    buckets = width(texts.sparkSession)

    def send(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            h, k = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
            h, k = h[fresh], k[fresh]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            many = np.repeat(np.diff(np.append(head, len(h))) > 1, np.diff(np.append(head, len(h))))
            if many.any():
                yield _parcels(np.mod(k[many], buckets), buckets, True, k[many], h[many])
            # of texts that share an anchor here, two stand for all: enough to tell any other text
            rank = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
            yield _parcels((h[rank < 2] % _U(buckets)).astype(np.int64), buckets, False, k[rank < 2], h[rank < 2], many[rank < 2])

        size = 0
        for b in batches:
            keys = b.column("k").to_numpy()
            for i, data, at in _rows(b):
                row, _, h, _, _ = anchors(data, at)
                if len(h):
                    held.append((h.astype(_U), keys[row + i]))
                    size += len(h)
                if size > FLUSH:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def gather(t: pa.Table) -> pa.Table:
        got = t.to_pylist()
        parts = [(np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], _U)) for r in got if r["direct"]]
        asks = [r for r in got if not r["direct"]]
        if asks:
            k, h, known = (np.concatenate([np.frombuffer(r[x], kind) for r in asks]) for x, kind in (("a", np.int64), ("b", _U), ("c", bool)))
            order = np.lexsort((k, h))
            k, h, known = k[order], h[order], known[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.append(head, len(h)))
            several = np.minimum.reduceat(k, head) != np.maximum.reduceat(k, head)
            on = np.repeat(several, size) & ~known
            parts.append((k[on], h[on]))
        k, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return _answers(k, buckets, h)

    return texts.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(gather, "target int, k binary, x binary")


def _together(texts: DataFrame, answers: DataFrame, columns: list[str], use, kinds: str) -> DataFrame:
    """use(key, row number, batch, x, y) for the first text of each key that has answers, in order of the columns; it returns a row or None.

    Both sides are dealt by the key's target; a target's answers come first and are held while its texts stream by.
    """
    targets = width(texts.sparkSession)
    t = {f.name: f.dataType for f in texts.schema}
    a = texts.select(F.pmod("k", F.lit(targets)).cast("int").alias("target"), F.lit(1).alias("side"), "k", *columns, *[F.lit(None).cast("binary").alias(c) for c in ("ks", "x", "y")])
    b = answers.select("target", F.lit(0).alias("side"), F.lit(None).cast("long").alias("k"), *[F.lit(None).cast(t[c]).alias(c) for c in columns], F.col("k").alias("ks"), "x", (F.col("y") if "y" in answers.columns else F.lit(None).cast("binary")).alias("y"))
    kinds_x, kinds_y = _U if "y" not in answers.columns else np.int64, np.uint32

    def run(batches):
        now, held, keys, xs, ys, last = None, [], None, None, None, None
        for batch in batches:
            target, side, ks = (batch.column(c).to_pylist() for c in ("target", "side", "k"))
            out = []
            for i in range(batch.num_rows):
                if target[i] != now:
                    now, held, keys, last = target[i], [], None, None
                if side[i] == 0:
                    held.append(tuple(batch.column(c)[i].as_py() for c in ("ks", "x", "y")))
                    continue
                if not held or ks[i] == last:
                    continue
                if keys is None:
                    keys, xs = np.frombuffer(b"".join(h[0] for h in held), np.int64), np.frombuffer(b"".join(h[1] for h in held), kinds_x)
                    order = np.argsort(keys, kind="stable")
                    keys, xs = keys[order], xs[order]
                    ys = np.frombuffer(b"".join(h[2] for h in held), kinds_y)[order] if held[0][2] is not None else None
                lo, hi = np.searchsorted(keys, [ks[i], ks[i]], side="left")[0], np.searchsorted(keys, ks[i], side="right")
                last = ks[i]
                if lo < hi and (row := use(ks[i], i, batch, xs[lo:hi], None if ys is None else ys[lo:hi])):
                    out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out)

    both = a.unionByName(b).repartition(targets, "target").sortWithinPartitions("target", "side", "k", *[c for c in columns if c != "text"])
    return both.mapInArrow(run, kinds)


def columns_order(text: np.ndarray, count: int):
    """For each column from count-1 down to 0 of fixed-width contexts: the order of suffixes from there, and common prefixes with the one before."""
    n, wide = text.shape
    order, lcp = np.arange(n), np.full(n, 255, np.uint8)
    lcp[:1] = 0
    for c in range(wide - 1, -1, -1):
        symbol = text[order, c]
        move = np.argsort(symbol, kind="stable")
        symbol = symbol[move]
        same = np.concatenate([[False], symbol[1:] == symbol[:-1]])
        # the least common prefix between two old places, for neighbours that now get the same symbol in front
        i = np.flatnonzero(same)
        fresh = np.zeros(n, np.uint8)
        if len(i):
            pairs = np.stack([move[i - 1] + 1, move[i] + 1], 1).ravel()
            low = np.minimum.reduceat(np.append(lcp, np.uint8(255)), pairs)[::2]
            fresh[i] = np.minimum(low, 254) + 1
        order, lcp = order[move], fresh
        if c < count:
            yield c, order, lcp


def resolve(text: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Bits of the windows of each context that a smaller document has: bit o is the window that starts o bytes before the anchor."""
    bits = np.zeros(len(doc), np.uint32)
    for c, order, lcp in columns_order(text, REACH + 1):
        o = REACH - c
        valid = (last[order] <= o) & (o <= first[order])
        head = np.flatnonzero(lcp < SPAN)
        d = np.where(valid, doc[order], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(d, head)
        less = np.repeat(least, np.diff(np.append(head, len(order)))) < d
        bits[order[valid & less]] |= np.uint32(1 << o)
    return bits


def repeated_windows(texts: DataFrame) -> DataFrame:
    """texts(k, doc_id, text, h) -> (target, k, x, y): packed, texts, places of anchors and bits of their windows that smaller documents have."""
    buckets = width(texts.sparkSession)

    def send(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def out():
            h, k, doc, place, ends, text = (np.concatenate(x) for x in zip(*held))
            held.clear()
            # equal contexts: the least document asks for all, the others have their answer
            code = mix(text.view(_U)[:, 0].copy())
            for c in range(1, text.shape[1] // 8):
                code = mix(code ^ text.view(_U)[:, c])
            order = np.lexsort((doc, code, ends))
            same = np.zeros(len(h), bool)
            a, b = order[:-1], order[1:]
            same[1:] = (ends[a] == ends[b]) & (text[a] == text[b]).all(1)
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
            later = same & (doc[order] > doc[order[head]])
            told, asks = order[later], order[~later]
            if len(told):
                first, last = ends[told] >> 8, ends[told] & 255
                bits = ((_U(1) << (first.astype(_U) + _U(1))) - (_U(1) << last.astype(_U))).astype(np.uint32)
                yield _parcels(np.mod(k[told], buckets), buckets, True, k[told], place[told], bits)
            yield _parcels((h[asks] % _U(buckets)).astype(np.int64), buckets, False, k[asks], place[asks], doc[asks], ends[asks], text[asks])

        size = 0
        for b in batches:
            keys, docs, known = b.column("k").to_numpy(), b.column("doc_id").to_numpy(), b.column("h")
            for i, data, at in _rows(b):
                row, place, h, start, end = anchors(data, at)
                if not len(h):
                    continue
                asked = [np.frombuffer(known[i + r].as_py(), _U) for r in range(len(at) - 1)]
                wanted = mix(np.concatenate(asked)) ^ np.repeat(np.arange(len(asked), dtype=_U), [len(x) for x in asked])
                on = np.isin(mix(h.astype(_U)) ^ row.astype(_U), wanted)
                row, place, h, start, end = row[on], place[on], h[on], start[on], end[on]
                if not len(h):
                    continue
                padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(WIDTH, np.uint8)])
                text = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[place].copy()
                at_ = np.arange(WIDTH) - REACH + place[:, None]
                text[(at_ < at[row][:, None]) | (at_ >= at[row + 1][:, None])] = 0
                # bytes that no window of the anchor covers don't count
                text[(at_ < start[:, None]) | (at_ >= (end + SPAN)[:, None])] = 0
                ends = ((place - start) << 8 | (place - end)).astype(np.uint16)
                held.append((h.astype(_U), keys[row + i], docs[row + i], (place - at[row]).astype(np.int64), ends, text))
                size += 4 * len(h)
                if size > FLUSH:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    def gather(t: pa.Table) -> pa.Table:
        got = t.to_pylist()
        parts = [(np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64), np.frombuffer(r["c"], np.uint32)) for r in got if r["direct"]]
        asks = [r for r in got if not r["direct"]]
        if asks:
            k, place, doc, ends, text = (np.concatenate([np.frombuffer(r[x], kind) for r in asks]) for x, kind in (("a", np.int64), ("b", np.int64), ("c", np.int64), ("d", np.uint16), ("e", np.uint8)))
            bits = resolve(text.reshape(-1, WIDTH), doc, (ends >> 8).astype(np.int64), (ends & 255).astype(np.int64))
            on = bits > 0
            parts.append((k[on], place[on], bits[on]))
        k, place, bits = (np.concatenate([p[x] for p in parts]) for x in range(3))
        return _answers(k, buckets, place, bits)

    return texts.mapInArrow(send, _SENT).groupBy("bucket").applyInArrow(gather, "target int, k binary, x binary, y binary")


def covered(n: int, place: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of a text's n bytes the windows cover."""
    mark = np.zeros(n + 1, np.int32)
    for o in range(REACH + 1):
        start = place[(bits >> np.uint32(o)) & 1 > 0] - o
        np.add.at(mark, start, 1)
        np.add.at(mark, start + SPAN, -1)
    return np.cumsum(mark[:-1]) > 0


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (k, gone): for each class of texts that loses some bytes as the document of its least id, runs of (start, end) packed."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and octet_length(text) >= 50").select(F.xxhash64("text").alias("k"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = durable(shared_anchors(rows.select("k", "text")), "anchors")
    settle(spark)

    def joined(k, i, batch, hashes, _):
        return {"k": k, "doc_id": batch.column("doc_id")[i].as_py(), "text": batch.column("text")[i].as_py(), "h": hashes.tobytes()}

    # of equal texts the one of the least id comes first
    texts = durable(_together(rows, told, ["doc_id", "text"], joined, "k long, doc_id long, text string, h binary"), "texts")
    forget(told)
    settle(spark)
    found = durable(repeated_windows(texts), "windows")
    settle(spark)

    def runs(k, i, batch, place, bits):
        raw = np.frombuffer(batch.column("text")[i].as_buffer(), np.uint8)
        on = covered(len(raw), place, bits)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
        return {"k": k, "runs": edge.astype(np.int64).tobytes(), "n_removed": int(on.sum()), "n_spans": len(edge) // 2, "kept_sha256": hashlib.sha256(raw[~on].tobytes()).hexdigest()}

    out = durable(_together(texts.select("k", "text"), found, ["text"], runs, "k long, runs binary, n_removed long, n_spans long, kept_sha256 string"), "runs")
    forget(texts, found)
    settle(spark)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what is left of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    slim = durable(docs.select("doc_id", F.xxhash64("text").alias("k"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")), "slim")
    runs = cut_texts(docs)
    least = slim.where("doc_id is not null").groupBy("k").agg(F.min("doc_id").alias("least"))
    known = durable(least.join(runs.drop("runs"), "k", "left"), "known")
    rows = slim.join(known, "k", "left")
    whole = F.coalesce((F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= SPAN), F.lit(False))
    own = (F.col("doc_id") == F.col("least")) & F.col("n_removed").isNotNull()
    pick = lambda all_, some, none: F.when(whole, all_).when(own, some).otherwise(none)
    return rows.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
    )
