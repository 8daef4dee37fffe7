"""Nearest neighbours by largest inner product over shifted space-filling curves.

1. Each vector's direction is projected onto a few random axes, once for each of CURVES curves, shifted, and numbered along
   a Hilbert curve. Ranges of these numbers, cut at quantiles of a bounded sample of SAMPLE rows, are blocks of about BLOCK
   rows; a block with far more (many near-equal vectors) is split into chunks by hash.
2. On every curve a query meets its own block and the two beside it, reranks by exact inner products, and the windows of
   all curves merge: that gives each query k candidates and a floor, the k-th best product so far.
3. Windows alone can't promise a recall: it falls as blocks become more, where directions have no clusters. Blocks of the
   first curve therefore keep their centre and radius; |q|*radius + q.centre bounds what a block can offer, and a query goes
   on to every block whose bound reaches its floor. The stated query set meets the rows in blocks; the result is exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a
null id; vectors of other lengths are no candidates of a query, and an empty table gives no rows; rows that share an id are one candidate (the larger
product) and never their own; ties go to the smaller id; fewer candidates than k are all returned; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, forget, table
from .vectors import matrix, pack, unpacked, usable

CURVES, AXES, BITS, BLOCK, SAMPLE, QUERIES = 8, 6, 8, 1024, 20_000, 512


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along a Hilbert curve of rows of whole coordinates below 2**bits (Skilling's transform)."""
    c = [x[:, i].astype(np.int64) for i in range(x.shape[1])]
    n, q = len(c), 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (c[i] & q) != 0
            t = np.where(on, 0, (c[0] ^ c[i]) & p)
            c[0] = np.where(on, c[0] ^ p, c[0] ^ t)
            if i:
                c[i] = c[i] ^ t
        q >>= 1
    for i in range(1, n):
        c[i] = c[i] ^ c[i - 1]
    t, q = np.zeros_like(c[0]), 1 << bits - 1
    while q > 1:
        t = np.where(c[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((c[i] ^ t) >> b & 1)
    return key


def curve_keys(x: np.ndarray, curve: int) -> np.ndarray:
    """Place of each row on one of the shifted curves."""
    rng = np.random.default_rng([curve, x.shape[1]])
    axes, shift = rng.normal(size=(x.shape[1], AXES)), rng.random(AXES)
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    share = 1 / (1 + np.exp(-1.7 * (unit @ axes)))
    return hilbert(np.minimum((share + shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def _best(scores: np.ndarray, floor: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of what may be among a row's k best and isn't below its floor; ties stay in."""
    other = ids[None] != own[:, None]
    scores = np.where(other, scores, -np.inf)
    least = floor if scores.shape[1] <= k else np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
    slack = 1e-12 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
    return np.nonzero((scores >= (least - slack)[:, None]) & other)


def _top(q: np.ndarray, c: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Places of each q's k best among different c, ties to the smaller c."""
    order = np.lexsort((-v, c, q))
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[order][1:] != q[order][:-1]) | (c[order][1:] != c[order][:-1])
    order = order[fresh]
    order = order[np.lexsort((c[order], -v[order], q[order]))]
    head = np.ones(len(order), bool)
    head[1:] = q[order][1:] != q[order][:-1]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return order[rank < k]


def _meet(k: int, bounded: bool):
    """A group: one row of candidates (side 0) and some of queries (side 1)."""

    def run(t: pa.Table) -> pa.Table:
        sides = t.to_pylist()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for c in (r for r in sides if r["side"] == 0):
            ids, x = unpacked(c, "id"), unpacked(c, "embedding", c["dim"])
            centre = x.mean(0)
            radius = np.sqrt(np.square(x - centre).sum(1).max())
            for q in (r for r in sides if r["side"] == 1):
                own, y = unpacked(q, "id"), unpacked(q, "embedding", q["dim"])
                floor = np.frombuffer(q["floor"], np.float64) if bounded else np.full(len(own), -np.inf)
                if bounded:
                    on = y @ centre + np.linalg.norm(y, axis=1) * radius * (1 + 1e-9) + 1e-12 >= floor
                    own, y, floor = own[on], y[on], floor[on]
                if not len(own):
                    continue
                # rows of one id stand next to each other; they are one candidate, with the largest product
                names, first = np.unique(ids, return_index=True)
                i, j = _best(np.maximum.reduceat(y @ x.T, first, axis=1), floor, names, own, k)
                if len(names) < len(ids):
                    size = np.diff(np.append(first, len(ids)))[j]
                    start = np.repeat(first[j] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                    i, j = np.repeat(i, size), start + np.arange(size.sum())
                else:
                    j = first[j]
                v = np.concatenate([np.einsum("ij,ij->i", y[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
                keep = _top(own[i], ids[j], v, k)
                out.append((own[i][keep], ids[j][keep], v[keep]))
        return pa.table({n: np.concatenate([o[a] for o in out]) for a, n in enumerate(("query_id", "vec_id", "score"))})

    return run


_FOUND = "query_id long, vec_id long, score double"


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all its windows."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, queries, k: int = 20, block: int = BLOCK, exact: bool = True) -> DataFrame:
    """vectors(vec_id, embedding); queries: a condition on vec_id. Returns query_id, rank, vec_id, score; without exact, what the windows alone find."""
    rows = durable(vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), "embedding", F.size("embedding").alias("len")), "vectors")
    total = rows.count()
    blocks = max(1, math.ceil(total / block))

    def keyed(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            dims = t["len"].to_numpy()
            keys = np.zeros((len(dims), CURVES), np.int64)
            for d in np.unique(dims):
                on = np.flatnonzero(dims == d)
                x = matrix(t["embedding"].take(pa.array(on)), int(d))
                for c in range(CURVES):
                    keys[on, c] = curve_keys(x, c)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(keys[:, c]) for c in range(CURVES))], [*b.schema.names, *(f"k{c}" for c in range(CURVES))])

    kind = rows.schema["embedding"].dataType.simpleString()
    named = f"id long, embedding {kind}, len int, " + ", ".join(f"k{c} long" for c in range(CURVES))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).mapInArrow(keyed, named).select("len", *(f"k{c}" for c in range(CURVES))).toArrow()
    cuts: dict = {}
    lens = sample["len"].to_numpy()
    for d in np.unique(lens):
        some = [np.sort(sample[f"k{c}"].to_numpy()[lens == d]) for c in range(CURVES)]
        want = max(1, math.ceil(blocks * (lens == d).mean()))
        cuts[int(d)] = [s[np.linspace(0, len(s), want, endpoint=False).astype(int)[1:]] for s in some]

    def dealt(batches):
        for b in batches:
            dims = b.column("len").to_numpy()
            for c in range(CURVES):
                keys, at = b.column(f"k{c}").to_numpy(), np.zeros(b.num_rows, np.int32)
                for d in np.unique(dims):
                    if int(d) in cuts:
                        at[dims == d] = np.searchsorted(cuts[int(d)][c], keys[dims == d], side="right")
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("embedding"), b.column("len"), pa.array(np.full(b.num_rows, c, np.int32)), pa.array(at)], ["id", "embedding", "len", "curve", "block"])

    spread = rows.mapInArrow(keyed, named).mapInArrow(dealt, f"id long, embedding {kind}, len int, curve int, block int")
    spread = durable(spread, "curves")
    place = ["len", "curve", "block"]
    sizes = durable(spread.groupBy(*place).agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("chunks")), "chunks")
    chunked = spread.join(sizes, place).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    cands = durable(pack(chunked, [*place, "chunk"], "id", "embedding"), "candidates")
    asks = durable(pack(chunked.where(queries(F.col("id"))), [*place, "chunk"], "id", "embedding"), "queries")
    # a query row goes to its block and the ones beside it, and there to every chunk; the candidates follow the queries
    near = asks.withColumnRenamed("chunk", "group").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    near = near.join(sizes, place).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    wanted = near.select(*place, "chunk", "group").distinct()
    both = near.withColumn("side", F.lit(1)).unionByName(cands.join(wanted, [*place, "chunk"]).withColumn("side", F.lit(0)))
    first = durable(_merged(both.groupBy(*place, "chunk", "group").applyInArrow(_meet(k, False), _FOUND), k), "windows")
    if not exact:
        return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    # what the windows can't rule out
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = rows.where(queries(F.col("id"))).join(floors, F.col("id") == F.col("query_id"), "left")
    groups = max(1, math.ceil(asked.count() / QUERIES))
    asked = asked.select("id", "embedding", "len", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"))

    def with_floor(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        d = t["len"][0].as_py()
        return pa.table({"len": t["len"].slice(0, 1), "group": t["group"].slice(0, 1), "dim": [d], "id": [t["id"].to_numpy()[order].tobytes()], "embedding": [matrix(t["embedding"], d)[order].tobytes()], "floor": [t["floor"].to_numpy()[order].tobytes()]})

    later = durable(asked.groupBy("len", "group").applyInArrow(with_floor, "len int, group int, dim long, id binary, embedding binary, floor binary"), "floors")
    home = cands.where("curve = 0")
    tiles = home.select("len", "block", "chunk").join(later.select("len", "group"), "len")
    side0 = home.join(tiles, ["len", "block", "chunk"]).select("len", "block", "chunk", "group", "dim", "id", "embedding", F.lit(None).cast("binary").alias("floor"), F.lit(0).alias("side"))
    side1 = later.join(tiles, ["len", "group"]).select("len", "block", "chunk", "group", "dim", "id", "embedding", "floor", F.lit(1).alias("side"))
    rest = side0.unionByName(side1).groupBy("len", "block", "chunk", "group").applyInArrow(_meet(k, True), _FOUND)
    out = durable(_merged(first.select("query_id", "vec_id", "score").unionByName(rest), k), "neighbours")
    forget(rows, spread, sizes, cands, asks, first, later)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the 20 nearest of every vector whose id is divisible by 20, among all others."""
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE coalesce(len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false)),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
