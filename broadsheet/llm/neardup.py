"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors are one class. Classes are dealt into blocks; each pair of blocks is a tile. In a tile, unit vectors are
quantised to int8 with a scale each, and their products bound the cosine: with u = s*q + e the true product differs from
s_u*s_v*(q_u.q_v) by at most |e_u|*(1 + |e_v|) + |e_v|. Only pairs that may reach the threshold are computed again, in
double precision on the original vectors. A tile returns link counts and a spanning forest, never its pairs.

Every pair of blocks is multiplied: the cosine of unclustered vectors has no exact index, so the work grows with the square
of the rows, spread evenly over tiles.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay;
vectors of different lengths don't link; repeated rows count as other vectors; rows with a null id return, without links to
report (component null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, forget, table
from .components import components
from .vectors import cosine_pairs, pack, unpacked, usable

#: Rows of a block, which goes to every other one, and of the pieces that are multiplied at a time.
BLOCK, PIECE = 8192, 2048
THRESHOLD = 0.9
#: Rounding of single-precision scales and products, on top of the bound.
FUZZ = 1e-5


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as whole numbers from -127 to 127, scales, and norms of what the quantisation leaves."""
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scale = np.abs(unit).max(1, keepdims=True) / 127
    q = np.rint(unit / scale).astype(np.int8)
    return q, scale[:, 0], np.linalg.norm(unit - q * scale, axis=1)


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of rows with cosine >= threshold."""
    (qa, sa, ea), (qb, sb, eb) = quantise(a), quantise(b)
    # whole numbers below 2**24 are exact in single precision, whose matrix product is the fast one
    kind = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T) * sa[:, None].astype(kind) * sb[None].astype(kind)
    need = threshold - FUZZ - ea[:, None] * (1 + eb[None]) - eb[None]
    i, j = np.nonzero(near >= need.astype(kind))
    keep = [cosine_pairs(a[i[k : k + 65536]], b[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least label reachable over pairs (i, j)."""
    label = label.copy()
    while True:
        m = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, m)
        np.minimum.at(label, j, m)
        if np.array_equal(before, label):
            return label


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    rows = durable(vectors.select("vec_id", "embedding", usable(F.col("embedding")).alias("ok")).withColumn("h1", F.when(F.col("ok"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), F.reverse("embedding")))), "vectors")
    classes = durable(rows.where("ok and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")), "classes")
    blocks = max(1, math.ceil(classes.count() / block))
    dealt = classes.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("len", F.size("embedding"))
    packed = durable(pack(dealt, ["len", "part"], "id", "embedding", ("copies",)), "blocks")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiles = packed.withColumn("other", other).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))

    def tile(t: pa.Table) -> pa.Table:
        sides = sorted(t.to_pylist(), key=lambda r: r["part"])
        ids: list = []
        if len(sides) == 2 or sides[0]["lo"] == sides[0]["hi"]:  # else the other block has no vectors of this length
            one, two = sides[0], sides[-1]
            d = one["dim"]
            ia, ib = unpacked(one, "id"), unpacked(two, "id")
            x, y = unpacked(one, "embedding", d), unpacked(two, "embedding", d)
            pairs = [np.stack(linked(x[p : p + PIECE], y[q : q + PIECE], threshold)) + [[p], [q]] for p in range(0, len(x), PIECE) for q in range(0, len(y), PIECE)]
            i, j = np.concatenate(pairs, 1)
            same = len(sides) == 1
            if same:
                i, j = i[i < j], j[i < j]
            at = len(ia) if not same else 0
            ids = np.concatenate([ia, ib]) if not same else ia
            copies = np.concatenate([unpacked(one, "copies"), unpacked(two, "copies")]) if not same else unpacked(one, "copies")
            links = np.bincount(i, copies[j + at], len(ids)) + np.bincount(j + at, copies[i], len(ids))
            label = forest(i, j + at, ids)
            on = np.flatnonzero(links)
            return pa.table({"id": ids[on], "links": links[on].astype(np.int64), "label": label[on]})
        return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label": pa.array([], pa.int64())})

    found = durable(tiles.groupBy("len", "lo", "hi").applyInArrow(tile, "id long, links long, label long"), "links")
    named = components(found.select(F.col("id").alias("u"), F.col("label").alias("v"))).select(F.col("node").alias("id"), "component")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = durable(classes.select("h1", "h2", "id", "copies").join(counts, "id", "left").join(named, "id", "left"), "known")
    forget(packed, found)
    out = rows.select("vec_id", "h1", "h2").join(known.select("h1", "h2", "copies", "links", F.coalesce("component", "id").alias("c")), ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0)))
    return out.select("vec_id", links.cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: near-duplicates among all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, coalesce(len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v WHERE ok),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) >= 0.9),
walk AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT w.root, p.b FROM walk w JOIN p ON p.a = w.node),
c AS (SELECT root, min(node) AS component_id FROM walk GROUP BY root),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.root = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
