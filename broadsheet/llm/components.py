"""Connected components of an edge table: alternating stars, or one task for few edges; nothing but counts reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


#: Up to so many edges (16 bytes each) a single task joins them in memory; each distributed round costs several small jobs.
FEW = 1_000_000


def _in_one_task(t: pa.Table) -> pa.Table:
    nodes, at = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
    i, j = at[: len(t)], at[len(t) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        # a link lowers the labels of both labels, then every node takes its label's label
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return pa.table({"node": nodes, "component": nodes[label]})


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, component) for every node that has an edge to another; component is the least node reachable.

    Large stars hang a node's larger neighbours on its least neighbour, small stars its smaller ones and itself; both keep
    components and end in stars after a number of rounds that grows with the logarithm of the size. A hub's edges are
    dealt by the join, whose two sides are plain shuffles of written tables, so that the engine may split it. FEW edges
    or less take one task instead, with the same result.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    if mark[0] <= FEW:
        return now.groupBy(F.lit(0).alias("all")).applyInArrow(_in_one_task, "node long, component long")
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = durable(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = durable(small.unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(now, least, large, least2)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
