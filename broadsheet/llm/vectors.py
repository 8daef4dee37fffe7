"""What the two operators on embeddings share: which vectors take part, and packing rows into blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, no component null or non-finite."""
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column, all of one length, in double precision."""
    return np.concatenate([np.asarray(c.flatten(), np.float64).reshape(-1, dim) for c in column.chunks] or [np.zeros((0, dim))])


def pack(rows: DataFrame, keys: list[str], ids: str, vectors: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each value of keys: n, dim, ids (int64), vectors (as precise as the input) and extra int64 columns as bytes, in order of ids."""
    names = [*keys, "n", "dim", ids, vectors, *extra]
    kind = np.float32 if rows.schema[vectors].dataType.elementType.simpleString() == "float" else np.float64

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table[ids].to_numpy(), kind="stable")
        dim = len(table[vectors][0])
        m = matrix(table[vectors], dim)[order]
        out = {k: table[k].slice(0, 1) for k in keys} | {"n": [len(m)], "dim": [dim], ids: [table[ids].to_numpy()[order].astype(np.int64).tobytes()], vectors: [m.astype(kind).tobytes()]}
        out |= {e: [table[e].to_numpy()[order].astype(np.int64).tobytes()] for e in extra}
        return pa.table(out).select(names)

    kinds = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), "n long", "dim long", f"{ids} binary", f"{vectors} binary", *(f"{e} binary" for e in extra)])
    return rows.select(*keys, ids, vectors, *extra).groupBy(*keys).applyInArrow(one, kinds)


def unpacked(row: dict, name: str, dim: int | None = None) -> np.ndarray:
    """A packed column of a row as numbers, or as vectors in double precision where dim is given."""
    if dim is None:
        return np.frombuffer(row[name], np.int64)
    single = 8 * len(row[name]) == 4 * dim * len(row["id"])
    return np.frombuffer(row[name], np.float32 if single else np.float64).reshape(-1, dim).astype(np.float64)


def cosine_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of a's rows with b's, pair by pair, in double precision."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
