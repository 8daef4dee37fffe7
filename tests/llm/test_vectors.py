"""The operators on embeddings against brute force, over odd rows."""

import numpy as np
import pytest

from broadsheet.llm import ann, neardup
from tests.llm import helpers


def rows(seed=0, n=500, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[: n // 2] = x[rng.integers(0, 12, n // 2)] + rng.normal(size=(n // 2, d)) * 0.12
    x[5] = x[6] = x[7]
    x[8] = 3 * x[7]
    out = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return out + [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [1.0, None] + [0.0] * (d - 2)), (n + 4, [float("inf")] + [0.0] * (d - 1)), (n + 5, []), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (20, out[20][1])]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, v, 0) for i, v in rows()], "vec_id long, embedding array<float>, label int").repartition(5)


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_near_duplicates(frame):
    got = neardup.near_duplicates(frame, block=64).collect()
    table = rows()
    arrays = [np.array(v, np.float64) if usable(v) else None for _, v in table]

    def linked(i, j):
        a, b = arrays[i], arrays[j]
        return a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9

    links: dict = {}
    for i, (k, _) in enumerate(table):
        links.setdefault(k, set()).add(sum(linked(i, j) for j in range(len(table)) if j != i))
    want = helpers.groups([k for k, _ in table], linked)
    assert len(got) == len(table)
    assert {r["vec_id"]: r["component_id"] for r in got} == want
    assert all(r["n_links"] in links[r["vec_id"]] and r["kept"] == (r["vec_id"] == want[r["vec_id"]]) for r in got)


def test_quantisation_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 33))
    (q, s, e), u = neardup.quantise(x), x / np.linalg.norm(x, axis=1, keepdims=True)
    true, near = u @ u.T, (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(true - near) <= e[:, None] * (1 + e[None]) + e[None] + 1e-9).all()


def test_hilbert_is_a_path():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    path = grid[np.argsort(ann.hilbert(grid, 3))]
    assert len(np.unique(ann.hilbert(grid, 3))) == side**3 and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("block", [40, 1024])
def test_neighbours(frame, block):
    got = ann.neighbours(frame, lambda i: i % 20 == 0, 20, block).collect()
    table = [(k, np.array(v, np.float64)) for k, v in dict((k, v) for k, v in rows() if usable(v)).items()]
    found: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, a in table:
        if q % 20:
            continue
        best = sorted(((-(a @ b), k) for k, b in table if k != q and len(a) == len(b)))[:20]
        assert np.allclose([s for _, s in found[q]], [-s for s, _ in best])
        assert [k for k, _ in found[q]] == [k for _, k in best] or len({round(s, 9) for s, _ in best}) < len(best)
    assert set(found) == {k for k, _ in table if k % 20 == 0}


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"], r["score"]) for r in ann.neighbours(df, lambda i: i == 0, 20).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 0.0)]


def test_windows_alone_find_most(spark):
    """The curves by themselves, before the bound check: nine tenths of the true neighbours of directions without clusters."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.neighbours(df, lambda i: i % 20 == 0, block=512, exact=False).collect()}
    products = x[::20] @ x.T
    products[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    want = {(20 * i, int(j)) for i in range(200) for j in np.argsort(-products[i])[:20]}
    assert len(got & want) >= 0.9 * len(want)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (20, [1.0, 2.1]), (None, [3.0, -1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.neighbours(df, lambda i: i % 20 == 0).collect()] == [(20, 1)]
    got = {r["vec_id"]: r["component_id"] for r in neardup.near_duplicates(df).where("vec_id is not null").collect()}
    assert got == {1: 1, 20: 1}
