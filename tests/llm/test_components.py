import random

import pytest

from broadsheet.llm import components as c
from tests.llm import helpers


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(c, "FEW", few)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + rng.randrange(1, 80)) for _ in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(500, 500), (-5, 7), (7, -5)]
    ids = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    want = helpers.groups(ids, lambda i, j: frozenset((ids[i], ids[j])) in linked)
    got = {r["node"]: r["component"] for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k != 500}
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0
