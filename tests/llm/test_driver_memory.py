"""What the driver must not be loaded with: a query for each step, where a few edges can be joined at once."""

import random

import pytest

from siftwright.llm import common


def _edges(kind):
    rng = random.Random(7)
    if kind == "path":
        return [(i + 1, i) for i in range(200)]
    if kind == "star":
        return [(-5, i) for i in range(300)]
    if kind == "empty":
        return [(3, 3), (None, 1)]
    return [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)]


def _expected(edges):
    up = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a in up and b in up:
            one, two = sorted((root(a), root(b)))
            up[two] = one
    return sorted((x, root(x)) for x in up if root(x) != x)


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
@pytest.mark.parametrize("most", [100_000, 0])
def test_components_of_few_edges_take_one_table(spark, monkeypatch, kind, most):
    made = []
    write = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: made.append(name) or write(df, name))
    monkeypatch.setattr(common, "EDGES", most)
    edges = _edges(kind)
    got = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.select("node", "component").collect())) == _expected(edges)
    if most:
        assert made == ["components"]
    elif kind == "path":
        assert made.count("stars") > 1
