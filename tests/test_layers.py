"""Layers of any graph against plain Python."""

import random

import pytest

from loomgraph.operators import graph, layers


def plain(names, links):
    """By reach."""
    out = {n: {b for a, b in links if a == n and b in names and b != n} for n in names}
    reach = {n: set() for n in names}
    for n in names:
        todo = list(out[n])
        while todo:
            x = todo.pop()
            if x not in reach[n]:
                reach[n].add(x)
                todo += out[x]
    of = {n: min({n} | {x for x in reach[n] if n in reach[x]}) for n in names}
    level = {}

    def place(c):
        if c not in level:
            level[c] = 1 + max((place(of[b]) for n in names if of[n] == c for b in out[n] if of[b] != c), default=-1)
        return level[c]

    return {n: (place(of[n]), of[n] if n in reach[n] and len([x for x in names if of[x] == of[n]]) > 1 else None) for n in names}


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 14, 16), (2, 12, 30), (3, 16, 12)])
def test_layers_against_reach(spark, seed, n, m):
    rng = random.Random(seed)
    names = [f"n{k:02}" for k in range(n)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(m)] + [("n01", "n01"), ("gone", "n01"), ("n02", "gone")]
    links += links[:2]
    got = layers.layers(spark.createDataFrame([(x,) for x in names] + [("n00",)], "name string"), spark.createDataFrame(links, "src string, dst string"))
    assert {r["name"]: (r["level"], r["cycle"]) for r in got.collect()} == plain(names, links) and got.count() == n


def test_layers_without_circles_and_of_nothing(spark):
    """As the layers of a picture's few places, where those are defined."""
    rng = random.Random(5)
    names = [f"n{k}" for k in range(9)]
    links = [(names[a], names[b]) for a in range(9) for b in range(a) if rng.random() < 0.3]
    edges = spark.createDataFrame(links, "src string, dst string")
    got = layers.layers(spark.createDataFrame([(x,) for x in names], "name string"), edges)
    assert {r["name"]: r["level"] for r in got.collect()} == graph.layers(names, links) and got.filter("cycle is not null").isEmpty()
    assert layers.layers(spark.createDataFrame([], "name string"), edges).count() == 0
    assert [tuple(r) for r in layers.layers(spark.createDataFrame([("x",)], "name string"), edges.limit(0)).collect()] == [("x", 0, None)]
