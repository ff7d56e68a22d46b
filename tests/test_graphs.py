"""Paths and components of random graphs against brute force."""

import random

import pytest

from codeglint.operators import graph as G


def made(seed, n, m):
    draw = random.Random(seed)
    return sorted({(draw.randrange(n), draw.randrange(n)) for _ in range(m)})


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        reach[a] = seen
    return reach


@pytest.mark.parametrize("seed,n,m", [(1, 12, 14), (2, 12, 30), (3, 40, 45), (4, 5, 25), (5, 30, 3)])
def test_strongly_connected(spark, seed, n, m):
    edges = made(seed, n, m)
    df = spark.createDataFrame(edges, "src int, dst int")
    reach = closure(edges)
    want = {a: min([a] + [b for b in reach[a] if a in reach[b]]) for a in reach}
    got = {r.node: r for r in G.condensed_layers(df).collect()}
    assert {a: r.component for a, r in got.items()} == want
    for a, b in edges:
        assert got[a].layer < got[b].layer or want[a] == want[b]
    for a, r in got.items():
        before = [got[x].layer for x, y in edges if want[y] == want[a] and want[x] != want[a]]
        assert r.layer == max(before, default=-1) + 1


@pytest.mark.parametrize("seed,k,longest", [(1, 2, 4), (2, 5, 6), (3, 1, 5)])
def test_first_paths(spark, seed, k, longest):
    edges = made(seed, 9, 30)
    df = spark.createDataFrame(edges, "src int, dst int")
    s, t = spark.createDataFrame([(0,), (1,), (2,)], "src int"), spark.createDataFrame([(2,), (5,), (8,)], "dst int")
    want = G.simple_paths(df, longest, s, t, k).collect()
    assert sorted((r.src, r.dst, r.path, r.n) for r in G.first_paths(df, longest, s, t, k).collect()) == sorted((r.src, r.dst, r.path, r.n) for r in want)


def test_no_edges(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert G.condensed_layers(none).collect() == [] and G.strongly_connected(none).collect() == []
    one = spark.createDataFrame([(1, 1)], "src int, dst int")
    assert [tuple(r) for r in G.condensed_layers(one).collect()] == [(1, 1, 0)]
    assert G.first_paths(none, 3, none.select("src"), none.select("dst"), 2).collect() == []
