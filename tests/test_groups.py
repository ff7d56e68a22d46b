"""Graphs in groups against the rounds of joins over the whole."""

import pytest

from codeglint.operators import graph as G
from codeglint.operators import groups
from codeglint.operators import integration as I

from test_graphs import made


def many(cross):
    """Small groups, one of more than ten edges, and, if asked for, groups that an edge joins."""
    out = [(100 * g + a, 100 * g + b) for g in range(12) for a, b in made(g, 5, 8)] + [(1300 + a, 1300 + b) for a, b in made(9, 8, 20)] + [(1400, 1400), (1501, 1500), (1501, 1500)]
    return out + [(101, 202), (202, 303), (1301, 402)] * cross


@pytest.mark.parametrize("cross, most", [(0, 1000), (1, 10)])
def test_groups_equal_the_whole(spark, monkeypatch, cross, most):
    monkeypatch.setattr(groups, "GROUP_EDGES", most)
    df = spark.createDataFrame(many(cross), "src int, dst int")
    module = lambda n: n - n % 100
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    near, far = groups.parted(df, module)
    assert near.count() > 0 and (far is None) == (not cross and most == 1000)
    assert rows(G.strong_layers_in(df, module)) == rows(G.condensed_layers(df))
    assert rows(G.shortest_paths_in(df, module)) == rows(G.shortest_paths(df))
    assert rows(I.maximal_paths_in(df, module, 3, 2)) == rows(I.maximal_paths(G.simple_paths(df, 3), 2))


def test_no_groups(spark):
    none, module = spark.createDataFrame([], "src int, dst int"), lambda n: n - n % 100
    assert G.strong_layers_in(none, module).collect() == G.shortest_paths_in(none, module).collect() == I.maximal_paths_in(none, module, 3, 2).collect() == []
