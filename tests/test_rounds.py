"""Searches in rounds that serve several graphs or both directions at once; exports that no task holds whole."""

from codeglint.operators import graph as G
from codeglint.sources import sinks


def test_masked_distances_are_those_of_each_graph(spark):
    edges = [(1, 2, 3), (2, 3, 1), (1, 4, 2), (4, 3, 2), (3, 5, 3), (5, 1, 2), (3, 6, 2)]
    e = spark.createDataFrame(edges, "src int, dst int, mask int")
    starts = spark.createDataFrame([(1,), (5,)], "src int")
    for depth, unbounded in ((None, 0), (2, 2)):
        got = G.masked_distances(e, starts, depth, unbounded).collect()
        for bit in (1, 2):
            most = None if unbounded & bit else depth
            want = {tuple(r) for r in G.distances(e.filter(f"mask & {bit} <> 0"), most, starts).select("src", "dst", "depth").collect()}
            assert {(r.src, r.dst, r.depth) for r in got if r.mask & bit} == want


def test_impact_needs_one_search_where_all_are_starts(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    n, search = [], G.distances
    monkeypatch.setattr(G, "distances", lambda *a: n.append(1) or search(*a))
    whole = {tuple(r) for r in G.impact_scope(e, spark.createDataFrame([(i,) for i in range(1, 6)], "node int"), 2).collect()}
    assert len(n) == 1 and whole == {(1, 2, 2, 2), (2, 3, 2, 3), (3, 3, 2, 3), (4, 2, 2, 0), (5, 0, 0, 0)}
    some = {tuple(r) for r in G.impact_scope(e, spark.createDataFrame([(1,), (4,)], "node int"), 2).collect()}
    assert len(n) == 3 and some == {x for x in whole if x[0] in (1, 4)}


def test_exports_are_ordered_files(spark, tmp_path):
    e = spark.range(20000).selectExpr("id AS src", "id + 1 AS dst").repartition(4)
    for write in (sinks.graph_gexf, sinks.graph_dot):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        write(e, str(tmp_path / write.__name__))
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        parts = sorted((tmp_path / write.__name__).glob("part-*"))
        lines = [x for p in parts for x in p.read_text().splitlines()]
        assert len(parts) > 1 and lines[0].startswith(("<gexf", "digraph")) and lines[-1] in ("</graph></gexf>", "}")
        assert len(lines) == (20001 + 20000 + 6 if write is sinks.graph_gexf else 20002)
