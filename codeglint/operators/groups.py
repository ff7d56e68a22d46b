"""Graphs whose edges stay within groups: small groups are solved where they are, a task streams over its groups; the rest is left to rounds of joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import nsmallest
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship
from ..storage import stored
from .joins import small

#: Edges of a group that is solved by one task, and rows of a batch that a task gives.
GROUP_EDGES, BATCH = 256, 10_000


def parted(edges: DataFrame, group: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst, group) of small groups, and (src, dst) of the rest or None.  group gives the group of a node.

    The rest are groups of more than GROUP_EDGES edges and those that an edge joins with another, so no path leaves either table.
    """
    a, b = group(F.col("src")), group(F.col("dst"))
    every = stored(edges.select("src", "dst", a.alias("group"), F.when(~a.eqNullSafe(b), F.struct(b.alias("other"))).alias("across")), "edges")
    large = every.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_EDGES).select("group")
    across = every.filter("across is not null").select(F.explode(F.array("group", "across.other")).alias("group"))
    open_ = stored(large.union(across).union(every.filter("group is null").select("group")).distinct(), "open-groups")
    every = every.select("src", "dst", "group")
    if open_.isEmpty():
        return every, None
    named = small(open_.withColumnRenamed("group", "open"))
    same = F.col("group").eqNullSafe(F.col("open"))
    return every.join(named, same, "left_anti"), every.join(named, same, "left_semi").select("src", "dst").distinct()


def solved(groups: DataFrame, solve: Callable[[dict], Iterator[tuple]], schema: StructType) -> DataFrame:
    """Rows that solve gives for each group of groups (src, dst, group), from its ascending callees by node."""
    ship(groups.sparkSession)
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, out = None, {}
        for batch in batches:
            for g, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if g != now:
                    if out:
                        yield from solve(out)
                    now, out = g, {}
                callees = out.setdefault(a, [])
                if not callees or callees[-1] != b:
                    callees.append(b)
        if out:
            yield from solve(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while part := list(islice(found, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), arrow.types)], schema=arrow)

    return groups.select("group", "src", "dst").repartition("group").sortWithinPartitions("group", "src", "dst").mapInArrow(run, schema)


def strong_layers(callees: dict) -> Iterator[tuple]:
    """(node, component, layer): components of nodes that reach each other, by their smallest node, and layers of the graph of components."""
    nodes = sorted({*callees, *(b for x in callees.values() for b in x)})
    bit = {x: 1 << i for i, x in enumerate(nodes)}
    reach = [sum(bit[b] for b in callees.get(x, ())) for x in nodes]
    for k in range(len(nodes)):
        through = reach[k]
        reach = [r | through if r >> k & 1 else r for r in reach]
    # the nodes that each is reached by
    back = [sum(1 << j for j, r in enumerate(reach) if r >> i & 1) for i in range(len(nodes))]
    needs = [b & ~r for b, r in zip(back, reach)]
    layer, placed, n = [0] * len(nodes), 0, 0
    left = list(range(len(nodes)))
    while left:
        ready = [i for i in left if not needs[i] & ~placed]
        for i in ready:
            layer[i] = n
        placed, n = placed | sum(1 << i for i in ready), n + 1
        left = [i for i in left if not placed >> i & 1]
    for i, x in enumerate(nodes):
        both = reach[i] & back[i] | 1 << i
        yield x, nodes[(both & -both).bit_length() - 1], layer[i]


def first_shortest(callees: dict) -> Iterator[tuple]:
    """(src, dst, path): the shortest path of each pair, of several the first by nodes."""
    for a, direct in callees.items():
        now, met = [[a, b] for b in direct], set(direct)
        while now:
            longer = []
            for path in now:
                yield a, path[-1], path
                for b in callees.get(path[-1], ()):
                    if b not in met:
                        met.add(b)
                        longer.append([*path, b])
            now = longer


def longest_paths(edges: int, limit: int) -> Callable[[dict], Iterator[tuple]]:
    """Solves to (src, dst, path): simple paths of up to so many edges that none begins with, the longest `limit` of each source, then by text."""

    def grown(callees: dict, path: list) -> Iterator[list]:
        more = [b for b in callees.get(path[-1], ()) if b not in path] if len(path) <= edges else []
        for b in more:
            yield from grown(callees, [*path, b])
        if not more and len(path) > 1:
            yield path

    def solve(callees: dict) -> Iterator[tuple]:
        for a in callees:
            for path in nsmallest(limit, grown(callees, [a]), key=lambda x: (-len(x), ">".join(map(str, x)).encode())):
                yield a, path[-1], path

    return solve
