"""Graphs as edge tables (src, dst): reachability, paths, components, cycles, layers.

Loops run on the driver, one round of joins at a time over stored tables; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..functions.scoring import taint_effect, taint_start, taint_step
from ..storage import stored
from .groups import first_shortest, parted, solved, strong_layers


def distances(edges: DataFrame, max_depth: int | None, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst, depth): the least number of edges from src to dst, 1 to max_depth, or any with None; starts (src) limits the sources.

    A frontier is joined with the edges and stripped of pairs already known; the loop ends when nothing is new.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    first = edges if starts is None else edges.join(starts.select("src").distinct(), "src", "left_semi")
    frontier = stored(first.withColumn("depth", F.lit(1)), "frontier")
    parts = [frontier]
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for depth in count(2) if max_depth is None else range(2, max_depth + 1):
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        found = frontier.select("src", "dst").join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = stored(found.join(known, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def masked_distances(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, unbounded: int = 0) -> DataFrame:
    """(src, dst, mask, depth): distances() in several graphs in one search; mask has the bits of the graphs where the depth is the least.

    edges: src, dst and mask, the bits of the graphs that have the edge.  A pair meets an edge once for all graphs.  max_depth does not
    hold for the graphs of unbounded.
    """
    edges = stored(edges.select("src", "dst", "mask").filter("mask <> 0").groupBy("src", "dst").agg(F.bit_or("mask").alias("mask")), "edges")
    frontier = stored(edges.join(starts.select("src").distinct(), "src", "left_semi").withColumn("depth", F.lit(1)), "frontier")
    out, step = frontier, edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("mask").alias("_edge"))
    for depth in count(2):
        bits = F.col("mask").bitwiseAND(F.col("_edge"))
        bits = bits.bitwiseAND(F.lit(unbounded)) if max_depth is not None and depth > max_depth else bits
        found = frontier.join(step, "dst").select("src", F.col("next").alias("dst"), bits.alias("mask")).filter("mask <> 0").groupBy("src", "dst").agg(F.bit_or("mask").alias("mask"))
        known = out.groupBy("src", "dst").agg(F.bit_or("mask").alias("_known"))
        new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0))))
        frontier = stored(found.join(known, ["src", "dst"], "left").select("src", "dst", new.alias("mask")).filter("mask <> 0").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)


def nearest_start(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, depth): nodes that some start (src) reaches by one edge or more, and the least number of edges, however many.

    Only nodes are kept, not pairs, so every node and edge is met once.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    frontier = stored(edges.join(starts.select("src").distinct(), "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(1)), "frontier")
    out = frontier
    for depth in count(2):
        found = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = stored(found.join(out, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return out
        out = out.unionByName(frontier)


def reachable(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct (src, dst) joined by a path, of at most max_depth edges unless None."""
    return distances(edges, max_depth).select("src", "dst")


def simple_paths(edges: DataFrame, max_edges: int, sources: DataFrame | None = None, sinks: DataFrame | None = None, per_pair: int | None = None) -> DataFrame:
    """(src, dst, path, n): paths without repeated node, of 1 to max_edges edges, from sources (src) to sinks (dst).

    Grown edge by edge; with sinks, a partial path stays only if its end reaches one in the edges left, so that dead ends are
    not enumerated.  per_pair keeps the first so many by length, then nodes.
    """
    edges = stored(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    paths = edges if sources is None else edges.join(sources.select("src").distinct(), "src", "left_semi")
    paths = paths.withColumn("path", F.array("src", "dst"))
    goal = None if sinks is None else sinks.select(F.col("dst").alias("goal")).distinct()
    near = None if goal is None else stored(distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), max_edges, goal.select(F.col("goal").alias("src"))).groupBy(F.col("dst").alias("node")).agg(F.min("depth").alias("to_goal")), "to-goal")
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    done, now = [], stored(paths, "paths")
    for n in range(1, max_edges + 1):
        done.append(now)
        if n == max_edges:
            break
        ends = now if near is None else now.join(near.filter(F.col("to_goal") <= max_edges - n).select(F.col("node").alias("dst")), "dst", "left_semi")
        grown = ends.join(step, "dst").filter(~F.array_contains("path", F.col("next")))
        now = stored(grown.select("src", F.col("next").alias("dst"), F.concat("path", F.array("next")).alias("path")), "paths")
        if now.isEmpty():
            break
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    if goal is not None:
        out = out.join(goal.select(F.col("goal").alias("dst")), "dst", "left_semi").select("src", "dst", "path")
    out = out.withColumn("n", F.size("path").cast("long"))
    if per_pair is not None:
        rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy("n", "path"))
        out = out.withColumn("_rank", rank).filter(F.col("_rank") <= per_pair).drop("_rank")
    return out


def first_paths(edges: DataFrame, max_edges: int, sources: DataFrame, sinks: DataFrame, k: int) -> DataFrame:
    """(src, dst, path, n): the first k simple paths of each pair of a source (src) and a sink (dst), by length, then nodes.

    The result of simple_paths() with per_pair, without listing all: a round grows all paths by an edge, a pair that has its k
    paths is closed, and a path stays only while its end reaches the sink of an open pair in the edges left.
    """
    edges = stored(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    goals = sinks.select(F.col("dst").alias("src")).distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    # how far each node is from each sink that it reaches
    reach = stored(distances(back, max_edges, goals).select(F.col("dst").alias("node"), F.col("src").alias("goal"), "depth").filter("node <> goal"), "reach")
    wanted = stored(reach.join(sources.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("src"), "goal", F.lit(0).alias("have")), "wanted")
    now = edges.join(wanted.select("src").distinct(), "src", "left_semi").withColumn("path", F.array("src", "dst"))
    now, step, out = stored(now, "paths"), edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), None
    for n in range(1, max_edges + 1):
        place = F.row_number().over(Window.partitionBy("src", "dst").orderBy("path"))
        found = now.join(wanted.withColumnRenamed("goal", "dst"), ["src", "dst"]).withColumn("place", place).filter(F.col("place") <= k - F.col("have"))
        found = stored(found.select("src", "dst", "path"), "found")
        out = found if out is None else out.unionByName(found)
        if n == max_edges:
            break
        more = found.groupBy("src", F.col("dst").alias("goal")).agg(F.count(F.lit(1)).cast("int").alias("more"))
        wanted = wanted.join(more, ["src", "goal"], "left").select("src", "goal", (F.col("have") + F.coalesce("more", F.lit(0))).alias("have")).filter(F.col("have") < k)
        wanted = stored(wanted, "wanted")
        near = reach.filter(F.col("depth") <= max_edges - n).select(F.col("node").alias("dst"), "goal")
        ends = now.select("src", "dst").distinct().join(near, "dst").join(wanted, ["src", "goal"], "left_semi").select("src", "dst").distinct()
        grown = now.join(ends, ["src", "dst"]).join(step, "dst").filter(~F.array_contains("path", F.col("next")))
        now = stored(grown.select("src", F.col("next").alias("dst"), F.concat("path", F.array("next")).alias("path")), "paths")
        if now.isEmpty():
            break
    return out.withColumn("n", F.size("path").cast("long"))


def best_flows(flows: DataFrame) -> DataFrame:
    """(src, dst, n_paths, path, steps, level, risk): the shortest of each pair's flows (src, dst, path, n, level, risk), then the first by nodes."""
    first = F.min_by(F.struct("path", "n", "level", "risk"), F.struct("n", "path"))
    best = flows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_paths"), first.alias("b"))
    return best.select("src", "dst", "n_paths", "b.path", (F.col("b.n") - 1).cast("long").alias("steps"), "b.level", "b.risk")


def shortest_paths_in(edges: DataFrame, group: Callable[[Column], Column]) -> DataFrame:
    """shortest_paths() of a graph in groups: group gives a node's, most edges stay within one; paths of small groups are found without joins."""
    near, far = parted(edges, group)
    kind = near.schema["src"].dataType
    out = solved(near, first_shortest, StructType().add("src", kind).add("dst", kind).add("path", ArrayType(kind)))
    out = out.withColumn("n", F.size("path").cast("long"))
    return out if far is None else out.unionByName(shortest_paths(far))


def shortest_paths(edges: DataFrame, max_edges: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, path, n): one shortest path of each reachable pair, the first in the order of its nodes.

    Breadth first: a pair is met once, at its least depth, and keeps the least of the paths that reach it there, so work grows
    with the pairs and not with the paths between them.  A path of a node to itself is its shortest cycle.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges")
    first = edges if sources is None else edges.join(sources.select("src").distinct(), "src", "left_semi")
    frontier = stored(first.withColumn("path", F.array("src", "dst")), "shortest")
    step, out = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), frontier
    for _ in count(2) if max_edges is None else range(2, max_edges + 1):
        grown = frontier.join(step, "dst").select("src", F.col("next").alias("dst"), F.concat("path", F.array("next")).alias("path"))
        best = grown.join(out.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min("path").alias("path"))
        frontier = stored(best, "shortest")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out.withColumn("n", F.size("path").cast("long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected components, named by their smallest node."""
    now = stored(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "links")
    out = None
    while True:
        both = now.select("a", "b").union(now.select("b", "a"))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("p")), "parents")
        up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = stored(parent.join(up, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), "parents")
        if out is None:
            out = parent.withColumnRenamed("p", "component")
        else:
            lift = parent.select(F.col("node").alias("component"), "p")
            out = stored(out.join(lift, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "components")
        pa, pb = parent.select(F.col("node").alias("a"), F.col("p").alias("x")), parent.select(F.col("node").alias("b"), F.col("p").alias("y"))
        now = stored(now.join(pa, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if now.isEmpty():
            return out


def on_cycles(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, length): nodes that reach themselves, and their shortest cycle, of at most max_depth edges unless None."""
    return distances(edges, max_depth).filter("src = dst").select(F.col("src").alias("node"), F.col("depth").cast("long").alias("length"))


def layers(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(node, layer): a node's layer is one above its deepest prerequisite's; nodes of cycles share the last layer.

    dependencies: (src, dst), dst needs src.  Each round takes the nodes whose prerequisites are all placed.
    """
    left = stored(nodes.select("node").distinct(), "left")
    needs = stored(dependencies.select("src", "dst").filter("src <> dst").distinct(), "needs")
    placed, layer = None, 0
    while not left.isEmpty():
        waiting = needs.join(left.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        ready = left.join(waiting, "node", "left_anti")
        if ready.isEmpty():
            ready = left
        ready = stored(ready.withColumn("layer", F.lit(layer).cast("long")), "layer")
        placed = ready if placed is None else placed.unionByName(ready)
        left = stored(left.join(ready, "node", "left_anti"), "left")
        layer += 1
    return nodes.select("node").distinct().withColumn("layer", F.lit(0).cast("long")).limit(0) if placed is None else placed


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that are on no cycle by their ends: nodes without an edge in, or without one out, go until none does."""
    left = stored(edges, "core")
    n = left.count()
    while n:
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = stored(inner.join(inner.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "core")
        if (now := left.count()) == n:
            return left
        n = now
    return left


def strong_layers_in(edges: DataFrame, group: Callable[[Column], Column]) -> DataFrame:
    """condensed_layers() of a graph in groups: group gives a node's, most edges stay within one; small groups are solved without joins."""
    near, far = parted(edges, group)
    kind = near.schema["src"].dataType
    out = solved(near, strong_layers, StructType().add("node", kind).add("component", kind).add("layer", LongType()))
    return out if far is None else out.unionByName(condensed_layers(far))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other both ways share a component, named by its smallest node.

    Rounds of trimming, then colouring: every node left takes the smallest node that reaches it as its colour, along edges until
    nothing changes; the nodes that reach their colour's node backward within the colour are that node's component and go.
    Only nodes and edges are kept, never pairs of nodes that reach each other.
    """
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left, done = _trimmed(edges.select("src", "dst").filter("src <> dst").distinct()), None
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).distinct()
        colour = stored(nodes.withColumn("colour", F.col("node")), "colours")
        while True:
            sent = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("got"))
            now = stored(colour.join(sent, "node").select("node", F.least("colour", "got").alias("colour"), (F.col("got") < F.col("colour")).alias("changed")), "colours")
            colour = now.drop("changed")
            if now.filter("changed").isEmpty():
                break
        ends = colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("b"))
        inside = stored(left.join(ends[0], "src").join(ends[1], "dst").filter("a = b").select("src", "dst"), "coloured")
        frontier = stored(colour.filter("node = colour").select("node", F.col("colour").alias("component")), "component")
        found = frontier
        while not frontier.isEmpty():
            back = inside.join(frontier.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "component").distinct()
            frontier = stored(back.join(found, "node", "left_anti"), "component")
            found = found.unionByName(frontier)
        found = stored(found, "components")
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        left = _trimmed(left.select("src", "dst"))
    if done is None:
        return every.select("node", F.col("node").alias("component"))
    return every.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condensed_layers(edges: DataFrame) -> DataFrame:
    """(node, component, layer): the layers of the graph whose nodes are the components; it has no cycle, so every node has one."""
    named = stored(strongly_connected(edges), "strong")
    ends = named.select(F.col("node").alias("src"), F.col("component").alias("a")), named.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    between = edges.select("src", "dst").distinct().join(ends[0], "src").join(ends[1], "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    layer = layers(named.select(F.col("component").alias("node")), between)
    return named.join(layer.withColumnRenamed("node", "component"), "component").select("node", "component", "layer")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, in_centrality, out_centrality); centrality is the degree by the number of other nodes."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select("dst", F.lit(1), F.lit(0)))
    d = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = d.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("others"))
    return d.join(F.broadcast(n)).select("node", "in_degree", "out_degree", F.round(F.col("in_degree") / F.col("others"), 9).alias("in_centrality"), F.round(F.col("out_degree") / F.col("others"), 9).alias("out_centrality"))


def is_cyclic(edges: DataFrame) -> bool:
    """Whether there is a cycle: nodes without incoming or without outgoing edges go until none does; a cycle stays."""
    return not _trimmed(edges.select("src", "dst").distinct()).isEmpty()


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, components, whether there is a cycle."""
    e = stored(edges.select("src", "dst").distinct(), "edges")
    parts = components(e).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("component").alias("components"))
    cyclic = is_cyclic(e)
    n = e.agg(F.count(F.lit(1)).alias("edges"))
    return parts.join(F.broadcast(n)).select("nodes", "edges", F.round(F.col("edges") / F.col("nodes"), 6).alias("mean_degree"), "components", F.lit(cyclic).alias("has_cycle"))


def impact_scope(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(node, affected, callers, callees): for start nodes (node), distinct nodes within so many hops either way."""
    s = starts.select(F.col("node").alias("src")).distinct()
    back = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    down = distances(edges, hops, s)
    # where every caller's and callee's end is a start, the pairs of one search are those of both, read from either end
    whole = edges.select("src").union(edges.select("dst")).join(s, "src", "left_anti").isEmpty()
    up = back(down) if whole else distances(back(edges), hops, s)
    named = lambda d, way: d.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(way).alias("way"))
    every = named(down, "down").union(named(up, "up")).filter("node <> other")
    counted = every.groupBy("node").agg(F.countDistinct("other").alias("affected"), F.count_if(F.col("way") == "up").alias("callers"), F.count_if(F.col("way") == "down").alias("callees"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("affected", "callers", "callees")]
    return starts.select("node").distinct().join(counted, "node", "left").select("node", *zero)


def tainted_flows(edges: DataFrame, sources: DataFrame, sinks: DataFrame, code: DataFrame, max_edges: int = 10, per_pair: int | None = 5) -> DataFrame:
    """Flows from sources (src, source_type, confidence) to sinks (dst, sink_type) with the taint level's rank at the end.

    per_pair keeps the first so many flows of a pair by length, then nodes; None keeps all.
    code: (node, code).  Effects of the nodes within the path, in order, fold the level.
    """
    paths = simple_paths(edges, max_edges, sources, sinks) if per_pair is None else first_paths(edges, max_edges, sources, sinks, per_pair)
    paths = paths.withColumn("flow", F.monotonically_increasing_id())
    paths = stored(paths, "flows")
    inner = paths.select("flow", F.posexplode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("pos", "node"))
    effects = inner.join(code.select("node", taint_effect(F.col("code")).alias("effect")), "node", "left").groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("effect", F.lit("propagate")).alias("effect")))).alias("effects"))
    joined = paths.join(sources, "src").join(sinks, "dst").join(effects, "flow", "left")
    none = F.array().cast("array<struct<pos:int,effect:string>>")
    level = F.aggregate(F.coalesce("effects", none), taint_start(F.col("source_type")), lambda acc, x: taint_step(acc, x["effect"]))
    return joined.select("src", "dst", "source_type", "sink_type", "confidence", "path", "n", level.alias("level"))
