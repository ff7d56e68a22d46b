"""Queries over the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..operators import detect as D
from ..operators import graph as G
from ..operators import integration as I
from ..operators import knowledge as N
from ..sources import adapters as A
from ..storage import stored

SOURCE_TYPES = {0: "user_input", 1: "file_input", 2: "network_input"}
SINK_TYPES = {0: "sql_query", 1: "command_exec", 2: "file_write", 3: "template_render", 4: "response_output"}


#: Functions of a module at most, and so edges of a path.
MODULE = 30


def _sources(spark, sf):
    f = A.functions(spark, sf).filter(F.col("part") % 4 == 0)
    return f.select(F.col("node").alias("src"), S.lookup(F.col("part") % 3, SOURCE_TYPES).alias("source_type"), F.lit(0.9).alias("confidence"))


def _sinks(spark, sf):
    f = A.functions(spark, sf).filter(F.col("part") % 5 == 1)
    return f.select(F.col("node").alias("dst"), S.lookup(F.col("size") % 5, SINK_TYPES, "other").alias("sink_type"))


def _code(spark, sf):
    """Functions of some sizes sanitise, others amplify."""
    f, size = A.functions(spark, sf), F.col("size")
    return f.select("node", F.when(size % 7 == 0, "html.escape(x)").when(size % 7 == 1, "eval(x)").otherwise("pass").alias("code"))


def _text(path):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    return G.reachable(A.calls(spark, sf))


def bfs_depth(spark: SparkSession, sf: str) -> DataFrame:
    d = G.distances(A.calls(spark, sf), None)
    n = d.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") + F.col("dst")).alias("checksum"))
    return n.select(F.col("depth").cast("long").alias("depth"), "n", "checksum")


def simple_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All simple paths of up to 10 calls."""
    return G.simple_paths(A.calls(spark, sf), 10).select("src", "dst", "n", _text("path").alias("path"))


def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    return G.shortest_paths_in(A.calls(spark, sf), A.module).filter("src <> dst").select("src", "dst", "n", _text("path").alias("path"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(A.calls(spark, sf))


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.on_cycles(A.calls(spark, sf))


def topo_layers(spark: SparkSession, sf: str) -> DataFrame:
    e = A.calls(spark, sf).filter("src < dst")
    return G.layers(e.select(F.col("src").alias("node")).union(e.select("dst")), e)


def cycle_components(spark: SparkSession, sf: str) -> DataFrame:
    """Every function's component of functions that call each other in cycles, and its size."""
    c = stored(G.strong_layers_in(A.calls(spark, sf), A.module), "strong")
    return c.join(c.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


def condensed_layers(spark: SparkSession, sf: str) -> DataFrame:
    return G.strong_layers_in(A.calls(spark, sf), A.module)


def degree_centrality(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees in the dense graph of parts of all orders."""
    return G.degrees(A.part_calls(spark, sf))


def graph_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return G.statistics(A.calls(spark, sf))


def impact_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Every function's callers and callees within five calls."""
    return G.impact_scope(A.calls(spark, sf), A.functions(spark, sf), 5)


def _flows(spark, sf, per_pair):
    return G.tainted_flows(A.calls(spark, sf), _sources(spark, sf), _sinks(spark, sf), _code(spark, sf), 10, per_pair)


def taint_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows of up to 10 calls over the risk threshold, the first five of each pair."""
    f = _flows(spark, sf, 5)
    risk = S.taint_risk(F.col("source_type"), F.col("sink_type"), F.col("level"), F.col("n"), F.col("confidence"))
    kind = F.concat_ws("/", "source_type", "sink_type")
    name = S.lookup(kind, {f"{a}/{b}": v for (a, b), v in rules.FLOW_TYPES.items()}, "Data Flow Vulnerability")
    f = f.select("src", "dst", "n", F.col("level").cast("long").alias("level"), F.round(risk, 6).alias("risk"), name.alias("type"))
    return f.filter("risk > 0.3")


def best_flow_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The shortest flow of each pair of source and sink, out of up to five, with its steps and its risk."""
    f = _flows(spark, sf, 5)
    risk = S.taint_risk(F.col("source_type"), F.col("sink_type"), F.col("level"), F.col("n"), F.col("confidence"))
    best = G.best_flows(f.select("src", "dst", "path", "n", F.col("level").cast("long").alias("level"), F.round(risk, 6).alias("risk")))
    return best.select("src", "dst", "n_paths", _text("path").alias("path"), "steps", "level", "risk")


def sanitisation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of sanitised flows by source type, over all flows."""
    n, clean = F.count(F.lit(1)), F.count_if(F.col("level") == 1)
    return _flows(spark, sf, None).groupBy("source_type").agg(n.alias("n"), clean.alias("sanitized"), F.round(clean / n, 6).alias("coverage"))


def unprotected_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Source and sink pairs with a path none of whose inner nodes sanitises: a semi-join on what is left."""
    safe = _code(spark, sf).filter(S.taint_effect(F.col("code")) == "sanitize").select("node")
    e = A.calls(spark, sf)
    s, t = _sources(spark, sf).select("src"), _sinks(spark, sf).select("dst")
    inner = e.join(safe.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    to_sink = e.join(safe.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst")
    # an edge may enter a sanitising node only as a sink, and leave one only as a source
    open_edges = inner.union(e.join(t, "dst", "left_semi").select("src", "dst")).intersect(to_sink.union(e.join(s, "src", "left_semi").select("src", "dst")))
    r = G.distances(open_edges, None, s).join(t, "dst", "left_semi")
    return r.filter("src <> dst").select("src", "dst", F.col("depth").cast("long").alias("depth"))


def missing_auth(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitive nodes that no authenticating node reaches, over any number of calls: an anti-join."""
    e, f = A.calls(spark, sf), A.functions(spark, sf)
    used = e.select("dst").distinct().join(f.filter("size % 6 = 0").select(F.col("node").alias("dst")), "dst", "left_semi")
    covered = G.nearest_start(e, f.filter("size % 6 = 1").select(F.col("node").alias("src"))).select(F.col("node").alias("dst"))
    return used.join(covered, "dst", "left_anti").select(F.col("dst").alias("node"))


def auth_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitive parts of the dense graph of all orders, with how far off the nearest authenticating one is; null where none reaches it."""
    e = A.part_calls(spark, sf)
    p = A.table(spark, sf, "part")
    sensitive, auth = p.filter("p_size % 6 = 0").select(F.col("p_partkey").alias("node")), p.filter("p_size % 6 = 1").select(F.col("p_partkey").alias("src"))
    used = e.select(F.col("dst").alias("node")).distinct().join(sensitive, "node", "left_semi")
    return used.join(G.nearest_start(e, auth), "node", "left").select("node", F.col("depth").cast("long").alias("depth"))


def flow_report(spark: SparkSession, sf: str) -> DataFrame:
    """One row over the taint flows."""
    r = I.flow_report(taint_flows(spark, sf))
    return r.select("n", "high", "medium", "sanitized", F.array_join(F.transform(F.map_entries("by_type"), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("by_type"))


def flow_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Taint flows as findings, by what they say."""
    f = taint_flows(spark, sf).withColumn("type", F.concat_ws("#", "type", F.col("n").cast("string"), F.col("level").cast("string")))
    return I.flows_as_findings(f).groupBy("vulnerability_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("confidence"), 6).alias("most"))


def entry_exit(spark: SparkSession, sf: str) -> DataFrame:
    return I.entry_exit(A.calls(spark, sf))


def maximal_paths(spark: SparkSession, sf: str) -> DataFrame:
    """At most ten maximal paths of up to five calls from each function."""
    p = I.maximal_paths_in(A.calls(spark, sf), A.module, 5, 10)
    return p.select("src", "dst", _text("path").alias("path"))


def impact_levels(spark: SparkSession, sf: str) -> DataFrame:
    """How many functions have which level of impact, by what they affect."""
    s = impact_scope(spark, sf).join(A.functions(spark, sf), "node")
    name = F.when(F.col("part") % 7 == 0, "delete_user").when(F.col("part") % 7 == 1, "admin_panel").otherwise("helper")
    level = I.impact_level(F.col("affected"), F.least(F.col("callees"), F.lit(5)), F.array(name))
    return s.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("affected").alias("affected"))


def unit_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three siblings and three callees of every function."""
    f = A.functions(spark, sf).select(F.col("node").cast("string").alias("unit"), F.col("module").alias("path"), F.col("pos").alias("start_line"))
    e = A.calls(spark, sf).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return N.unit_context(f, e).select("unit", F.array_join("siblings", ",").alias("siblings"), F.array_join("successors", ",").alias("successors"))


def call_risks(spark: SparkSession, sf: str) -> DataFrame:
    """Every call with the risk that the names of its ends show."""
    f, part = A.functions(spark, sf), F.col("part")
    name = F.when(part % 7 == 0, "delete_User").when(part % 7 == 1, "adminPanel").when(part % 7 == 2, "check_TOKEN").otherwise("helper")
    names = f.select("node", name.alias("name"))
    e = A.calls(spark, sf).join(names.select(F.col("node").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("node").alias("dst"), F.col("name").alias("b")), "dst")
    return e.select("src", "dst", D.risk_by_name(F.col("a"), F.col("b")).alias("risk"))


_ALL = (
    reachability, bfs_depth, simple_paths, shortest_paths, components, cycles, topo_layers, degree_centrality, graph_statistics, impact_scope, taint_flows,
    sanitisation_coverage, unprotected_pairs, missing_auth, auth_distance, flow_report, flow_findings, entry_exit, maximal_paths, impact_levels, unit_neighbours,
    best_flow_paths, cycle_components, condensed_layers, call_risks,
)
QUERIES = {f.__name__: f for f in _ALL}

_W = A.with_roles("functions", "calls")
_REC = "WITH RECURSIVE " + A.SQL["functions"] + ",\n" + A.SQL["calls"]


def _dist(depth: int = MODULE, edges: str = "calls", name: str = "d") -> str:
    return f"""r{name}(src, dst, depth) AS (SELECT src, dst, 1 FROM {edges} UNION SELECT r{name}.src, e.dst, depth + 1 FROM r{name} JOIN {edges} e ON r{name}.dst = e.src WHERE depth < {depth}),
        {name} AS (SELECT src, dst, min(depth) AS depth FROM r{name} GROUP BY src, dst)"""


def _paths(n: int) -> str:
    return f"""p(src, dst, path, n) AS (SELECT src, dst, [src, dst], 2 FROM calls
        UNION ALL SELECT p.src, e.dst, list_append(path, e.dst), n + 1 FROM p JOIN calls e ON p.dst = e.src WHERE n <= {n} AND NOT list_contains(path, e.dst))"""


_PARTS = """u AS (SELECT src AS a, dst AS b FROM calls UNION SELECT dst, src FROM calls), r(node, other) AS (SELECT a, b FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a),
    c AS (SELECT node, least(node, min(other)) AS component FROM r GROUP BY node)"""
_PATH = "array_to_string(path, '>')"


def _flow(kept: str) -> str:
    return f"""{_REC}, {_paths(10)}, s AS (SELECT node AS src, CASE part % 3 WHEN 0 THEN 'user_input' WHEN 1 THEN 'file_input' ELSE 'network_input' END AS source_type FROM functions WHERE part % 4 = 0),
    t AS (SELECT node AS dst, CASE size % 5 WHEN 0 THEN 'sql_query' WHEN 1 THEN 'command_exec' WHEN 2 THEN 'file_write' WHEN 3 THEN 'template_render' ELSE 'response_output' END AS sink_type
        FROM functions WHERE part % 5 = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY n, path) AS r FROM p),
    c AS (SELECT k.src, k.dst, k.n, k.path, s.source_type, t.sink_type, row_number() OVER () AS flow FROM k JOIN s ON k.src = s.src JOIN t ON k.dst = t.dst WHERE {kept}),
    w(flow, i, level) AS (SELECT flow, 2, CASE WHEN source_type = 'user_input' THEN 3 ELSE 2 END FROM c UNION ALL
        SELECT w.flow, i + 1, CASE WHEN q.size % 7 = 0 THEN 1 WHEN q.size % 7 = 1 AND level = 2 THEN 3 ELSE level END FROM w JOIN c ON w.flow = c.flow JOIN functions q ON q.node = c.path[i] WHERE i < c.n),
    f AS (SELECT c.*, w.level FROM c JOIN w ON c.flow = w.flow AND w.i = c.n)"""


_TAINT = f"""{_flow("r <= 5")}, g AS (SELECT src, dst, path, CAST(n AS BIGINT) AS n, CAST(level AS BIGINT) AS level, source_type || '/' || sink_type AS kind,
        round(least(CAST(1.0 AS DOUBLE), CAST(CASE source_type WHEN 'user_input' THEN 0.8 WHEN 'file_input' THEN 0.6 ELSE 0.7 END
        + CASE sink_type WHEN 'sql_query' THEN 0.9 WHEN 'command_exec' THEN 1.0 WHEN 'file_write' THEN 0.6 WHEN 'template_render' THEN 0.7 WHEN 'response_output' THEN 0.5 ELSE 0.3 END AS DOUBLE)
        * CASE level WHEN 0 THEN 0.0 WHEN 1 THEN 0.2 WHEN 2 THEN 0.7 ELSE 1.0 END * greatest(0.3, 1.0 - (n - 2) * 0.1) * 0.9), 6) AS risk FROM f),
    h AS (SELECT src, dst, n, level, risk, CASE kind {" ".join(f"WHEN '{a}/{b}' THEN '{v}'" for (a, b), v in rules.FLOW_TYPES.items())} ELSE 'Data Flow Vulnerability' END AS type
        FROM g WHERE risk > 0.3)"""
_SCOPE = f"""{_REC}, b AS (SELECT dst AS src, src AS dst FROM calls), {_dist(5)}, {_dist(5, 'b', 'v')},
    x AS (SELECT src AS node, dst AS other, 'down' AS way FROM d UNION ALL SELECT src, dst, 'up' FROM v),
    z AS (SELECT s.node, count(DISTINCT other) AS affected, count(*) FILTER (way = 'up') AS callers, count(*) FILTER (way = 'down') AS callees
        FROM functions s LEFT JOIN x ON x.node = s.node AND x.node <> x.other GROUP BY s.node)"""

_STRONG = f"""{_REC}, {_dist()}, n AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls),
    m AS (SELECT a.src AS node, min(a.dst) AS low FROM d a JOIN d b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
    s AS (SELECT n.node, least(n.node, coalesce(low, n.node)) AS component FROM n LEFT JOIN m ON m.node = n.node)"""

SQL = {
    "best_flow_paths": f"""{_TAINT} SELECT src, dst, n_paths, {_PATH} AS path, n - 1 AS steps, level, risk
        FROM (SELECT *, count(*) OVER (PARTITION BY src, dst) AS n_paths, row_number() OVER (PARTITION BY src, dst ORDER BY n, path) AS r FROM g) x WHERE r = 1""",
    "cycle_components": f"{_STRONG} SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM s",
    "condensed_layers": f"""{_STRONG}, e AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM calls c JOIN s a ON a.node = c.src JOIN s b ON b.node = c.dst WHERE a.component <> b.component),
        r(node, layer) AS (SELECT component, 0 FROM s UNION SELECT e.dst, layer + 1 FROM r JOIN e ON r.node = e.src), l AS (SELECT node, max(layer) AS layer FROM r GROUP BY node)
        SELECT s.node, s.component, CAST(l.layer AS BIGINT) AS layer FROM s JOIN l ON l.node = s.component""",
    "call_risks": f"""{_W} SELECT c.src, c.dst, CASE WHEN b.part % 7 < 3 THEN 'high' WHEN a.part % 7 < 3 THEN 'medium' ELSE 'low' END AS risk FROM calls c JOIN functions a ON a.node = c.src JOIN functions b ON b.node = c.dst""",
    "reachability": f"{_REC}, {_dist()} SELECT src, dst FROM d",
    "bfs_depth": f"{_REC}, {_dist()} SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n, CAST(sum(src + dst) AS BIGINT) AS checksum FROM d GROUP BY depth",
    "simple_paths": f"{_REC}, {_paths(10)} SELECT src, dst, CAST(n AS BIGINT) AS n, {_PATH} AS path FROM p",
    "shortest_paths": f"""{_REC}, {_paths(MODULE)} SELECT src, dst, n, path
        FROM (SELECT src, dst, CAST(n AS BIGINT) AS n, {_PATH} AS path, row_number() OVER (PARTITION BY src, dst ORDER BY n, path) AS r FROM p) x WHERE r = 1""",
    "components": f"{_REC}, {_PARTS} SELECT * FROM c",
    "cycles": f"{_REC}, {_dist()} SELECT src AS node, CAST(depth AS BIGINT) AS length FROM d WHERE src = dst",
    "topo_layers": f"""{_REC}, e AS (SELECT * FROM calls WHERE src < dst), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
        r(node, layer) AS (SELECT node, 0 FROM n UNION SELECT e.dst, layer + 1 FROM r JOIN e ON r.node = e.src) SELECT node, CAST(max(layer) AS BIGINT) AS layer FROM r GROUP BY node""",
    "degree_centrality": f"""{A.with_roles("part_calls")}, x AS (SELECT src AS node, 0 AS i, 1 AS o FROM part_calls UNION ALL SELECT dst, 1, 0 FROM part_calls),
        d AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM x GROUP BY node)
        SELECT node, in_degree, out_degree, round(in_degree * 1.0 / (SELECT count(*) - 1 FROM d), 9) AS in_centrality, round(out_degree * 1.0 / (SELECT count(*) - 1 FROM d), 9) AS out_centrality FROM d""",
    "graph_statistics": f"""{_REC}, {_PARTS}, {_dist()} SELECT count(*) AS nodes, (SELECT count(*) FROM calls) AS edges, round((SELECT count(*) FROM calls) * 1.0 / count(*), 6) AS mean_degree,
        count(DISTINCT component) AS components, EXISTS (SELECT 1 FROM d WHERE src = dst) AS has_cycle FROM c""",
    "impact_scope": f"{_SCOPE} SELECT node, affected, callers, callees FROM z",
    "taint_flows": f"{_TAINT} SELECT * FROM h",
    "sanitisation_coverage": f"{_flow('true')} SELECT source_type, count(*) AS n, count(*) FILTER (level = 1) AS sanitized, round(count(*) FILTER (level = 1) * 1.0 / count(*), 6) AS coverage FROM f GROUP BY source_type",
    "unprotected_pairs": f"""{_REC}, o AS (SELECT c.src, c.dst FROM calls c JOIN functions a ON a.node = c.src JOIN functions b ON b.node = c.dst
            WHERE (b.size % 7 <> 0 OR b.part % 5 = 1) AND (a.size % 7 <> 0 OR a.part % 4 = 0)), {_dist(edges='o')}
        SELECT d.src, d.dst, CAST(depth AS BIGINT) AS depth FROM d JOIN functions a ON a.node = d.src JOIN functions b ON b.node = d.dst WHERE a.part % 4 = 0 AND b.part % 5 = 1 AND d.src <> d.dst""",
    "missing_auth": f"""{_REC}, {_dist()} SELECT DISTINCT c.dst AS node FROM calls c JOIN functions q ON q.node = c.dst AND q.size % 6 = 0
        WHERE NOT EXISTS (SELECT 1 FROM d JOIN functions a ON a.node = d.src AND a.size % 6 = 1 WHERE d.dst = c.dst)""",
    "auth_distance": f"""WITH RECURSIVE {A.SQL["part_calls"]}, r(node, depth) AS (SELECT c.dst, 1 FROM part_calls c JOIN part a ON a.p_partkey = c.src AND a.p_size % 6 = 1
            UNION SELECT c.dst, r.depth + 1 FROM r JOIN part_calls c ON c.src = r.node WHERE r.depth < 8),
        d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
        SELECT u.node, CAST(d.depth AS BIGINT) AS depth FROM (SELECT DISTINCT c.dst AS node FROM part_calls c JOIN part q ON q.p_partkey = c.dst AND q.p_size % 6 = 0) u LEFT JOIN d ON d.node = u.node""",
    "flow_report": f"""{_TAINT}, y AS (SELECT type, count(*) AS k FROM h GROUP BY type)
        SELECT count(*) AS n, count(*) FILTER (risk >= 0.8) AS high, count(*) FILTER (risk >= 0.5 AND risk < 0.8) AS medium, round(count(*) FILTER (level = 1) * 1.0 / count(*), 6) AS sanitized,
        (SELECT string_agg(type || ':' || k, ',' ORDER BY type) FROM y) AS by_type FROM h""",
    "flow_findings": f"""{_TAINT} SELECT type || '#' || n || '#' || level AS vulnerability_type, CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END AS severity,
        count(*) AS n, round(max(risk), 6) AS most FROM h GROUP BY 1, 2""",
    "entry_exit": f"""{_W}, x AS (SELECT src AS node, 0 AS i, 1 AS o FROM calls UNION ALL SELECT dst, 1, 0 FROM calls), d AS (SELECT node, sum(i) AS i, sum(o) AS o FROM x GROUP BY node)
        SELECT node, CASE WHEN i = 0 THEN 'entry' ELSE 'exit' END AS role FROM d WHERE i = 0 OR o = 0""",
    "maximal_paths": f"""{_REC}, {_paths(5)}, m AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, {_PATH}) AS k FROM p
        WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.src = p.src AND q.n = p.n + 1 AND q.path[1:p.n] = p.path)) SELECT src, dst, {_PATH} AS path FROM m WHERE k <= 10""",
    "impact_levels": f"""{_SCOPE}, y AS (SELECT affected, 0.1 * affected + 0.2 * least(callees, 5) + CASE WHEN part % 7 = 0 THEN 1.0 WHEN part % 7 = 1 THEN 1.0 ELSE 0.0 END AS w FROM z JOIN functions USING (node))
        SELECT CASE WHEN w >= 8 THEN 'critical' WHEN w >= 5 THEN 'high' WHEN w >= 2 THEN 'medium' ELSE 'low' END AS level, count(*) AS n, CAST(sum(affected) AS BIGINT) AS affected FROM y GROUP BY 1""",
    "unit_neighbours": f"""{_W}, s AS (SELECT a.node, b.node AS other, row_number() OVER (PARTITION BY a.node ORDER BY b.pos, CAST(b.node AS VARCHAR)) AS k FROM functions a JOIN functions b ON a.module = b.module AND a.node <> b.node),
        g AS (SELECT node, string_agg(CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) AS siblings FROM s WHERE k <= 3 GROUP BY node),
        t AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY CAST(dst AS VARCHAR)) AS k FROM calls), h AS (SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY CAST(dst AS VARCHAR)) AS successors FROM t WHERE k <= 3 GROUP BY src)
        SELECT CAST(f.node AS VARCHAR) AS unit, coalesce(siblings, '') AS siblings, coalesce(successors, '') AS successors FROM functions f LEFT JOIN g ON g.node = f.node LEFT JOIN h ON h.src = f.node""",
}
