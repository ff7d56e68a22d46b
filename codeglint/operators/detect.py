"""Cross-file detection: where input reaches a dangerous operation of another file without protection on the way."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scoring import banded, contains_any
from ..functions.text import matches_any
from ..shipping import ship
from ..storage import stored
from .graph import components, distances, masked_distances, nearest_start
from .groups import BATCH
from .joins import small
from .parsers import CODE_FACTS, HELD, elsewhere, with_code, with_facts


def entities(files: DataFrame) -> DataFrame:
    """node (path::unit), path, name, type, code of each function and method, with its file's content as file_code."""
    parsed = files if "units" in files.columns else with_facts(files, "units", columns=CODE_FACTS)
    return with_code(parsed).select(F.concat_ws("::", "path", "name").alias("node"), "path", "name", "type", "code", F.col("content").alias("file_code"))


def matching(nodes: DataFrame, patterns, scope: str = "unit") -> DataFrame:
    """Nodes whose code, or with scope "file" whose file's, matches one of the patterns."""
    return nodes.filter(matches_any(F.col("code" if scope == "unit" else "file_code"), patterns))


def taint_ends(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, source_type, confidence) and (node, sink_type, danger) of the nodes that are sources or sinks."""
    ends = taint_kinds(nodes)
    sources = ends.filter("danger = 'source'").select("node", F.col("kind").alias("source_type"), F.lit(0.9).alias("confidence"))
    return sources, ends.filter("danger <> 'source'").select("node", F.col("kind").alias("sink_type"), "danger")


def taint_kinds(nodes: DataFrame) -> DataFrame:
    """(node, kind, danger): what nodes are sources or sinks of, all in one reading; the danger of sources is source."""
    danger = lambda k: "high" if k in rules.HIGH_DANGER_SINKS else "medium"
    ends = [(k, "source", p) for k, p in rules.SOURCE_PATTERNS.items()] + [(k, danger(k), p) for k, p in rules.SINK_PATTERNS.items()]
    hits = F.array_compact(F.array(*[F.when(matches_any(F.col("code"), p, F.col("_low")), F.struct(F.lit(k).alias("kind"), F.lit(d).alias("danger"))) for k, d, p in ends]))
    return nodes.select("node", "code", F.lower("code").alias("_low")).select("node", F.explode(hits).alias("end")).select("node", "end.*")


def cross_file_findings(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None, scope: str = "unit") -> DataFrame:
    """type, severity, source_file, target_file, source, target, depth, confidence, cwe, owasp of unprotected paths between files.

    Protection is a pattern in the code of any node on the way, the ends included: nodes that have it are taken out of the
    graph before reachability is computed, so an unprotected pair is one still joined.  Pairs that no path of calls joins, protected
    or not, count as joined if the sink's file imports the input's module and mentions a call of it; their depth is null.
    max_depth bounds the calls of a path; None takes all.
    """
    inputs = matching(nodes, rules.INPUT_PATTERNS, scope).select(F.col("node").alias("src"), F.col("path").alias("source_file"))
    # one search for all detectors: an edge has the bits of those that it is open to, and one more for the whole graph
    kinds = list(rules.CROSS_FILE)
    whole = 1 << len(kinds)
    found = stored(masked_distances(_opened(nodes, edges.select("src", "dst"), whole), inputs, max_depth, whole), "unprotected")
    open_to = lambda bit: F.col("mask").bitwiseAND(F.lit(bit)) != 0
    imported = import_related(nodes).join(inputs.select("src").distinct(), "src", "left_semi")
    imported = imported.join(found.filter(open_to(whole)).select("src", "dst"), ["src", "dst"], "left_anti")
    imported = stored(_opened(nodes, imported, whole).withColumn("depth", F.lit(None).cast("int")), "imported")
    out = None
    for i, kind in enumerate(kinds):
        r = rules.CROSS_FILE[kind]
        sinks = matching(nodes, r["sink"], scope).select(F.col("node").alias("dst"), F.col("path").alias("target_file"))
        joined = found.unionByName(imported).filter(open_to(1 << i)).select("src", "dst", "depth")
        pairs = joined.join(inputs, "src").join(sinks, "dst").filter("source_file <> target_file")
        said = [F.lit(r[k]).alias(k) for k in ("confidence", "cwe", "owasp")]
        one = pairs.select(F.lit(kind).alias("type"), F.lit(r["severity"]).alias("severity"), "source_file", "target_file", F.col("src").alias("source"), F.col("dst").alias("target"), "depth", *said)
        out = one if out is None else out.unionByName(one)
    return out.unionByName(unauthorised(nodes, edges, max_depth, scope))


def _opened(nodes: DataFrame, edges: DataFrame, whole: int) -> DataFrame:
    """Edges with the bits of the detectors whose protecting words neither end has in its code, and the bit of the whole graph."""
    bits = [F.when(contains_any(F.lower("code"), r["protection"]), 1 << i).otherwise(0) for i, r in enumerate(rules.CROSS_FILE.values())]
    safe = nodes.select("node", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("safe")).filter("safe <> 0").groupBy("node").agg(F.bit_or("safe").alias("safe"))
    end = lambda c: safe.select(F.col("node").alias(c), F.col("safe").alias(f"_{c}"))
    closed = F.coalesce("_src", F.lit(0)).bitwiseOR(F.coalesce("_dst", F.lit(0)))
    joined = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    return joined.select("src", "dst", F.lit(2 * whole - 1).bitwiseAND(F.bitwise_not(closed)).alias("mask"))


def unauthorised(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None, scope: str = "unit") -> DataFrame:
    """Sensitive nodes that no authenticating node reaches, by calls or by import_related, as findings."""
    sensitive = matching(nodes, rules.SENSITIVE_PATTERNS, scope).select("node", "path")
    auth = matching(nodes, rules.AUTH_PATTERNS, scope).select(F.col("node").alias("src"))
    reached = nearest_start(edges, auth) if max_depth is None else distances(edges, max_depth, auth).select(F.col("dst").alias("node"))
    imported = import_related(nodes).join(auth, "src", "left_semi").select("dst")
    covered = reached.select("node").union(imported).union(auth).distinct()
    bare, r = sensitive.join(covered, "node", "left_anti"), rules.AUTH_BYPASS
    return bare.select(
        F.lit("Cross-File Authorization Bypass").alias("type"), F.lit(r["severity"]).alias("severity"), F.col("path").alias("source_file"), F.col("path").alias("target_file"), F.col("node").alias("source"),
        F.col("node").alias("target"), F.lit(0).alias("depth"), F.lit(r["confidence"]).alias("confidence"), F.lit(r["cwe"]).alias("cwe"), F.lit(r["owasp"]).alias("owasp"),
    )


def import_related(nodes: DataFrame) -> DataFrame:
    """(src, dst) where dst's file imports src's module and mentions a call of src: reachability when there is no call edge."""
    files = nodes.groupBy("path").agg(F.first("file_code").alias("content"), F.collect_set(F.struct("node", "name")).alias("named"))
    return import_pairs(files.select("path", "named", *_mentions()))


def import_relations(files: DataFrame) -> DataFrame:
    """import_related() of files (path, content, language), each a row of its own that is parsed once."""
    named = F.filter("units", lambda u: u["type"].isin("function", "method"))
    named = F.array_distinct(F.transform(named, lambda u: F.struct(F.concat_ws("::", F.col("path"), u["name"]).alias("node"), u["name"].alias("name"))))
    parsed = with_facts(files, "units", columns={"units": "name string, type string"}).select("path", named.alias("named"), *_mentions())
    return import_pairs(stored(parsed, "mentions"))


def _mentions() -> list[Column]:
    """stems, the last parts of the modules that a content imports, and words, what it has before a bracket."""
    modules = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:import|from)\s+([\w.]+)"), F.lit(1))
    parts = F.split("content", r"\(")
    # a name has no white space, so a call of it ends a word
    words = F.array_distinct(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.element_at(F.split(x, r"\s"), -1)))
    stems = F.array_distinct(F.transform(modules, _last))
    return [stems.alias("stems"), F.when(F.size(stems) > 0, words).otherwise(F.array().cast("array<string>")).alias("words")]


def _last(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def importing(files: DataFrame, *columns: str) -> DataFrame:
    """(a, b, called) and b's columns: files b that import the module a, and the nodes of a whose call b mentions.

    files: path, named (array of structs of node and name), stems, words.  A file meets those it imports once, by the names of both;
    neither contents nor pairs of a file and a node are shuffled.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    a = files.filter(F.size("named") > 0).select(F.col("path").alias("a"), stem.alias("stem"), F.col("named").alias("_named"))
    b = files.filter(F.size("named") > 0).select(F.col("path").alias("b"), "words", F.explode("stems").alias("stem"), *columns)
    called = F.filter("_named", lambda n: F.exists("words", lambda w: F.endswith(w, _last(n["name"]))))
    met = a.join(b, "stem").filter("a <> b").select("a", "b", F.transform(called, lambda n: n["node"]).alias("called"), *columns)
    return met.filter(F.size("called") > 0)


def import_pairs(files: DataFrame) -> DataFrame:
    """(src, dst) of importing()."""
    met = importing(files, "named")
    return met.select(F.explode("called").alias("src"), F.transform("named", lambda n: n["node"]).alias("_to")).select("src", F.explode("_to").alias("dst"))


#: Nodes, calls and imports of a group of files that one task solves.
GROUP_ROWS = 20_000
_FOUND = "type string, severity string, source_file string, target_file string, source string, target string, depth int, confidence double, cwe string, owasp string"


def audit(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Findings of a tree of files: units, calls, cross-file paths.

    No path leaves the files that calls and imports join.  Such groups of files are solved where they are, whatever the length of
    their paths; only groups of more than GROUP_ROWS rows go by rounds of joins, as cross_file_findings().
    """
    files = files.select("path", "content", "language")
    parsed = with_facts(files, "units", "edges", columns=CODE_FACTS).select("path", "content", "units", "edges")
    facts = stored(parsed.select("path", _flagged().alias("named"), *_mentions(), "edges", F.transform("units", lambda u: F.struct(u["name"].alias("name"), u["type"].alias("type"))).alias("units")), "facts")
    # what one file calls of another, and what it may by its imports
    away = elsewhere(facts).filter("to <> path")
    calls = stored(away.select("path", F.concat_ws("::", "path", "caller").alias("src"), "to", F.concat_ws("::", "to", "unit").alias("dst")).distinct(), "calls-away")
    imported = stored(importing(facts).select("a", "b", "called"), "imported")
    links = calls.select(F.col("path").alias("src"), F.col("to").alias("dst")).union(imported.select("a", "b")).distinct()
    group = components(links).select(F.col("node").alias("path"), F.col("component").alias("group"))
    own = F.transform(F.filter("edges", lambda e: e["own"].isNotNull()), lambda e: F.struct(F.concat_ws("::", F.col("path"), e["caller"]).alias("src"), F.concat_ws("::", F.col("path"), e["own"]).alias("dst")))
    rows = facts.select("path", "named", F.array_distinct(own).alias("calls"))
    rows = rows.join(calls.groupBy("path").agg(F.collect_list(F.struct("src", "dst")).alias("_away")), "path", "left")
    rows = rows.join(imported.groupBy(F.col("b").alias("path")).agg(F.flatten(F.collect_list("called")).alias("imported")), "path", "left").join(group, "path", "left")
    none = lambda c, of: F.coalesce(c, F.array().cast(f"array<{of}>"))
    rows = rows.select(F.coalesce("group", "path").alias("group"), "path", "named", F.concat("calls", none("_away", "struct<src:string,dst:string>")).alias("calls"), none("imported", "string").alias("imported"))
    rows = stored(rows.filter(F.size("named") > 0), "groups")
    sizes = rows.groupBy("group").agg(F.sum(F.size("named") + F.size("calls") + F.size("imported")).alias("n")).filter(F.col("n") > GROUP_ROWS).select("group")
    large = stored(sizes, "large-groups")
    if large.isEmpty():
        return _solved(rows, max_depth)
    some = stored(rows.join(small(large), "group", "left_semi").select("path", "calls"), "large")
    whole = stored(with_facts(files.join(some.select("path"), "path", "left_semi"), "units", columns=CODE_FACTS).select("path", "content", "units"), "parsed")
    rest = cross_file_findings(stored(entities(whole), "entities"), stored(some.select(F.explode("calls").alias("c")).select("c.*"), "calls"), max_depth)
    return _solved(rows.join(small(large), "group", "left_anti"), max_depth).unionByName(rest)


def _flagged() -> Column:
    """Functions and methods of a file with the bits of what their code matches: input, sinks, protections, sensitive, authenticating."""
    kinds = rules.CROSS_FILE.values()

    def bits(x: Column) -> Column:
        code, low = x["code"], x["low"]
        found = [*[matches_any(code, p, low) for p in (rules.INPUT_PATTERNS, *[r["sink"] for r in kinds])], *[contains_any(low, r["protection"]) for r in kinds]]
        found += [matches_any(code, p, low) for p in (rules.SENSITIVE_PATTERNS, rules.AUTH_PATTERNS)]
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(found)])

    def of(lines: Column, u: Column) -> Column:
        code = F.array_join(F.slice(lines, u["start_line"], u["end_line"] - u["start_line"] + 1), "\n")
        return F.struct(F.concat_ws("::", F.col("path"), u["name"]).alias("node"), u["name"].alias("name"), F.get(F.transform(F.array(F.struct(code.alias("code"), F.lower(code).alias("low"))), bits), 0).alias("bits"))

    functions = F.filter("units", lambda u: u["type"].isin("function", "method"))
    return F.get(F.transform(F.array(F.split("content", "\n")), lambda lines: F.transform(functions, lambda u: of(lines, u))), 0)


def _solved(rows: DataFrame, max_depth: int | None) -> DataFrame:
    """cross_file_findings() of groups: rows of a file with group, path, named (node, name, bits), calls (src, dst) and the nodes imported."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(rows.sparkSession)
    schema = StructType.fromDDL(_FOUND)
    arrow = to_arrow_schema(schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, files = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                for group, *file in zip(*(c.to_pylist() for c in batch.slice(at, HELD).columns)):
                    if group != now:
                        yield from unprotected(files, max_depth)
                        now, files = group, []
                    files.append(file)
        yield from unprotected(files, max_depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = found(batches)
        while part := list(islice(every, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), arrow.types)], schema=arrow)

    return rows.select("group", "path", "named", "calls", "imported").repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def unprotected(files: list, max_depth: int | None) -> Iterator[tuple]:
    """cross_file_findings() of one group of files: [path, named, calls, imported], each named {node, name, bits}."""
    n = len(rules.CROSS_FILE)
    rows = [(x["node"], path, x["bits"]) for path, named, _, _ in files for x in named]
    every = 0
    for _, _, bits in rows:
        every |= bits
    sensitive, auth = 1 << 2 * n + 1, 1 << 2 * n + 2
    wanted = [i for i in range(n) if every & 1 and every >> 1 + i & 1]
    if not wanted and not every & sensitive:
        return
    callees: dict[str, set] = {}
    for _, _, calls, _ in files:
        for c in calls:
            callees.setdefault(c["src"], set()).add(c["dst"])
    safe, importers = {}, {}
    for node, _, bits in rows:
        safe[node] = safe.get(node, 0) | bits >> 1 + n
    for _, named, _, imported in files:
        for node in set(imported):
            importers.setdefault(node, set()).update(x["node"] for x in named)
    inputs = [r for r in rows if r[2] & 1] if wanted else []
    # of each input in the whole graph: what calls reach, so that imports don't count
    joined = {node: importers[node] - _reached(callees, node, None).keys() for node in {r[0] for r in inputs} if node in importers}
    for i, (kind, r) in enumerate(rules.CROSS_FILE.items()):
        if i not in wanted:
            continue
        bit, sinks = 1 << i, {}
        for node, path, bits in rows:
            if bits >> 1 + i & 1 and not safe[node] & bit:
                sinks.setdefault(node, []).append(path)
        depths = {}
        for node, path, _ in inputs if sinks else ():
            if safe[node] & bit:
                continue
            if node not in depths:
                depths[node] = {**{x: d for x, d in _reached(callees, node, max_depth, safe, bit).items() if x in sinks}, **{x: None for x in joined.get(node, ()) if x in sinks}}
            for x, depth in depths[node].items():
                for to in sinks[x]:
                    if to != path:
                        yield kind, r["severity"], path, to, node, x, depth, r["confidence"], r["cwe"], r["owasp"]
    if every & sensitive:
        starts = {node for node, _, bits in rows if bits & auth}
        covered = starts | _reached(callees, starts, max_depth).keys()
        for node in starts:
            covered |= importers.get(node, set())
        r = rules.AUTH_BYPASS
        for node, path, bits in rows:
            if bits & sensitive and node not in covered:
                yield "Cross-File Authorization Bypass", r["severity"], path, path, node, node, 0, r["confidence"], r["cwe"], r["owasp"]


def _reached(callees: dict, start: str | set, max_depth: int | None, safe: dict | None = None, bit: int = 0) -> dict[str, int]:
    """Nodes that one call or more reach, and the least number of calls; none that are safe by this bit."""
    depth, out, now = 0, {}, [start] if isinstance(start, str) else list(start)
    while now and (max_depth is None or depth < max_depth):
        depth, found = depth + 1, []
        for a in now:
            for b in callees.get(a, ()):
                if b not in out and not (bit and safe.get(b, 0) & bit):
                    out[b] = depth
                    found.append(b)
        now = found
    return out


def united(cross_file: DataFrame, flows: DataFrame, least_risk: float = 0.6) -> DataFrame:
    """origin, type, severity, source, target, confidence of a whole security run: all cross-file findings, and the flows (src, dst,
    type, risk) whose risk is least_risk or more, with the severity of their risk."""
    names = ("type", "severity", "source", "target", "confidence")
    severity = banded(F.col("risk"), ((0.8, "critical"), (0.6, "high"), (0.4, "medium")), "low")
    risky = flows.filter(F.col("risk") >= least_risk)
    risky = risky.select(F.lit("flow").alias("origin"), "type", severity.alias("severity"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.col("risk").alias("confidence"))
    return cross_file.select(F.lit("cross file").alias("origin"), *names).unionByName(risky)


def risk_by_name(source: Column, target: Column) -> Column:
    """high, medium or low risk of a flow from one named unit to another: a risky word in the target's name, in the source's, or in neither."""
    risky = lambda c: contains_any(F.lower(c), rules.FLOW_RISK_WORDS)
    return F.when(risky(target), "high").when(risky(source), "medium").otherwise("low")
