"""Queries over files of code: units, calls, imports, flows, detection across files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import matches_any
from ..operators import blocks as B
from ..operators import detect as D
from ..operators import knowledge as N
from ..operators import parsers as P
from ..sources import adapters as A
from ..storage import stored
from . import graphs


def _files(spark, sf):
    return stored(A.code_files(spark, sf), "code-files")


def code_units(spark: SparkSession, sf: str) -> DataFrame:
    parsed = P.with_facts(A.code_files(spark, sf), "units", columns=P.CODE_FACTS)
    return P.exploded(parsed, "units").select("path", "type", "name", "start_line", "end_line")


def function_units(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of Python with what their heads and bodies say."""
    columns = {"units": "name string, type string, params array<string>, visibility string, is_async boolean, complexity int"}
    u = P.exploded(P.with_facts(A.code_files(spark, sf).filter("language = 'python'"), "units", columns=columns), "units").filter("type = 'function'")
    return u.select("path", "name", F.array_join("params", ",").alias("params"), "visibility", "is_async", "complexity")


def block_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of all files by line patterns, indent and brackets, as of languages without a parser."""
    return B.block_units(A.code_files(spark, sf))


def code_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    return P.call_edges(A.code_files(spark, sf)).select("src", "dst", "type", "line", "confidence")


def call_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Calls by kind and what is called, with their arguments."""
    c = P.calls(_files(spark, sf)).withColumn("callee", F.regexp_replace("callee", "[0-9]+", "#"))
    return c.groupBy("callee", "type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("n_args").alias("n_args"))


def code_imports(spark: SparkSession, sf: str) -> DataFrame:
    return P.imports(A.code_files(spark, sf))


def file_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return P.file_dependencies(files, P.imports(files))


def assignment_flows(spark: SparkSession, sf: str) -> DataFrame:
    return P.flows(_files(spark, sf))


def line_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The function around each third line of every file, and around the first."""
    files = _files(spark, sf)
    points = files.select("path", F.explode(F.sequence(F.lit(1), F.size(F.split("content", "\n")), F.lit(3))).alias("line"))
    return P.enclosing_function(points, P.code_units(files)).select("path", "line", "function")


def taint_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that are sources or sinks."""
    return D.taint_kinds(D.entities(A.code_files(spark, sf)).select("node", "code"))


def input_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions with input in their own code, or in that of their file."""
    hit = A.code_files(spark, sf).filter(matches_any(F.col("content"), rules.INPUT_PATTERNS))  # once a file, before it is parsed
    return D.entities(hit).select("node", matches_any(F.col("code"), rules.INPUT_PATTERNS).alias("own"))


def import_relations(spark: SparkSession, sf: str) -> DataFrame:
    return D.import_relations(A.code_files(spark, sf))


def cross_file_findings(spark: SparkSession, sf: str) -> DataFrame:
    """The five detectors over all files."""
    return D.audit(A.code_files(spark, sf)).select("type", "severity", "source", "target", F.col("depth").cast("long").alias("depth"), "confidence", "cwe", "owasp")


def security_run(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-file findings and risky flows together, by origin, type and severity."""
    u = D.united(cross_file_findings(spark, sf), graphs.taint_flows(spark, sf))
    return u.groupBy("origin", "type", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.round(F.max("confidence"), 6).alias("most"))


def pattern_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations that patterns find in the Python files."""
    return N.relations(_files(spark, sf).filter("language = 'python'").select(F.col("path").alias("id"), F.col("content").alias("text")), limit=100)


_ALL = (
    code_units, function_units, block_units, code_call_edges, call_sites, code_imports, file_dependencies, assignment_flows, line_functions, taint_ends, input_functions,
    import_relations, cross_file_findings, security_run, pattern_relations,
)
QUERIES = {f.__name__: f for f in _ALL}

_W = A.with_roles("functions", "code")
_NODE = "path || '::' || name"
_CALLED = "CASE kind WHEN 1 THEN 'cursor.execute' WHEN 2 THEN 'escape' WHEN 3 THEN 'eval' WHEN 5 THEN 'print' WHEN 6 THEN 'open' WHEN 7 THEN 'check_token' WHEN 8 THEN 'drop' END"
_CALLS = f"""calls AS (SELECT path, name AS caller, {_CALLED} AS callee, CASE kind WHEN 1 THEN 'indirect' ELSE 'direct' END AS type, line + 1 AS line FROM code WHERE lang = 'python' AND kind NOT IN (0, 4)
    UNION ALL SELECT path, name, CASE WHEN pos < n THEN 'f' || module || '_' || (pos + 1) WHEN module = home THEN 'str' ELSE 'm' || home || '.f' || home || '_1' END,
        CASE WHEN pos < n OR module = home THEN 'direct' ELSE 'indirect' END, line + 2 FROM code WHERE lang = 'python'
    UNION ALL SELECT path, name, 'f' || module || '_' || (pos + 1), 'js', line + 1 FROM code WHERE lang = 'javascript' AND pos < n)"""
#: Detectors with the kind of their sink, and the kind that protects.
_SINKS = {"Cross-File SQL Injection": (1, 2), "Cross-File XSS": (5, 2), "Cross-File Command Injection": (3, 2), "Cross-File Path Traversal": (6, -1)}
_RULES = ", ".join(f"('{k}', {sink}, {safe}, '{rules.CROSS_FILE[k]['severity']}', {rules.CROSS_FILE[k]['confidence']}, '{rules.CROSS_FILE[k]['cwe']}', '{rules.CROSS_FILE[k]['owasp']}')" for k, (sink, safe) in _SINKS.items())

SQL = {
    "code_units": f"""{_W}, f AS (SELECT DISTINCT path, module, lang, n FROM code)
        SELECT path, 'file' AS type, split_part(path, '/', 2) AS name, 1 AS start_line, CAST(3 * n + CASE lang WHEN 'python' THEN 2 WHEN 'javascript' THEN 1 ELSE 3 END AS INTEGER) AS end_line FROM f
        UNION ALL SELECT path, 'class', 'A' || module, 1, CAST(3 * n + 2 AS INTEGER) FROM f WHERE lang = 'java'
        UNION ALL SELECT path, CASE lang WHEN 'java' THEN 'method' ELSE 'function' END, name, CAST(line AS INTEGER), CAST(line + 2 AS INTEGER) FROM code""",
    "block_units": f"""{_W}, f AS (SELECT DISTINCT path, module, lang, n FROM code), s AS (SELECT *, lang = 'javascript' AS js FROM code WHERE lang <> 'java')
        SELECT path, 'file' AS type, split_part(path, '/', 2) AS name, 1 AS start_line, CAST(3 * n + CASE lang WHEN 'python' THEN 1 WHEN 'javascript' THEN 0 ELSE 2 END AS INTEGER) AS end_line FROM f
        UNION ALL SELECT path, 'class', 'A' || module, 1, CAST(3 * n + 1 AS INTEGER) FROM f WHERE lang = 'java'
        UNION ALL SELECT path, 'function', name, CAST(line AS INTEGER), CAST(line + CASE WHEN js THEN 1 ELSE 2 END AS INTEGER) FROM s
        UNION ALL SELECT path, 'method', CASE WHEN pos < n THEN 'f' || module || '_' || (pos + 1) ELSE 'str' END, CAST(line + CASE WHEN js THEN 1 ELSE 2 END AS INTEGER), CAST(line + CASE WHEN js THEN 1 ELSE 2 END AS INTEGER)
            FROM s WHERE pos < n OR (module = home AND NOT js)""",
    "function_units": f"{_W} SELECT path, name, 'val' AS params, 'public' AS visibility, false AS is_async, CASE kind WHEN 4 THEN 2 ELSE 1 END AS complexity FROM code WHERE lang = 'python'",
    "code_call_edges": f"""{_W}, {_CALLS}, r AS (SELECT c.path || '::' || caller AS src, coalesce(u.path || '::' || u.name, callee) AS dst, CASE type WHEN 'js' THEN 'direct' ELSE type END AS type, c.line,
            CASE WHEN type = 'direct' THEN 0.9 ELSE 0.8 END AS confidence FROM calls c LEFT JOIN code u ON u.lang <> 'java' AND u.name = regexp_extract(callee, '([^.]+)$', 1))
        SELECT src, dst, type, CAST(line AS INTEGER) AS line, CAST(confidence AS DOUBLE) AS confidence FROM r""",
    "call_sites": f"""{_W}, {_CALLS}, a AS (SELECT regexp_replace(callee, '[0-9]+', '#', 'g') AS callee, type FROM calls) SELECT callee, CASE type WHEN 'js' THEN 'direct' ELSE type END AS type, CAST(CASE WHEN type = 'direct' THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence,
        count(*) AS n, CASE WHEN type = 'js' THEN NULL ELSE count(*) END AS n_args FROM a GROUP BY callee, a.type""",
    "code_imports": f"{_W} SELECT DISTINCT path, CASE WHEN module = home THEN 'os' ELSE 'm' || home END AS module, CASE WHEN module = home THEN 'os' ELSE 'm' || home END AS name, 'direct' AS kind FROM code WHERE lang = 'python'",
    "file_dependencies": f"{_W} SELECT DISTINCT c.path AS src, h.path AS dst FROM code c JOIN code h ON h.module = c.home WHERE c.lang = 'python' AND c.module <> c.home",
    "assignment_flows": f"""{_W} SELECT path, name AS scope, name || '::' || CASE kind WHEN 0 THEN 'request' WHEN 4 THEN 'i' ELSE 'val' END AS src, name || '::' || CASE kind WHEN 0 THEN 'q' WHEN 4 THEN 'y' ELSE 'val' END AS dst,
        CAST(line + 1 AS INTEGER) AS line, CASE WHEN kind IN (0, 4) THEN 'direct' ELSE 'return' END AS kind, kind = 2 AS sanitized FROM code WHERE lang = 'python' AND kind NOT IN (1, 5)""",
    "line_functions": f"""{_W}, f AS (SELECT path, 3 * any_value(n) + CASE any_value(lang) WHEN 'python' THEN 2 WHEN 'javascript' THEN 1 ELSE 3 END AS size FROM code GROUP BY path),
        p AS (SELECT path, unnest(range(1, size + 1, 3)) AS line FROM f)
        SELECT p.path, CAST(p.line AS INTEGER) AS line, c.name AS "function" FROM p LEFT JOIN code c ON c.path = p.path AND p.line BETWEEN c.line AND c.line + 2""",
    "taint_ends": f"""{_W} SELECT {_NODE} AS node, CASE kind WHEN 0 THEN 'user_input' ELSE 'file_input' END AS kind, 'source' AS danger FROM code WHERE lang = 'python' AND kind IN (0, 6)
        UNION ALL SELECT {_NODE}, CASE kind WHEN 1 THEN 'sql_query' WHEN 3 THEN 'command_exec' ELSE 'response_output' END, CASE WHEN kind IN (1, 3) THEN 'high' ELSE 'medium' END FROM code WHERE lang = 'python' AND kind IN (1, 3, 5)""",
    "input_functions": f"{_W}, m AS (SELECT DISTINCT module FROM code WHERE lang = 'python' AND kind = 0) SELECT {_NODE} AS node, kind = 0 AS own FROM code WHERE lang = 'python' AND module IN (SELECT module FROM m)",
    "import_relations": f"{_W} SELECT h.path || '::' || h.name AS src, c.path || '::' || c.name AS dst FROM code c JOIN code h ON h.module = c.home AND h.pos = 1 WHERE c.lang = 'python' AND c.module <> c.home",
    "pattern_relations": f"""{_W}, {_CALLS}, r AS (SELECT path AS id, 'call' AS kind, name AS target FROM code WHERE lang = 'python'
            UNION SELECT path, 'call', regexp_extract(callee, '([^.]+)$', 1) FROM calls WHERE type <> 'js'
            UNION SELECT path, 'assignment', CASE kind WHEN 0 THEN 'q' WHEN 4 THEN 'y' ELSE 'val' END FROM code WHERE lang = 'python' AND kind NOT IN (1, 5)
            UNION SELECT path, 'import', CASE WHEN module = home THEN 'os' ELSE 'm' || home END FROM code WHERE lang = 'python'
            UNION SELECT path, 'attribute', 'm' || home FROM code WHERE lang = 'python' AND module <> home AND pos = n
            UNION SELECT path, 'attribute', CASE kind WHEN 0 THEN 'request' ELSE 'cursor' END FROM code WHERE lang = 'python' AND kind IN (0, 1)) SELECT * FROM r""",
    "cross_file_findings": f"""{_W}, t(type, sink, safe, severity, confidence, cwe, owasp) AS (VALUES {_RULES}),
        j AS (SELECT t.*, a.path || '::' || a.name AS source, b.path || '::' || b.name AS target, a.n - a.pos + b.pos AS depth FROM t JOIN code a ON a.kind = 0 AND a.lang = 'python' AND a.module <> a.home JOIN code b ON b.module = a.home AND b.kind = t.sink
            WHERE NOT EXISTS (SELECT 1 FROM code x WHERE x.kind = t.safe AND ((x.module = a.module AND x.pos >= a.pos) OR (x.module = b.module AND x.pos <= b.pos)))
            UNION ALL SELECT t.*, a.path || '::' || a.name, b.path || '::' || b.name, NULL FROM t JOIN code a ON a.kind = 0 AND a.module = a.home AND a.pos = 1 JOIN code b ON b.home = a.module AND b.module <> a.module AND b.lang = 'python' AND b.kind = t.sink),
        s AS (SELECT {_NODE} AS node FROM code c WHERE lang = 'python' AND kind = 8 AND NOT EXISTS (SELECT 1 FROM code x WHERE x.kind = 7 AND x.lang = 'python'
            AND ((x.module = c.module AND x.pos < c.pos) OR (x.home = c.module AND x.module <> c.module) OR (x.module = c.home AND x.module <> c.module AND x.pos = 1))))
        SELECT type, severity, source, target, CAST(depth AS BIGINT) AS depth, CAST(confidence AS DOUBLE) AS confidence, cwe, owasp FROM j
        UNION ALL SELECT 'Cross-File Authorization Bypass', 'CRITICAL', node, node, 0, 0.6, 'CWE-285', 'A01:2021' FROM s""",
}
SQL["security_run"] = f"""WITH u AS (SELECT 'cross file' AS origin, type, severity, source, confidence FROM ({SQL["cross_file_findings"]}) a
    UNION ALL SELECT 'flow', type, CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' ELSE 'medium' END, CAST(src AS VARCHAR), risk FROM ({graphs.SQL["taint_flows"]}) b WHERE risk >= 0.6)
    SELECT origin, type, severity, count(*) AS n, count(DISTINCT source) AS sources, round(max(confidence), 6) AS most FROM u GROUP BY origin, type, severity"""
