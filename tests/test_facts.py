"""Facts of files: one parse a file, arrays beside the file, edges resolved within it, windows without pairs of files and functions."""

import ast

from codeglint.operators import detect, parsers

CODE = "import os\nfrom m import z\ndef a(x):\n    return b(x)\nclass K:\n    def b(self):\n        return self.c(lambda: 1)\n    def c(self):\n        if a(1): os.walk(2)\n"


def test_a_file_is_parsed_once(monkeypatch):
    n, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a, **k: n.append(1) or parse(*a, **k))
    units, calls, imports, edges = parsers.facts_of("k.py", CODE, "python", ("units", "calls", "imports", "edges"))
    assert len(n) == 1
    assert [(u[2], u[12]) for u in units] == [("k.py", 1), ("a", 1), ("K", 1), ("K.b", 2), ("K.c", 2)]
    assert {(c[1], c[2], c[6]) for c in edges} == {("a", "b", "K.b"), ("K.b", "c", "K.c"), ("K.c", "a", "a"), ("K.c", "os.walk", None)}
    assert {i[2] for i in imports} == {"os", "z"} and len(calls) == 4


def test_facts_beside_files(spark):
    rows = [("k.py", CODE, "python"), ("bad.py", "def (", "python"), ("n.py", None, "python"), ("x.js", "function f(a) {\n  return g(a);\n}\n", "javascript")]
    files = spark.createDataFrame(rows, "path string, content string, language string")
    parsed = parsers.with_facts(files, "units", "edges")
    key = lambda df: sorted(map(str, df.collect()))
    columns = parsers.code_units(files).columns
    assert key(parsers.exploded(parsed, "units").select(columns)) == key(parsers.code_units(files))
    assert key(parsers.call_edges(parsed)) == key(parsers.call_edges(files))
    code = {r.node: r.code for r in detect.entities(parsed).collect()}
    assert code["k.py::K.c"] == "    def c(self):\n        if a(1): os.walk(2)" and set(code) == {"k.py::a", "k.py::K.b", "k.py::K.c", "x.js::f"}


def test_windows_are_made_where_the_file_is(spark):
    from pyspark.sql import functions as F

    from codeglint.operators import context as C

    text = "def a(vv):\n    ww = vv\n    if ww: return g(vv)\n\ndef b(vv):\n    return h(vv, ww)\n"
    files = spark.createDataFrame([("p.py", text), ("q.py", "x = 1\n"), ("n.py", None)], "path string, content string")
    findings = spark.createDataFrame([("1", "p.py", 2, "ww = vv"), ("2", "p.py", 6, "return h(vv, ww)"), ("3", "gone.py", 1, "vv"), ("4", "n.py", 1, "vv"), ("5", "q.py", 1, None)], "id string, path string, start_line int, snippet string")
    beside = C.in_files(findings, files)
    got = {}
    for build in (C.variable_windows, C.control_windows, C.dependency_windows, C.similar_lines):
        alone = build(None, beside.select("*"))
        assert sorted(map(str, alone.collect())) == sorted(map(str, build(findings, files).collect()))
        got[build.__name__] = {(r.id, r.line, r.reason.rsplit("_", 1)[-1]) for r in alone.collect()}
        found = F.array(F.struct(F.lit("1").alias("id"), F.lit(2).alias("start_line"), F.lit("ww = vv").alias("snippet")))
        assert "Exchange" not in build(None, files.withColumn("found", found))._jdf.queryExecution().executedPlan().toString()
    assert got["control_windows"] == {("1", 3, "flow"), ("1", 6, "flow"), ("2", 3, "flow")}
    assert got["dependency_windows"] == {("1", 1, "call"), ("1", 3, "call"), ("1", 5, "call"), ("1", 6, "call"), ("2", 1, "call"), ("2", 2, "assignment"), ("2", 3, "call"), ("2", 5, "call")}
    assert {x for x in got["variable_windows"] if x[0] == "2"} == {("2", 1, "vv"), ("2", 2, "vv"), ("2", 2, "ww"), ("2", 3, "vv"), ("2", 3, "ww")}
    units = spark.createDataFrame([("p.py", "function", 1, 3), ("p.py", "function", 5, 6)], "path string, type string, start_line int, end_line int")
    around = {(r.id, r.start_line, r.end_line) for r in C.function_windows(findings.filter("path <> 'n.py'"), files, units).collect()}
    assert around == {("1", 1, 3), ("2", 5, 6), ("5", 1, 2)}
