"""Parsers and detection on a small tree of code."""

import pytest
from pyspark.sql import functions as F

from codeglint.operators import detect, graph, parsers

APP = '''
import db
from safe import clean

def handler(request):
    q = request.args.get("q")
    return db.run(q)

def careful(request):
    return db.run(clean(request.args["q"]))

class View:
    def show(self, x):
        def inner(y):
            return helper(y)
        return self.draw(inner(x))

    async def draw(self, x: int) -> str:
        return str(x) if x else ""
'''
DB = '''
def run(sql):
    return cursor.execute(sql)

def delete_all():
    run("x")
'''
SAFE = "def clean(x):\n    return escape(x)\n"
CLI = "import os\ndef main():\n    os.system(argv[1])\n    main()\n"
JS = "function load(a) {\n  if (a) { return '}'; }\n}\nclass Box {\n  open(x) {\n    return x ? 1 : 2;\n  }\n  _hidden() {\n  }\n}\nconst f = (a) => {\n  load(a);\n};\n"
JAVA = "public class A {\n  // void no() {\n  public static int go(int x) {\n    while (x > 0) { x--; }\n    return x;\n  }\n}\n"
FILES = [("app.py", APP, "python"), ("db.py", DB, "python"), ("safe.py", SAFE, "python"), ("cli.py", CLI, "python"), ("broken.py", "def (:\n", "python"), ("util.js", JS, "javascript"), ("A.java", JAVA, "java"), ("x.css", "a{}", "css")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, content string, language string")


def test_units(files):
    u = {(r.path, r.type, r.name): r for r in parsers.code_units(files).collect()}
    assert {k for k in u if k[0] == "app.py"} == {("app.py", "file", "app.py"), *(("app.py", "function", n) for n in ("handler", "careful", "inner")), ("app.py", "class", "View"), ("app.py", "method", "View.show"), ("app.py", "method", "View.draw")}
    draw = u["app.py", "method", "View.draw"]
    assert draw.is_async and draw.returns == "str" and draw.params == ["self", "x"] and draw.parent_id == u["app.py", "class", "View"].id
    assert {k[1:] for k in u if k[0] == "util.js"} == {("file", "util.js"), ("function", "load"), ("class", "Box"), ("method", "Box.open"), ("function", "f")}
    assert (u["util.js", "function", "load"].end_line, u["util.js", "class", "Box"].end_line, u["util.js", "method", "Box.open"].complexity) == (3, 10, 2)
    assert {k[1:] for k in u if k[0] == "A.java"} == {("file", "A.java"), ("class", "A"), ("method", "A.go")} and u["A.java", "method", "A.go"].end_line == 6
    assert {k[1:] for k in u if k[0] in ("broken.py", "x.css")} == {("file", "broken.py"), ("file", "x.css")}


def test_calls_and_edges(files):
    e = {(r.src, r.dst): r.type for r in parsers.call_edges(files).collect()}
    assert e["app.py::handler", "db.py::run"] == "indirect" and e["app.py::careful", "safe.py::clean"] == "direct"
    assert e["cli.py::main", "cli.py::main"] == "recursive" and e["app.py::View.show", "app.py::View.draw"] == "method"
    assert e["util.js::f", "util.js::load"] == "direct" and not any(a.startswith("util.js::load") for a, _ in e)
    assert ("app.py::inner", "helper") in e and ("db.py::delete_all", "db.py::run") in e


def test_imports(files):
    found = parsers.imports(files)
    assert {(r.path, r.module) for r in found.collect()} == {("app.py", "db"), ("app.py", "safe"), ("cli.py", "os")}
    assert {(r.src, r.dst) for r in parsers.file_dependencies(files, found).collect()} == {("app.py", "db.py"), ("app.py", "safe.py")}


def test_flows(spark):
    code = "def f(a):\n    b = a\n    c = html.escape(b)\n    d, e = c, b\n"
    got = {(r.src, r.dst, r.kind, r.sanitized) for r in parsers.flows(spark.createDataFrame([("p.py", code, "python")], "path string, content string, language string")).collect()}
    assert {("f::a", "f::b", "direct", False), ("f::b", "f::c", "return", True), ("f::c", "f::d", "direct", False)} <= got


def test_enclosing_function(spark, files):
    points = spark.createDataFrame([("app.py", 15), ("app.py", 2), ("db.py", 3), ("none.py", 1)], "path string, line int")
    got = {(r.path, r.line): r.function for r in parsers.enclosing_function(points, parsers.code_units(files)).collect()}
    assert got == {("app.py", 15): "inner", ("app.py", 2): None, ("db.py", 3): "run", ("none.py", 1): None}


def test_audit(files):
    found = {(r.type, r.source, r.target) for r in detect.audit(files).collect()}
    assert ("Cross-File SQL Injection", "app.py::handler", "db.py::run") in found
    assert not any(s == "app.py::careful" and t == "Cross-File XSS" for t, s, _ in found)
    assert ("Cross-File Authorization Bypass", "db.py::delete_all", "db.py::delete_all") in found


def test_protection_takes_pairs_away(spark):
    nodes = [("a::f", "a", "f", "request.args"), ("b::g", "b", "g", "escape(x)"), ("c::h", "c", "h", "cursor.execute(x)")]
    df = spark.createDataFrame([(*n, n[3]) for n in nodes], "node string, path string, name string, code string, file_code string")
    chain = spark.createDataFrame([("a::f", "b::g"), ("b::g", "c::h")], "src string, dst string")
    kinds = lambda e: {r.type for r in detect.cross_file_findings(df, e).collect()}
    assert kinds(chain) == set()
    assert "Cross-File SQL Injection" in kinds(chain.union(spark.createDataFrame([("a::f", "c::h")], "src string, dst string")))


def test_import_related(files):
    nodes = detect.entities(files)
    assert ("db.py::run", "app.py::handler") in {(r.src, r.dst) for r in detect.import_related(nodes).collect()}
    sources, sinks = detect.taint_ends(nodes)
    assert {r.source_type for r in sources.filter("node = 'app.py::handler'").collect()} == {"user_input"}
    assert {(r.sink_type, r.danger) for r in sinks.filter("node = 'cli.py::main'").collect()} == {("command_exec", "high")}


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7)]


def test_graph(spark):
    e = spark.createDataFrame(EDGES, "src int, dst int")
    d = {(r.src, r.dst): r.depth for r in graph.distances(e, 9).collect()}
    assert d == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (3, 4): 1, (5, 5): 1, (6, 7): 1, (1, 3): 2, (2, 1): 2, (2, 4): 2, (3, 2): 2, (1, 1): 3, (2, 2): 3, (3, 3): 3, (1, 4): 3}
    assert {r.node: r.length for r in graph.on_cycles(e, 9).collect()} == {1: 3, 2: 3, 3: 3, 5: 1}
    assert {r.node: r.component for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    paths = graph.simple_paths(e, 5, spark.createDataFrame([(1,)], "src int"), spark.createDataFrame([(4,)], "dst int")).collect()
    assert [r.path for r in paths] == [[1, 2, 3, 4]]
    dag = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (8, 9), (9, 8)], "src int, dst int")
    nodes = dag.select(F.col("src").alias("node")).union(dag.select("dst"))
    assert {r.node: r.layer for r in graph.layers(nodes, dag).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 8: 3, 9: 3}
    assert graph.layers(nodes.limit(0), dag).count() == 0
