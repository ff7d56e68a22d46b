"""Lines and edges read once give what they gave: assignments, calls, ends of edges."""

from pyspark.sql import functions as F

from codeglint.operators import context as C
from codeglint.operators import reports as R

LINES = ("aa = 1", "aa == bb", "éaa(bb)", "cc.aa (bb)", "g(h(aa), bb)", "g(aa(bb) cc(dd)", "ff(", "x9=aa;y9  =bb", "g()aa(bb)", "aaa" * 2000, "no sign", "[aa](bb)", "q(aa\\)")


def test_dependencies(spark):
    files = spark.createDataFrame([("p", "\n".join(LINES))], "path string, content string")
    findings = spark.createDataFrame([("1", "p", 99, "aa bb"), ("2", "p", 1, "x9 y9 cc"), ("3", "p", 3, "dd")], "id string, path string, start_line int, snippet string")
    got = {(r.id, r.line, r.reason) for r in C.dependency_windows(findings, files, 99).collect()}
    want = set()
    lines = files.select(F.posexplode(F.split("content", "\n")).alias("i", "t"))
    words = lambda a: F.regexp_extract_all(a, F.lit(r"[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0))
    read = lines.select("i", F.regexp_extract_all("t", F.lit(r"\b(\w+)\s*="), F.lit(1)).alias("a"), F.flatten(F.transform(F.regexp_extract_all("t", F.lit(r"\w+\(([^)]*)\)"), F.lit(1)), words)).alias("c"))
    for r in read.collect():
        for f, at, asked in (("1", 99, {"aa", "bb"}), ("2", 1, {"x9", "y9", "cc"}), ("3", 3, {"dd"})):
            if r.i + 1 != at:
                want |= {(f, r.i + 1, f"data_dependency_{k}") for k, known in (("assignment", r.a), ("call", r.c)) if asked & set(known)}
    assert got == want and len(want) > 8


def test_both_ends_of_edges(spark):
    units = spark.createDataFrame([("a", 1, 2, "def a(x):\n  if x: b(c.d (x))"), ("b", 3, 3, "éf(x)"), ("b", 5, 9, "pass"), ("z", 1, 1, "")], "unit string, start_line int, end_line int, code string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "print"), ("b", "a")], "src string, dst string")
    m = R.structure_metrics(units, edges)
    assert sorted(tuple(r) for r in m.collect()) == [("a", 2, 6, 3, 2), ("b", 1, 2, 1, 1), ("b", 5, 5, 1, 1), ("z", 1, 1, 0, 0)]
    assert m._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
