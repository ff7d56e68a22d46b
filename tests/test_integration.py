"""Compositions of operators."""

import datetime

from pyspark.sql import functions as F

from codeglint.operators import detect, graph, integration


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


FINDING = "id string, batch int, type string, file_path string, start_line int, description string, snippet string, severity string, confidence double, task_id int"


def test_integration(spark):
    rows = [("a", 1, "sql injection", "f.py", 1, "d", "select", "high", 0.9, 1), ("b", 1, "sql injection", "f.py", 3, "d", "select", "high", 0.8, 2), ("c", 1, "xss", "g.py", 9, "z", "eval", "low", None, 1), ("d", 1, "xss", "g.py", 9, "z", "eval", "low", 0.1, 1)]
    results, metrics = integration.integrated(spark.createDataFrame(rows, FINDING), ["batch"])
    assert {(r.id, r.n, r.confidence) for r in results.collect()} == {("a", 2, 0.9), ("c", 1, 0.5)}
    m = metrics.first()
    assert (m.n_findings, m.n_clusters, m.multi) == (3, 2, 1)


def test_validation(spark):
    rows = [("a", "sql injection", "src/f.py", "cursor.execute(select x where or 1=1; if (a) {})", "high"), ("b", "xss", "tests/f.py", "x", "low"), ("c", "xss", "src/g.py", "y", "low")]
    f = spark.createDataFrame(rows, "id string, type string, file_path string, snippet string, severity string")
    v = spark.createDataFrame([("a", 0.9, True, 1.0), ("a", 0.95, True, 1.0), ("a", 0.92, True, 1.0), ("c", 0.9, False, 1.0)], "finding_id string, confidence double, is_valid boolean, weight double")
    got = integration.validated(f, v)
    by = {r.id: r for r in got.collect()}
    assert by["b"].false_positive and by["b"].reason == "rule" and by["b"].status == "rejected"
    assert by["a"].status in ("validated", "needs_review") and by["a"].confidence > by["c"].confidence
    s = integration.validation_summary(got).first()
    assert s.n == 3 and s.validated + s.needs_review + s.rejected == 3


def test_flows_and_paths(spark):
    f = spark.createDataFrame([("x", 0.9, 3, 1, 2), ("x", 0.6, 2, 1, 3), ("y", 0.2, 1, 2, 3)], "type string, risk double, level int, src int, dst int")
    r = integration.flow_report(f).first()
    assert (r.n, r.high, r.medium, r.sanitized, r.by_type) == (3, 1, 1, 0.333333, {"x": 2, "y": 1})
    assert {x.severity for x in integration.flows_as_findings(f).collect()} == {"critical", "high", "low"}
    e = spark.createDataFrame([(1, 2), (2, 3), (2, 4)], "src int, dst int")
    assert {(x.node, x.role) for x in integration.entry_exit(e).collect()} == {(1, "entry"), (3, "exit"), (4, "exit")}
    p = graph.simple_paths(e, 4, spark.createDataFrame([(1,)], "src int"))
    assert [x.path for x in integration.maximal_paths(p, 5).orderBy("dst").collect()] == [[1, 2, 3], [1, 2, 4]]
    assert integration.maximal_paths(p, 1).count() == 1


def test_small_ones(spark):
    c = spark.createDataFrame([("T", "HIGH", "a", "b", "a::f", "b::g", 0.8, "CWE-1", "A1")], "type string, severity string, source_file string, target_file string, source string, target string, confidence double, cwe string, owasp string")
    assert integration.as_findings(c).first().severity == "high" and detect is not None
    u = spark.createDataFrame([("p", "n", 1), ("p", "n", 2)], "path string, name string, ord int")
    assert [r.ord for r in integration.entities(u, "ord").collect()] == [2]
    t = spark.createDataFrame([(datetime.datetime(2024, 1, 1),), (datetime.datetime(2024, 3, 1),)], "ts timestamp")
    assert integration.retained(t, "ts", "2024-03-02 00:00:00", 30).count() == 1
    null = F.lit(None).cast("double")
    assert one(spark, integration.context_score(F.lit(5), null, F.lit(5), null)) == 0.75 and one(spark, integration.context_score(null, null, null, null)) == 0.0
    assert one(spark, integration.impact_level(F.lit(20), F.lit(3), F.array(F.lit("delete_user"), F.lit("admin")))) == "medium"
    k = spark.createDataFrame([("a", [("C1", "HIGH", ["u", "v"]), ("C2", "LOW", ["u"])]), ("b", [])], "id string, cves array<struct<cve_id:string,severity:string,references:array<string>>>")
    assert {(r.id, r.cve_id, tuple(r.references)) for r in integration.flat_knowledge(k).collect()} == {("a", "C1", ("u", "v")), ("b", None, ())}
    s = integration.ab_summary(spark.createDataFrame([(10.0, 8.0, True), (10.0, 12.0, False)], "control_mean double, treatment_mean double, significant boolean")).first()
    assert (s.n, s.improved, s.worsened) == (2, 0, 1)
