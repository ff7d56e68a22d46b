"""Knowledge operators and registers."""

import pytest
from pyspark.sql import functions as F

from codeglint.functions.registry import Rules, Thresholds, Weights
from codeglint.operators import knowledge as N


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lookup_and_targets(spark):
    q = spark.createDataFrame([(1, "inject"), (2, "zzz"), (3, "")], "query_id int, query string")
    k = spark.createDataFrame([("A03", "Injection", ""), ("A01", "Access", "no injection here")], "item string, name string, description string")
    assert {(r.query_id, r.item) for r in N.lookup(q, k).collect()} == {(1, "A03"), (1, "A01")}
    units = spark.createDataFrame([("u1", "load_user", "a.py"), ("u2", "load", "b.py"), ("u3", "user", "a.py"), ("u4", "load", "a.py")], "unit string, name string, path string")
    refs = spark.createDataFrame([(1, "load", "a.py"), (2, "load_u", "z.py"), (3, "get_user_now", "a.py"), (4, "nothing", "a.py"), (5, "x", "a.py")], "ref_id int, target string, path string")
    assert {r.ref_id: r.unit for r in N.fuzzy_targets(refs, units).collect()} == {1: "u4", 2: "u1", 3: "u3"}


def test_context_and_relations(spark):
    units = spark.createDataFrame([(f"u{i}", "a.py", i) for i in range(6)] + [("v", "b.py", 1)], "unit string, path string, start_line int")
    edges = spark.createDataFrame([("u0", f"u{i}") for i in (5, 4, 3, 2)], "src string, dst string")
    got = {r.unit: r for r in N.unit_context(units, edges).collect()}
    assert got["u0"].siblings == ["u1", "u2", "u3"] and got["u0"].successors == ["u2", "u3", "u4"] and got["v"].siblings == []
    r = N.relations(spark.createDataFrame([("w", "import os\nx = run(y)\nx = run(z.a)")], "id string, text string")).collect()
    assert {(x.kind, x.target) for x in r} == {("import", "os"), ("assignment", "x"), ("call", "run"), ("attribute", "z")}
    w = F.array(*[F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit(c).alias("content")) for a, b, c in ((5, 9, "b"), (1, 4, "a"), (6, 8, "in b"))])
    assert one(spark, N.stitched(w)) == "a\n...\nb"
    assert one(spark, N.remediation(F.lit("SQL Injection"))) == "use parameterised queries" and one(spark, N.remediation(F.lit("odd"))).startswith("validate")


def test_chunks(spark):
    text = "a b c\n\nd e f\n\n" + "one two three. " * 6 + "\n\ng"
    parts = N.packed_paragraphs(text, 8)
    assert [w for p in parts for w in p.split()] == text.split() and all(int(len(p.replace(".", "").split()) * 1.3) <= 8 for p in parts)
    assert N.packed_paragraphs("", 5) == [] and N.packed_paragraphs("a b\n\nc d\n\ne f", 5, 3) == ["a b\n\nc d", "c d\n\ne f"]
    d = spark.createDataFrame([(1, None), (2, "x")], "id int, t string")
    assert [tuple(r) for r in N.paragraph_chunks(d, "id", "t").collect()] == [(2, 0, "x")]


@pytest.mark.parametrize("reply, valid, confidence", [('so {"is_valid": true, "confidence": 0.9} ok', True, 0.9), ("This is a false positive, 80%", False, 0.8), ("confirmed", True, 0.5), ("", False, 0.5)])
def test_model_verdict(spark, reply, valid, confidence):
    assert tuple(one(spark, N.model_verdict(F.lit(reply)))) == (valid, confidence)


def test_reply_issues(spark):
    r = spark.createDataFrame([("a", "intro\n1. Critical: eval\nmore\n- low note\n"), ("b", "nothing")], "id string, reply string")
    assert [(x.n, x.severity, x.text) for x in N.reply_issues(r).orderBy("n").collect()] == [(1, "critical", "1. Critical: eval more"), (2, "low", "- low note ")]


def test_path_risk(spark):
    kinds = F.array(F.lit("direct"), F.lit("return"))
    assert one(spark, N.path_risk(F.lit(3), kinds, F.lit(0), F.lit("high"))[0]) == pytest.approx(0.98)
    assert one(spark, N.path_risk(F.lit(3), kinds, F.lit(2))[1]) == "sanitized"


def test_messages(spark):
    m = spark.createDataFrame([(1, "a", "b", 1), (2, "a", None, 2), (3, "c", "b", 3)], "message_id int, sender string, receiver string, ts int")
    agents = spark.createDataFrame([("a",), ("b",), ("c",)], "agent string")
    assert {tuple(r) for r in N.delivered(m, agents).collect()} == {(1, "b"), (2, "b"), (2, "c"), (3, "b")}
    assert [r.message_id for r in N.history_of(m, "b", 1).collect()] == [3]


def test_registers(spark):
    r = Rules(big=lambda: F.col("x") > 5).add("odd", lambda: F.col("x") % 2 == 1)
    df = spark.createDataFrame([(7,), (2,)], "x int")
    assert [x.rules for x in r.apply(df).collect()] == [["big", "odd"], []] and [x.rules for x in r.remove("big").remove("odd").apply(df).collect()] == [[], []]
    w = Weights({"a": 1.0, "b": 3.0}).update(a=3.0)
    assert w.values == {"a": pytest.approx(0.8), "b": pytest.approx(0.2)} and one(spark, w.mean({"a": F.lit(1.0), "b": F.lit(0.0)})) == pytest.approx(0.8)
    with pytest.raises(ValueError):
        w.update(a=-1.0)
    t = Thresholds({"m": (("error", 2.0), ("warning", 1.0))}).set("m", "critical", 3.0)
    assert [one(spark, t.level("m", F.lit(v))) for v in (0.5, 1.5, 2.5, 9.0)] == [None, "warning", "error", "critical"]
