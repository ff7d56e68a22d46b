"""Scores at values computed by hand."""

import pytest
from pyspark.sql import functions as F

from codeglint.functions import scoring as S
from codeglint.functions import text as X
from codeglint.operators import findings as O
from codeglint.operators import telemetry as T
from codeglint.operators import validation as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def m(template):
    return S.cvss_metrics(F.lit(template))


def values():
    """(column, value); columns need a session."""
    return [
        (S.cvss_exploitability(m("NLNNNHHHHHH")), 8.22), (S.cvss_impact(m("NLNNNHHHHHH")), 6.0), (S.cvss_base(m("NLNNNHHHHHH")), 10.0), (S.cvss_exploitability(m("PHPHAHHHHHH")), 2.982874), (S.cvss_base(m("PHPHAHHHHHH")), 9.0),
        (S.taint_risk(F.lit("user_input"), F.lit("sql_query"), F.lit(3), F.lit(2), F.lit(0.9)), 1.0), (S.taint_risk(F.lit("file_input"), F.lit("response_output"), F.lit(2), F.lit(4), F.lit(0.9)), 0.5544),
        (S.taint_risk(F.lit("user_input"), F.lit("command_exec"), F.lit(1), F.lit(3), F.lit(0.9)), 0.2916),
        (S.location_similarity(F.lit("a/b.py"), F.lit(1), F.lit("a/b.py"), F.lit(1)), 1.0), (S.location_similarity(F.lit("a/b.py"), F.lit(1), F.lit("a/b.py"), F.lit(6)), 0.8),
        (S.location_similarity(F.lit("a/b.py"), F.lit(1), F.lit("a/b.py"), F.lit(21)), 0.6), (S.location_similarity(F.lit("a/b.py"), F.lit(1), F.lit("a/b.py"), F.lit(22)), 0.4),
        (S.location_similarity(F.lit("a/b.py"), F.lit(1), F.lit("c/b.py"), F.lit(1)), 0.3), (S.location_similarity(F.lit("a/b.py"), F.lit(1), F.lit("c/b.js"), F.lit(1)), 0.2),
        (S.audit_risk(F.lit("security_violation"), F.lit("failure"), F.lit("restricted")), 1.0), (S.audit_risk(F.lit("data_access"), F.lit("partial"), F.lit("public")), 0.24),
        (X.token_estimate(F.lit("a b c d")), 5), (X.token_estimate(F.lit("漢字漢字漢字")), 4), (S.performance_score(F.lit(6.0), F.lit(0.06), F.lit(3.0), F.lit(0.85)), 50.0),
        (X.token_similarity(F.lit(""), F.lit("")), 1.0), (X.token_similarity(F.lit("a"), F.lit("")), 0.0), (X.token_similarity(F.lit("a b"), F.lit("b c")), 1 / 3),
        (S.timeliness(F.lit(10.0)), 0.9), (S.timeliness(F.lit(90.0)), 0.0), (S.backoff(F.lit(3), 1.0, 60.0, "exponential"), 8.0), (S.backoff(F.lit(5), 1.0, 60.0, "fibonacci"), 8.0), (S.backoff(F.lit(9), 1.0, 60.0, "exponential"), 60.0),
        (X.nesting_depth(F.lit("f(a[{1}])}{")), 3), (X.truncated(F.lit("ab\ncdef"), 5), "ab..."), (X.safe_filename(F.lit('a/b:c"')), "a_b_c_"), (X.provider_of(F.lit("qwen:7b")), "ollama"),
        (X.visibility(F.lit("__init__")), "special"), (X.visibility(F.lit("__x")), "private"), (X.code_to_pattern(F.lit('q = "x" + 12')), r'\w+ = "\.*?" \+ \d+'.replace(r"\.*?", ".*?")),
        (S.alert_level("error_rate", F.lit(0.3)), "critical"), (S.quality_alert(F.lit("accuracy"), F.lit(0.6)), "high"), (V.protected_context(F.lit("validate escape check"), F.lit(None).cast("array<string>")), 0.9),
        (X.normal_code(F.lit("x = 'a' # note\ny=12"), F.lit("python")), 'x = "" y=0'), (X.task_seconds(F.lit("security_scan"), F.lit(60), F.lit(2000)), 7.8), (X.error_category(F.lit("ConnectionError"), F.lit("")), "network"),
    ]


def test_values(spark):
    pairs = values()
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(pairs)]).first()
    for x, (column, expected) in zip(got, pairs):
        assert x == (pytest.approx(expected, abs=1e-6) if isinstance(expected, float) else expected), column


def test_arrays(spark):
    assert one(spark, X.char_chunks(F.lit("x" * 1800))) == ["x" * 1000, "x" * 1000]
    assert one(spark, X.char_chunks(F.lit(""))) == []
    assert [tuple(r) for r in one(spark, X.fenced_code(F.lit("```py\na\n```\n```\nb\n```")))] == [("py", "a\n"), ("text", "b\n")]
    assert [r.severity for r in one(spark, X.mock_analysis(F.lit("eval(x); password = 1")))] == ["high", "medium"]
    assert one(spark, X.snippet_variables(F.lit("for item in items: use(item)"))) == ["item", "items", "use"]
    assert one(spark, X.search_terms(F.lit("SQL Injection"), F.lit("exec()"))) == ["database", "exec", "injection", "sql"]


@pytest.mark.parametrize("tp, fp, tn, fn, want", [(85, 5, 90, 10, (0.921053, 0.944444, 0.894737, 0.918919, 0.052632, 0.105263)), (78, 12, 88, 8, (0.892473, 0.866667, 0.906977, 0.886364, 0.12, 0.093023))])
def test_confusion(spark, tp, fp, tn, fn, want):
    rows = [(1, True, True)] * tp + [(1, True, False)] * fp + [(1, False, False)] * tn + [(1, False, True)] * fn
    r = T.confusion(spark.createDataFrame(rows, "k int, predicted boolean, actual boolean"), ["k"]).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.fpr, r.fnr) == pytest.approx(want, abs=1e-6)


def test_consensus(spark):
    v = spark.createDataFrame([(1, 0.9, True, 1.0), (1, 0.8, True, 1.0), (1, 0.7, False, 2.0), (2, 0.5, False, 1.0), (2, 0.4, False, 1.0)], "finding_id int, confidence double, is_valid boolean, weight double")
    got = {n: {r.finding_id: (r.valid, r.score, r.reached) for r in O.consensus(v, n).collect()} for n in O.CONSENSUS}
    assert got["majority"][1] == (True, 0.333333, False) and got["unanimous"][2] == (False, 1.0, True)
    assert got["weighted"][1][0] is False and got["threshold"][2] == (False, 0.0, False)


def test_exclusive_quantile(spark):
    import statistics

    values = [float(x * x % 97) for x in range(41)]
    got = one(spark, T.exclusive_quantile(F.array(*[F.lit(v) for v in values]), 0.95))
    assert got == pytest.approx(statistics.quantiles(values, n=20)[18])
    assert one(spark, T.exclusive_quantile(F.array(F.lit(1.0), F.lit(2.0)), 0.95)) == 0.0


def test_system_status(spark):
    rows = [(i, s) for i, s in enumerate(["warning"] * 2 + ["healthy"] * 4)]
    assert T.system_status(spark.createDataFrame(rows, "component int, status string")).first().status == "warning"
    assert T.system_status(spark.createDataFrame([], "component int, status string")).first().status == "unknown"


def test_greedy_clusters(spark):
    f = [("a", 1, "sql injection", "f.py", 1, "d e", "select", "high", 0.9), ("b", 1, "sql injection", "f.py", 2, "d e", "select", "high", 0.8), ("c", 1, "xss", "g.py", 50, "z", "eval", "low", 0.7)]
    df = spark.createDataFrame(f, "id string, batch int, type string, file_path string, start_line int, description string, snippet string, severity string, confidence double")
    assert {r.id: r.cluster_id for r in O.greedy_clusters(df, ["batch"]).collect()} == {"a": "a", "b": "a", "c": "c"}
    pairs = O.similar_pairs(df, ["batch"], 0.8).collect()
    assert [(r.a_id, r.b_id) for r in pairs] == [("a", "b")]
