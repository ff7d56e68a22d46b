"""Patterns are tried only where their first characters are, with the same answers."""

from pyspark.sql import functions as F

from codeglint.functions import rules
from codeglint.functions.scoring import any_regex
from codeglint.functions.text import leading, matches_any
from codeglint.operators import detect


def test_first_characters():
    want = {r"request\.": "request.", r"open\s*\(.*[\"']w": "open", r"SELECT\s+.*FROM": "SELECT", r"\{% .*%\}": "{% ", "argv": "argv", "argv?x": "arg", r"ab\.*c": "ab", r"a\.?": None, "ab|c": None, r"\w+x": None, "x": None, r"(ab)c": None, r"ab{2}": None}
    assert {p: leading(p) for p in want} == want


def test_matches_stay(spark):
    texts = ["REQUEST.args", "re quest.", "Select 1\nfrom t", "select a FROM b", "open ('x', \"w\")", "{% if %}", "x = {{ y }}", "curſor.x", "toKen", "TOKEN", None, "", "Reader (x)", "os.System (", "dİsplay print (1)", "shell=TRUE"]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    tables = [rules.INPUT_PATTERNS, rules.SENSITIVE_PATTERNS, rules.AUTH_PATTERNS, *[r["sink"] for r in rules.CROSS_FILE.values()], *rules.SOURCE_PATTERNS.values(), *rules.SINK_PATTERNS.values()]
    same = [matches_any(F.col("code"), p).eqNullSafe(F.regexp_like("code", F.lit(any_regex(p)))) for p in tables]
    assert all(all(r) for r in df.select(*[c.alias(str(i)) for i, c in enumerate(same)]).collect())


def test_ends_in_one_reading(spark):
    nodes = spark.createDataFrame([("a", "cursor.execute(request.args)"), ("b", "pass")], "node string, code string")
    ends = detect.taint_kinds(nodes)
    assert {tuple(r) for r in ends.collect()} == {("a", "user_input", "source"), ("a", "sql_query", "high")}
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
