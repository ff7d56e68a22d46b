"""Roles of the audit played by general tables: findings, verdicts, metrics, calls, files.

Each role is a DataFrame, and ``SQL`` has the same rows as common table expressions for a second engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import LANGUAGES
from ..functions.scoring import lookup

#: What orders the lines of an order beyond doubt.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
TYPES = {"R": "sql injection", "A": "xss"}
SEVERITIES = {1: "critical", 2: "high", 3: "medium", 4: "low"}
EXTENSIONS = {"en": ".py", "de": ".js", "fr": ".java"}
AUDIT_TYPES = {"signup": "user_login", "view": "data_access", "error": "error_occurred", "click": "configuration_changed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_path, start_line, type, severity, confidence, task_id, batch from order lines."""
    t = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return t.select(
        F.md5(key.cast("binary")).alias("id"), F.format_string("src/f%d.py", F.col("l_partkey") % 50).alias("file_path"),
        F.col("l_quantity").cast("long").alias("start_line"), lookup(F.col("l_returnflag"), TYPES, "command injection").alias("type"),
        lookup(F.col("l_linenumber"), SEVERITIES, "info").alias("severity"), F.round(F.col("l_discount") * 10, 6).alias("confidence"),
        F.col("l_suppkey").alias("task_id"), F.col("l_orderkey").alias("batch"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """finding_id, model, confidence, is_valid, weight: a finding is an order, its lines are models' verdicts."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("model"), F.round(F.col("l_discount") * 10, 6).alias("confidence"),
        (F.col("l_returnflag") != "N").alias("is_valid"), F.round(F.col("l_tax") * 10 + 0.5, 6).alias("weight"),
    )


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, layer, operation, value, failed."""
    t = table(spark, sf_dir, "events")
    return t.select("event_id", "ts", F.col("event_type").alias("layer"), (_k() % 5).alias("operation"), "value", (F.col("event_type") == "error").alias("failed"))


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, layer, operation, metric_type, value in 0..1."""
    return quality_rows(table(spark, sf_dir, "events"))


def quality_rows(events: DataFrame) -> DataFrame:
    """The same of a table or stream of events."""
    kind = lookup(_k() % 4, {0: "accuracy", 1: "precision", 2: "false_positive_rate"}, "confidence_score")
    return events.select("event_id", "ts", F.col("event_type").alias("layer"), (_k() % 5).alias("operation"), kind.alias("metric_type"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 300.0)).alias("value"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, result, security_level."""
    t = table(spark, sf_dir, "events")
    return t.select(
        "event_id", "ts", "user_id", lookup(F.col("event_type"), AUDIT_TYPES, "security_violation").alias("event_type"),
        lookup(_k() % 3, {0: "success", 1: "failure"}, "partial").alias("result"),
        lookup(_k() % 4, {0: "public", 1: "internal", 2: "confidential"}, "restricted").alias("security_level"),
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, module, pos, part, size: every order is a module of code, every line of it a function."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.row_number().over(order).alias("pos"))
    return t.select(
        (F.col("l_orderkey") * 100 + F.col("pos")).alias("node"), F.col("l_orderkey").alias("module"), F.col("pos").cast("long").alias("pos"),
        F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("size"),
    )


def module(node: Column) -> Column:
    """The module of a function, by its node; a module of a hundred functions or more shares nodes with the next."""
    return node - node % 100


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct directed edges src, dst between the functions of a module, of all modules, no self loops.

    A function calls the next one, every third later one, and one in eleven calls the module's first: chains, branches, cycles.
    """
    f = functions(spark, sf_dir)
    a = f.select("module", F.col("node").alias("src"), F.col("pos").alias("i"), F.col("part").alias("p"))
    b = f.select("module", F.col("node").alias("dst"), F.col("pos").alias("j"), F.col("part").alias("q"))
    called = (F.col("j") == F.col("i") + 1) | ((F.col("j") > F.col("i") + 1) & ((F.col("p") + F.col("q")) % 3 == 0))
    called = called | ((F.col("j") == 1) & (F.col("i") > 1) & (F.col("p") % 11 == 0))
    return a.join(b, "module").filter(called).select("src", "dst")


#: What a Python function of a module does, by its part.
BODIES = (
    "q = request.args", "cursor.execute(val)", "val = escape(val)", "val = eval(val)", "for i in val: y = i", "print(val)", "val = open(val)", "val = check_token(val)",
    "val = drop(val)",
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, language: a file of code for every module, in Python, JavaScript (keys ending in 3) or Java (in 7).

    A function calls the next one; a Python module's last calls the first function of the module whose key is the next multiple
    of four below, which it imports; a module whose key is one itself ends with a builtin.
    """
    f = functions(spark, sf_dir).groupBy("module").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("f"))
    m, home = F.col("module").cast("string"), (F.col("module") - F.col("module") % 4).cast("string")
    is_home = F.col("module") % 4 == 0
    body = F.array(*[F.lit(b) for b in BODIES])
    last = F.when(is_home, F.lit("str")).otherwise(F.concat(F.lit("m"), home, F.lit(".f"), home, F.lit("_1")))

    def name(pos):
        return F.concat(F.lit("f"), m, F.lit("_"), pos.cast("string"))

    def python(x):
        callee = F.when(x["pos"] < F.size("f"), name(x["pos"] + 1)).otherwise(last)
        return F.concat(F.lit("def "), name(x["pos"]), F.lit("(val):\n    "), F.get(body, (x["part"] % 9).cast("int")), F.lit("\n    return "), callee, F.lit("(val)\n"))

    def script(x):
        returned = F.when(x["pos"] < F.size("f"), F.concat(name(x["pos"] + 1), F.lit("(x)"))).otherwise(F.lit("x"))
        return F.concat(F.lit("function "), name(x["pos"]), F.lit("(x) {\n  return "), returned, F.lit(";\n}\n"))

    def java(x):
        return F.concat(F.lit("  public int go"), x["pos"].cast("string"), F.lit("(int x) {\n    return x;\n  }\n"))

    def all_of(one):
        return F.array_join(F.transform("f", one), "")

    digit = F.col("module") % 10
    head = F.concat(F.lit("import "), F.when(is_home, F.lit("os")).otherwise(F.concat(F.lit("m"), home)), F.lit("\n"))
    content = F.when(digit == 3, all_of(script)).when(digit == 7, F.concat(F.lit("public class A"), m, F.lit(" {\n"), all_of(java), F.lit("}\n"))).otherwise(F.concat(head, all_of(python)))
    extension = F.when(digit == 3, ".js").when(digit == 7, ".java").otherwise(".py")
    return f.select(F.concat(F.lit("src/m"), m, extension).alias("path"), content.alias("content"), lookup(extension, LANGUAGES, "other").alias("language"))


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct directed edges src, dst: successive parts of all orders, no self loops; one dense graph."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return t.filter("dst is not null and src <> dst").distinct()


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, extension, language, size, content from documents."""
    t = table(spark, sf_dir, "documents")
    ext = lookup(F.col("lang"), EXTENSIONS, ".sql")
    return t.select(
        "doc_id", F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), ext).alias("path"), ext.alias("extension"),
        lookup(ext, LANGUAGES, "other").alias("language"), F.col("n_chars").alias("size"), F.col("text").alias("content"),
    )


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
SQL = {
    "findings": """findings AS (SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT))) AS id,
        'src/f' || (l_partkey % 50) || '.py' AS file_path, CAST(l_quantity AS BIGINT) AS start_line,
        CASE l_returnflag WHEN 'R' THEN 'sql injection' WHEN 'A' THEN 'xss' ELSE 'command injection' END AS type,
        CASE l_linenumber WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE 'info' END AS severity,
        round(l_discount * 10, 6) AS confidence, l_suppkey AS task_id, l_orderkey AS batch FROM lineitem)""",
    "verdicts": """verdicts AS (SELECT l_orderkey AS finding_id, l_linenumber AS model, round(l_discount * 10, 6) AS confidence, l_returnflag <> 'N' AS is_valid,
        round(l_tax * 10 + 0.5, 6) AS weight FROM lineitem)""",
    "metrics": f"metrics AS (SELECT event_id, ts, event_type AS layer, {_K} % 5 AS operation, value, event_type = 'error' AS failed FROM events)",
    "quality_metrics": f"""quality_metrics AS (SELECT event_id, ts, event_type AS layer, {_K} % 5 AS operation,
        CASE {_K} % 4 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'precision' WHEN 2 THEN 'false_positive_rate' ELSE 'confidence_score' END AS metric_type,
        least(1.0, greatest(0.0, value / 300.0)) AS value FROM events)""",
    "audit_events": f"""audit_events AS (SELECT event_id, ts, user_id,
        CASE event_type WHEN 'signup' THEN 'user_login' WHEN 'view' THEN 'data_access' WHEN 'error' THEN 'error_occurred' WHEN 'click' THEN 'configuration_changed' ELSE 'security_violation' END AS event_type,
        CASE {_K} % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' ELSE 'partial' END AS result,
        CASE {_K} % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'restricted' END AS security_level FROM events)""",
    "functions": f"""functions AS (SELECT l_orderkey * 100 + pos AS node, l_orderkey AS module, pos, l_partkey AS part, CAST(l_quantity AS BIGINT) AS size
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS pos FROM lineitem) l)""",
    "calls": """calls AS (SELECT a.node AS src, b.node AS dst FROM functions a JOIN functions b ON a.module = b.module
        WHERE b.pos = a.pos + 1 OR (b.pos > a.pos + 1 AND (a.part + b.part) % 3 = 0) OR (b.pos = 1 AND a.pos > 1 AND a.part % 11 = 0))""",
    "code": """code AS (SELECT f.module, f.pos, f.part % 9 AS kind, n, lang, home, CASE lang WHEN 'javascript' THEN 1 ELSE 2 END + 3 * (f.pos - 1) AS line,
            'src/m' || f.module || CASE lang WHEN 'javascript' THEN '.js' WHEN 'java' THEN '.java' ELSE '.py' END AS path, CASE lang WHEN 'java' THEN 'A' || f.module || '.go' || f.pos ELSE 'f' || f.module || '_' || f.pos END AS name
        FROM functions f JOIN (SELECT module, count(*) AS n, CASE module % 10 WHEN 3 THEN 'javascript' WHEN 7 THEN 'java' ELSE 'python' END AS lang, module - module % 4 AS home FROM functions GROUP BY module) m ON m.module = f.module)""",
    "part_calls": """part_calls AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src,
        lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem) e WHERE dst IS NOT NULL AND src <> dst)""",
    "source_files": """source_files AS (SELECT doc_id, source || '/' || doc_id || ext AS path, ext AS extension,
        CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.java' THEN 'java' ELSE 'sql' END AS language, n_chars AS size, text AS content
        FROM (SELECT *, CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.js' WHEN 'fr' THEN '.java' ELSE '.sql' END AS ext FROM documents) d)""",
}


def with_roles(*names: str) -> str:
    """WITH clause of the named roles."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
