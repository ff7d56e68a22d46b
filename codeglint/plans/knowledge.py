"""Queries over knowledge, summaries and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import findings as O
from ..operators import knowledge as N
from ..operators import retrieval as R
from ..operators import telemetry as T
from ..sources import adapters as A

def remediations(spark: SparkSession, sf: str) -> DataFrame:
    return A.findings(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", "n", N.remediation(F.col("type")).alias("fix"))


def finding_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by severity and type at once, with how risky tasks are."""
    f = A.findings(spark, sf)
    return f.cube("severity", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.countDistinct("task_id").alias("n_tasks"), F.grouping_id().cast("long").alias("level"))


def score_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean quality by layer, and its change from the day before."""
    q = A.quality_metrics(spark, sf).groupBy("layer", F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"))
    before = F.lag("score").over(Window.partitionBy("layer").orderBy("day"))
    return q.select("layer", "day", F.round("score", 6).alias("score"), F.round(F.col("score") - before, 6).alias("change"))


def alert_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = T.layer_stats(A.metrics(spark, sf), F.window("ts", "1 day"))
    a = T.threshold_alerts(s.select("start", "layer", "mean", "error_rate"), {"response_time": F.col("mean") / 10, "error_rate": F.col("error_rate") / 4})
    return O.counts_by_each(a.select(F.col("alert").alias("level"), "layer", "metric"), ["level", "layer", "metric"])


def error_statistics(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import text as X

    e = A.table(spark, sf, "events").select(F.concat(F.col("event_type"), F.when(F.col("value") > 100, "TimeoutError").when(F.col("value") > 50, "ConnectionError").otherwise("ConfigError")).alias("kind"), F.when(F.col("user_id") % 3 == 0, "out of memory").otherwise("bad").alias("message"))
    c = e.select(X.error_category(F.col("kind"), F.col("message")).alias("category"))
    return O.counts_by_each(c.withColumn("severity", X.error_severity(F.col("category"))), ["category", "severity"])


def deduplicated_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """The latest order of each customer that isn't urgent elsewhere: first of a key, without known keys."""
    o = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    known = o.filter("o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0")
    return R.deduplicated(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], known).select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


def knowledge_fan_in(spark: SparkSession, sf: str) -> DataFrame:
    """All parts as findings, with all suppliers, customers and orders as sources of knowledge of their brand."""
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"))

    def source(table: str, key: str, name: str, brands: int, ids: int):
        k = F.col(key)
        return A.table(spark, sf, table).select(F.concat(F.lit("Brand#"), (k % brands).cast("string")).alias("type"), F.concat(F.lit(name), (k % ids).cast("string")).alias(f"{name}_id"))

    out = R.knowledge_fan_in(p, source("supplier", "s_suppkey", "cve", 20, 7), source("customer", "c_custkey", "practice", 23, 5), source("orders", "o_orderkey", "case", 24, 4))
    return out.select("id", F.array_join("cves", ",").alias("cves"), F.array_join("practices", ",").alias("practices"), F.array_join("suggestions", ",").alias("suggestions"), F.round(F.col("cves_relevance") + F.col("practices_relevance") + F.col("cases_relevance"), 6).alias("relevance"))


def message_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as messages: users' go to all other roles, others' to the user."""
    c = A.table(spark, sf, "conversations")
    m = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"), F.col("role").alias("sender"), F.when(F.col("role") != "user", F.lit("user")).alias("receiver"))
    agents = c.select(F.col("role").alias("agent")).distinct()
    return N.delivered(m, agents).groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


def paragraph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return N.paragraph_chunks(d, "doc_id", "text", 120, 30).select("doc_id", "pos", F.length("chunk").cast("long").alias("size"))


def type_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted severities by type and task group, and the share of each type within its group."""
    f = A.findings(spark, sf).groupBy((F.col("task_id") % 10).alias("grp"), "type").agg(F.sum(S.severity_rank(F.col("severity"))).cast("long").alias("weight"))
    return f.withColumn("share", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("grp")), 6))


QUERIES = {
    f.__name__: f
    for f in (remediations, finding_summary, score_changes, alert_summary, error_statistics, deduplicated_knowledge, knowledge_fan_in, message_delivery, paragraph_chunks, type_weights)
}

_F = A.with_roles("findings")
SQL = {
    "remediations": _F + " SELECT type, count(*) AS n, CASE type WHEN 'sql injection' THEN 'use parameterised queries' WHEN 'xss' THEN 'encode output' ELSE 'pass arguments as a list' END AS fix FROM findings GROUP BY type",
    "finding_summary": _F + " SELECT severity, type, count(*) AS n, round(avg(confidence), 6) AS mean, count(DISTINCT task_id) AS n_tasks, CAST(grouping_id(severity, type) AS BIGINT) AS level FROM findings GROUP BY CUBE (severity, type)",
    "score_changes": A.with_roles("quality_metrics") + ", q AS (SELECT layer, CAST(ts AS DATE) AS day, avg(value) AS score FROM quality_metrics GROUP BY 1, 2) SELECT layer, day, round(score, 6) AS score, round(score - lag(score) OVER (PARTITION BY layer ORDER BY day), 6) AS change FROM q",
    "alert_summary": A.with_roles("metrics") + """, s AS (SELECT date_trunc('day', ts) AS start, layer, round(avg(value), 6) / 10 AS r, round(count(*) FILTER (failed) * 1.0 / count(*), 6) / 4 AS e FROM metrics GROUP BY 1, 2), a AS (SELECT layer, 'response_time' AS metric, CASE WHEN r >= 30 THEN 'critical' WHEN r >= 10 THEN 'error' WHEN r >= 5 THEN 'warning' END AS level FROM s
        UNION ALL SELECT layer, 'error_rate', CASE WHEN e >= 0.2 THEN 'critical' WHEN e >= 0.1 THEN 'error' WHEN e >= 0.05 THEN 'warning' END FROM s) SELECT level, layer, metric, count(*) AS n FROM a WHERE level IS NOT NULL GROUP BY GROUPING SETS ((level), (layer), (metric))""",
    "error_statistics": """WITH c AS (SELECT CASE WHEN value > 100 THEN 'timeout' WHEN value > 50 THEN 'network' WHEN user_id % 3 = 0 THEN 'resource' ELSE 'configuration' END AS category FROM events), s AS (SELECT category, CASE category WHEN 'configuration' THEN 'medium' ELSE 'high' END AS severity FROM c) SELECT category, severity, count(*) AS n FROM s GROUP BY GROUPING SETS ((category), (severity))""",
    "deduplicated_knowledge": "WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM r WHERE r = 1 AND o_custkey NOT IN (SELECT o_custkey FROM k)",
    "knowledge_fan_in": """WITH c AS (SELECT 'Brand#' || (s_suppkey % 20) AS type, list_sort(list(DISTINCT 'cve' || (s_suppkey % 7))) AS c FROM supplier GROUP BY 1),
        p AS (SELECT 'Brand#' || (c_custkey % 23) AS type, list_sort(list(DISTINCT 'practice' || (c_custkey % 5))) AS p FROM customer GROUP BY 1),
        h AS (SELECT 'Brand#' || (o_orderkey % 24) AS type, list_sort(list(DISTINCT 'case' || (o_orderkey % 4))) AS h FROM orders GROUP BY 1),
        t AS (SELECT q.p_partkey AS id, coalesce(c, []) AS c, coalesce(p, []) AS p, coalesce(h, []) AS h FROM part q LEFT JOIN c ON c.type = q.p_brand LEFT JOIN p ON p.type = q.p_brand LEFT JOIN h ON h.type = q.p_brand),
        g AS (SELECT *, list_concat(p[1:3], h[1:2]) AS g FROM t)
        SELECT id, array_to_string(c, ',') AS cves, array_to_string(p, ',') AS practices,
            CASE WHEN len(g) > 0 THEN array_to_string(g, ',') ELSE 'validate input,apply least privilege,review the code' END AS suggestions,
            round(CAST(CASE WHEN len(c) > 0 THEN 0.9 ELSE 0 END + CASE WHEN len(p) > 0 THEN 0.8 ELSE 0 END + CASE WHEN len(h) > 0 THEN 0.7 ELSE 0 END AS DOUBLE), 6) AS relevance FROM g""",
    "message_delivery": "WITH a AS (SELECT DISTINCT role AS agent FROM conversations), d AS (SELECT a.agent FROM conversations c JOIN a ON (c.role <> 'user' AND a.agent = 'user') OR (c.role = 'user' AND a.agent <> 'user')) SELECT agent, count(*) AS n FROM d GROUP BY agent",
    "type_weights": _F + ", w AS (SELECT task_id % 10 AS grp, type, CAST(sum(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM findings GROUP BY 1, 2) SELECT grp, type, weight, round(weight * 1.0 / sum(weight) OVER (PARTITION BY grp), 6) AS share FROM w",
}
