"""Queries over findings: scanning, scoring, reports, consensus, integration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..operators import findings as O
from ..operators import integration as I
from ..sources import adapters as A

#: Words that stand for findings in prose.
PROSE_LEXICON = {"secret": r"token\s*=", "license": r"licen[sc]e", "markup": r"[<>|]", "shout": r"!!"}


def scan_findings_by_type(spark: SparkSession, sf: str) -> DataFrame:
    files = A.source_files(spark, sf)
    hits = O.pattern_findings(files, PROSE_LEXICON)
    return hits.groupBy("language", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("n_files"))


def cvss_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = A.findings(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    # in steps: an expression mentioned many times is then computed once
    f = f.withColumn("template", S.cvss_template(F.col("type")))
    f = f.withColumns(S.cvss_metrics(F.col("template")))
    m = {n: F.col(n) for n in rules.CVSS_METRICS}
    f = f.withColumns({"exploitability": S.cvss_exploitability(m), "impact": S.cvss_impact(m), "vector": S.cvss_vector(m)})
    f = f.withColumn("base_score", F.round(F.least(F.lit(10.0), F.col("exploitability") + F.col("impact")), 1))
    base = F.col("base_score")
    return f.select(
        "type", "n", F.round("exploitability", 6).alias("exploitability"), F.round("impact", 6).alias("impact"), "base_score",
        S.cvss_severity(base).alias("severity"), "vector", S.cvss_threat(base, F.lit("P")).alias("threat"),
        S.cvss_environmental(base, F.lit("L"), F.lit("M"), F.lit("H")).alias("environmental"),
    )


def cvss_all_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of exploitability metrics, by nation and region keys as letters."""
    n = A.table(spark, sf, "customer").select("c_custkey")
    letter = lambda letters, k: F.element_at(F.array(*[F.lit(x) for x in letters]), (F.floor(F.col("c_custkey") / k) % len(letters) + 1).cast("int"))
    m = {"av": letter("NALP", 1), "ac": letter("LH", 4), "at": letter("NP", 8), "pr": letter("NLH", 16), "ui": letter("NPA", 48)}
    m |= {k: letter("HLN", 3 ** i) for i, k in enumerate(("vc", "vi", "va", "sc", "si", "sa"))}
    base = S.cvss_base(m)
    return n.select(base.alias("base_score"), S.cvss_severity(base).alias("severity"), F.round(S.cvss_exploitability(m), 4).alias("e")).groupBy("base_score", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("e"), 4).alias("min_e"), F.round(F.max("e"), 4).alias("max_e"))


def severity_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return O.counts_by_each(A.findings(spark, sf), ["severity", "type", "file_path"])


def file_severity_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return O.severity_heatmap(A.findings(spark, sf), 15)


def top_types_other(spark: SparkSession, sf: str) -> DataFrame:
    return O.top_with_other(A.findings(spark, sf), "file_path", 9)


def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    return O.risk_by(A.findings(spark, sf), "batch")


def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    e = A.metrics(spark, sf)
    r = e.rollup("layer", "operation").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg(F.when(F.col("failed"), 0.0).otherwise(1.0)), 6).alias("success_rate"),
        F.countDistinct("operation").alias("n_operations"), F.grouping_id().cast("long").alias("level"),
    )
    return r


#: Code of findings by their line.
SNIPPETS = {0: "exec select request", 1: "select update", 2: "system(cmd)"}


def _described(spark, sf):
    f = A.findings(spark, sf).dropDuplicates(["id"])
    return f.withColumn("description", F.concat_ws(" ", "type", F.lit("in"), "file_path")).withColumn("snippet", S.lookup(F.col("start_line") % 4, SNIPPETS, "x = 1"))


def finding_similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs among all findings by type: pairs of classes, and of findings."""
    p = O.similar_classes(_described(spark, sf).filter(F.col("confidence") >= 0.3), 0.8)
    n = F.when(F.col("a") == F.col("b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b")).cast("long")
    mean, most = F.round(F.avg("similarity"), 6), F.round(F.max("similarity"), 6)
    return p.groupBy("type").agg(F.count(F.lit(1)).alias("n_classes"), F.sum(n).alias("n_pairs"), mean.alias("mean_similarity"), most.alias("max_similarity"))


def finding_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding with how many others are similar to it."""
    return O.finding_links(_described(spark, sf).filter(F.col("confidence") >= 0.3), 0.8).select("id", "n_links")


def _clusters(spark, sf):
    return I.clustered(_described(spark, sf))


def finding_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every finding with its greedy cluster."""
    return _clusters(spark, sf).select("id", "cluster_id")


def integrated_findings(spark: SparkSession, sf: str) -> DataFrame:
    """One finding for each cluster, with the confidence that consensus leaves it."""
    return I.integrated(_described(spark, sf))[0].select("id", "type", "file_path", "start_line", "severity", "confidence", "n", "strength")


def conflict_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return O.resolved_clusters(_clusters(spark, sf), "cluster_id")


def integration_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return O.integration_metrics(_clusters(spark, sf), "cluster_id")


def severity_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by normalised severity, risk band and OWASP category."""
    f = A.findings(spark, sf)
    out = f.select(S.normal_severity(F.col("severity")).alias("severity"), S.risk_severity(F.col("confidence")).alias("band"), S.owasp_category(F.col("type")).alias("owasp"))
    return out.groupBy("severity", "band", "owasp").agg(F.count(F.lit(1)).alias("n"))


def audit_risk(spark: SparkSession, sf: str) -> DataFrame:
    e = A.audit_events(spark, sf).withColumn("risk", F.round(S.audit_risk(F.col("event_type"), F.col("result"), F.col("security_level")), 6))
    return e.groupBy("event_type", "result", "security_level").agg(F.count(F.lit(1)).alias("n"), F.max("risk").alias("risk"))


def security_events(spark: SparkSession, sf: str) -> DataFrame:
    e = A.audit_events(spark, sf).withColumn("risk", F.round(S.audit_risk(F.col("event_type"), F.col("result"), F.col("security_level")), 6))
    return O.security_events(e, 0.7).select("event_id", "user_id", "event_type", "risk")


def _consensus(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return O.consensus(A.verdicts(spark, sf), name)

    return query


def model_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    d = O.disagreement(A.verdicts(spark, sf))
    return d.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_stdev"), 6).alias("mean_stdev"))


def validation_statistics(spark: SparkSession, sf: str) -> DataFrame:
    v = A.verdicts(spark, sf)
    return v.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.percentile("confidence", F.lit(0.5)), 6).alias("median"),
        F.round(F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)), 6).alias("stdev"), F.min("confidence").alias("low"), F.max("confidence").alias("high"),
        F.round(100.0 * F.count_if("is_valid") / F.count(F.lit(1)), 6).alias("valid_percent"),
    )


def top_findings_per_file(spark: SparkSession, sf: str) -> DataFrame:
    f = A.findings(spark, sf).dropDuplicates(["id"])
    order = Window.partitionBy("file_path").orderBy(F.desc("confidence"), "id")
    return f.withColumn("rank", F.row_number().over(order).cast("long")).filter("rank <= 3").select("file_path", "rank", "id", F.col("confidence"))


QUERIES = {
    "scan_findings_by_type": scan_findings_by_type, "cvss_scores": cvss_scores, "cvss_all_metrics": cvss_all_metrics,
    "severity_grouping_sets": severity_grouping_sets, "file_severity_pivot": file_severity_pivot, "top_types_other": top_types_other,
    "risk_score": risk_score, "usage_rollup": usage_rollup, "finding_similarity_pairs": finding_similarity_pairs,
    "finding_links": finding_links, "finding_clusters": finding_clusters, "integrated_findings": integrated_findings,
    "conflict_resolution": conflict_resolution, "integration_metrics": integration_metrics, "severity_bands": severity_bands,
    "audit_risk": audit_risk, "security_events": security_events, "model_disagreement": model_disagreement,
    "validation_statistics": validation_statistics, "top_findings_per_file": top_findings_per_file,
} | {f"consensus_{n}": _consensus(n) for n in O.CONSENSUS}

_W = A.with_roles
_DESCRIBED = """f AS (SELECT DISTINCT id, file_path, start_line, type, severity, confidence, task_id, start_line % 4 AS kind, md5(concat_ws('|', type, file_path, start_line, severity)) AS class,
        CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS rank FROM findings WHERE confidence >= 0.3)"""


def _alike(a: dict, b: dict) -> str:
    """Similarity of two findings of one file: what their types, lines, severities and codes (by kind) say."""
    injections = f"({a['type']} = 'sql injection' AND {b['type']} = 'command injection') OR ({b['type']} = 'sql injection' AND {a['type']} = 'command injection')"
    words = f"CASE WHEN {a['type']} = {b['type']} THEN 1.0 WHEN {injections} THEN 3.0 / 5 WHEN {a['type']} = 'xss' OR {b['type']} = 'xss' THEN 2.0 / 5 ELSE 0.0 END"
    gap = f"abs({a['line']} - {b['line']})"
    place = f"CASE WHEN {gap} = 0 THEN 1.0 WHEN {gap} <= 5 THEN 0.8 WHEN {gap} <= 20 THEN 0.6 ELSE 0.4 END"
    code = f"CASE WHEN {a['kind']} = 3 OR {b['kind']} = 3 THEN 0.0 WHEN {a['kind']} = {b['kind']} THEN 1.0 WHEN {a['kind']} + {b['kind']} = 1 THEN 0.25 ELSE 0.0 END"
    kinds = f"CASE WHEN {a['type']} = {b['type']} THEN 1.0 WHEN {injections} THEN 0.7 ELSE 0.0 END"
    return f"round(CAST(0.3 * {kinds} + 0.25 * {place} + 0.2 * ({words}) + 0.15 * {code} + 0.1 * (1.0 - 0.25 * abs({a['rank']} - {b['rank']})) AS DOUBLE), 9)"


def _named(prefix: str) -> dict:
    return {"type": f"{prefix}.type", "line": f"{prefix}.start_line", "kind": f"{prefix}.kind", "rank": f"{prefix}.rank"}


_PAIRS = _W("findings") + f""", {_DESCRIBED}, h AS (SELECT class, type, file_path, start_line, severity, kind, rank, count(*) AS n FROM f GROUP BY ALL),
    q AS (SELECT a.class AS a, b.class AS b, a.n AS n_a, b.n AS n_b, least(a.type, b.type) AS type, {_alike(_named("a"), _named("b"))} AS s FROM h a JOIN h b ON a.file_path = b.file_path AND (a.class < b.class OR (a.class = b.class AND a.n > 1))),
    p AS (SELECT * FROM q WHERE s >= 0.8)"""
_REP = "{'id': i.id, 'type': i.type, 'start_line': i.start_line, 'kind': i.kind, 'rank': i.rank}"
_CLUSTERS = f"""WITH RECURSIVE {A.SQL["findings"]}, {_DESCRIBED},
    h AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY confidence DESC, id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY confidence DESC, id) AS first FROM f) x WHERE first = 1),
    r(file_path, k, reps, class, cluster_id) AS (SELECT i.file_path, i.k, [{_REP}], i.class, i.id FROM h i WHERE i.k = 1 UNION ALL
        SELECT file_path, k, CASE WHEN hit IS NULL THEN list_append(reps, rep) ELSE reps END, class, coalesce(hit, id)
        FROM (SELECT i.file_path, i.k, r.reps, i.class, i.id, {_REP} AS rep, (list_filter(r.reps, lambda x: {_alike(_named("x"), _named("i"))} >= 0.8))[1].id AS hit
            FROM r JOIN h i ON i.file_path = r.file_path AND i.k = r.k + 1) y),
    g AS (SELECT f.*, r.cluster_id FROM f JOIN r ON r.class = f.class)"""
_RESOLVED = """, v AS (SELECT cluster_id, type, count(*) AS votes, min(id) AS first_id FROM g GROUP BY 1, 2),
    w AS (SELECT cluster_id, type AS majority_type FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY votes DESC, first_id) AS r FROM v) x WHERE r = 1),
    c AS (SELECT cluster_id, count(*) AS n, max(confidence) AS high, CAST((2 * CAST(sum(CAST(round(confidence * 1000000) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*)) AS DOUBLE) / 1000000 AS mean, round(count(DISTINCT task_id) * 1.0 / count(*), 6) AS strength FROM g GROUP BY 1),
    b AS (SELECT cluster_id, id AS best_id FROM (SELECT cluster_id, id, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, id) AS r FROM g) x WHERE r = 1),
    o AS (SELECT c.cluster_id, n, best_id, majority_type, high AS highest, mean AS average, strength, round(CASE WHEN strength >= 0.6 THEN high ELSE high * strength END, 6) AS consensus_confidence
        FROM c JOIN w USING (cluster_id) JOIN b USING (cluster_id))"""
_CVSS_CASE = "\n".join(f"WHEN contains(lower(type), '{k}') THEN '{rules.cvss_letters(v)}'" for k, v in rules.CVSS_TEMPLATES)
_AUDIT_RISK = """round(least(CAST(1.0 AS DOUBLE), CAST(CASE event_type WHEN 'security_violation' THEN 0.9 WHEN 'user_login' THEN 0.3 WHEN 'user_logout' THEN 0.1 WHEN 'configuration_changed' THEN 0.6 WHEN 'data_access' THEN 0.4 WHEN 'error_occurred' THEN 0.5 ELSE 0.3 END AS DOUBLE)
    * CASE result WHEN 'failure' THEN 1.5 WHEN 'partial' THEN 1.2 ELSE 1.0 END * CASE security_level WHEN 'public' THEN 0.5 WHEN 'confidential' THEN 1.5 WHEN 'restricted' THEN 2.0 ELSE 1.0 END), 6)"""


def _letter_sql(letters: str, k: int) -> str:
    return f"substr('{letters}', CAST(floor(c_custkey / {k}.0) AS BIGINT) % {len(letters)} + 1, 1)"


def _cvss_sql(m: dict[str, str]) -> tuple[str, str]:
    e = "8.22 * " + " * ".join("(1 - CASE " + m[n] + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + " END)" for n, w in rules.CVSS_WEIGHTS.items())
    i = {n: f"CASE {m[n]} WHEN 'H' THEN 0.0 WHEN 'L' THEN 0.1 ELSE 0.2 END" for n in ("vc", "vi", "va", "sc", "si", "sa")}
    v, s = (f"(1 - CAST({i[a]} AS DOUBLE) * {i[b]} * {i[c]})" for a, b, c in (("vc", "vi", "va"), ("sc", "si", "sa")))
    return f"CAST({e} AS DOUBLE)", f"least(6.0, (greatest({v}, {s}) + 0.5 * least({v}, {s})) * 6.0)"


_E1, _I1 = _cvss_sql({n: f"substr(t, {i + 1}, 1)" for i, n in enumerate(rules.CVSS_METRICS)})
_E2, _I2 = _cvss_sql(
    {"av": _letter_sql("NALP", 1), "ac": _letter_sql("LH", 4), "at": _letter_sql("NP", 8), "pr": _letter_sql("NLH", 16), "ui": _letter_sql("NPA", 48)}
    | {k: _letter_sql("HLN", 3**i) for i, k in enumerate(("vc", "vi", "va", "sc", "si", "sa"))}
)
_BAND = "CASE WHEN base_score = 0 THEN 'NONE' WHEN base_score BETWEEN 0.1 AND 3.9 THEN 'LOW' WHEN base_score BETWEEN 4.0 AND 6.9 THEN 'MEDIUM' WHEN base_score BETWEEN 7.0 AND 8.9 THEN 'HIGH' WHEN base_score BETWEEN 9.0 AND 10.0 THEN 'CRITICAL' ELSE 'UNKNOWN' END"

SQL = {
    "scan_findings_by_type": _W("source_files") + """ SELECT language, type, count(*) AS n, count(DISTINCT path) AS n_files FROM source_files, (VALUES ('secret', 'token\\s*='), ('license', 'licen[sc]e'), ('markup', '[<>|]'), ('shout', '!!')) r(type, pattern)
        WHERE regexp_matches(content, '(?i)' || pattern) GROUP BY language, type""",
    "cvss_scores": _W("findings") + f""", t AS (SELECT type, count(*) AS n, CASE {_CVSS_CASE} ELSE '{rules.cvss_letters(rules.CVSS_DEFAULT)}' END AS t FROM findings GROUP BY type),
        s AS (SELECT *, {_E1} AS e, {_I1} AS i FROM t), b AS (SELECT *, round(least(10.0, e + i), 1) AS base_score FROM s)
        SELECT type, n, round(e, 6) AS exploitability, round(i, 6) AS impact, base_score, {_BAND} AS severity,
        'CVSS:4.0/AV:' || substr(t,1,1) || '/AC:' || substr(t,2,1) || '/AT:' || substr(t,3,1) || '/PR:' || substr(t,4,1) || '/UI:' || substr(t,5,1) || '/VC:' || substr(t,6,1) || '/VI:' || substr(t,7,1) || '/VA:' || substr(t,8,1) || '/SC:' || substr(t,9,1) || '/SI:' || substr(t,10,1) || '/SA:' || substr(t,11,1) AS vector,
        round(base_score * 0.94, 1) AS threat, round(least(10.0, base_score * ((0.5 + 1.0 + 1.5) / 3.0)), 1) AS environmental FROM b""",
    "cvss_all_metrics": f"""WITH s AS (SELECT {_E2} AS e, {_I2} AS i FROM customer), b AS (SELECT round(e, 4) AS e, round(least(10.0, e + i), 1) AS base_score FROM s)
        SELECT base_score, {_BAND} AS severity, count(*) AS n, round(min(e), 4) AS min_e, round(max(e), 4) AS max_e FROM b GROUP BY base_score""",
    "severity_grouping_sets": _W("findings") + """ SELECT severity, type, file_path, count(*) AS n FROM findings GROUP BY GROUPING SETS ((severity), (type), (file_path))""",
    "file_severity_pivot": _W("findings") + """ SELECT file_path, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
        count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info,
        CAST(sum(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END) AS BIGINT) AS heat FROM findings GROUP BY file_path ORDER BY heat DESC, file_path LIMIT 15""",
    "top_types_other": _W("findings") + """, c AS (SELECT file_path, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, file_path) AS r FROM findings GROUP BY file_path)
        SELECT CASE WHEN r <= 9 THEN file_path ELSE 'other' END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "risk_score": _W("findings") + """ SELECT batch, round(least(100.0, 2 * sum(CASE severity WHEN 'critical' THEN CAST(10.0 AS DOUBLE) WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 ELSE 0.1 END)), 6) AS risk_score, count(*) AS n FROM findings GROUP BY batch""",
    "usage_rollup": _W("metrics") + """ SELECT layer, operation, count(*) AS n, round(sum(value), 2) AS total, round(avg(CASE WHEN failed THEN 0.0 ELSE 1.0 END), 6) AS success_rate, count(DISTINCT operation) AS n_operations,
        CAST(grouping_id(layer, operation) AS BIGINT) AS level FROM metrics GROUP BY ROLLUP (layer, operation)""",
    "finding_similarity_pairs": _PAIRS + """ SELECT type, count(*) AS n_classes, CAST(sum(CASE WHEN a = b THEN n_a * (n_a - 1) / 2 ELSE n_a * n_b END) AS BIGINT) AS n_pairs,
        round(avg(s), 6) AS mean_similarity, round(max(s), 6) AS max_similarity FROM p GROUP BY type""",
    "finding_links": _PAIRS + """, e AS (SELECT a AS c, CASE WHEN a = b THEN n_b - 1 ELSE n_b END AS n FROM p UNION ALL SELECT b, n_a FROM p WHERE a <> b), l AS (SELECT c, CAST(sum(n) AS BIGINT) AS n_links FROM e GROUP BY c)
        SELECT id, coalesce(n_links, 0) AS n_links FROM f LEFT JOIN l ON l.c = f.class""",
    "finding_clusters": _CLUSTERS + " SELECT id, cluster_id FROM g",
    "conflict_resolution": _CLUSTERS + _RESOLVED + " SELECT * FROM o",
    "integrated_findings": _CLUSTERS + _RESOLVED + " SELECT g.id, type, file_path, start_line, severity, o.consensus_confidence AS confidence, o.n, o.strength FROM o JOIN g ON g.id = o.best_id",
    "integration_metrics": _CLUSTERS + """, c AS (SELECT cluster_id, count(*) AS n, count(DISTINCT task_id) * 1.0 / count(*) AS strength, max(confidence) AS confidence FROM g GROUP BY cluster_id)
        SELECT CAST(sum(n) AS BIGINT) AS n_findings, count(*) AS n_clusters, round(1 - count(*) * 1.0 / sum(n), 6) AS dedup_rate, round(avg(n), 6) AS mean_size, max(n) AS largest, count(*) FILTER (n > 1) AS multi,
        round(avg(strength), 6) AS mean_strength, round(avg(confidence), 6) AS mean_confidence, round(coalesce(stddev_samp(confidence), 0), 6) AS stdev_confidence, min(confidence) AS low, max(confidence) AS high FROM c""",
    "severity_bands": _W("findings") + """ SELECT severity, CASE WHEN confidence >= 0.8 THEN 'critical' WHEN confidence >= 0.6 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band,
        CASE type WHEN 'sql injection' THEN 'A03:2021 – Injection' WHEN 'xss' THEN 'A07:2021 – Cross-Site Scripting' ELSE 'A03:2021 – Injection' END AS owasp, count(*) AS n FROM findings GROUP BY 1, 2, 3""",
    "audit_risk": _W("audit_events") + f" SELECT event_type, result, security_level, count(*) AS n, max({_AUDIT_RISK}) AS risk FROM audit_events GROUP BY 1, 2, 3",
    "security_events": _W("audit_events") + f" SELECT event_id, user_id, event_type, risk FROM (SELECT *, {_AUDIT_RISK} AS risk FROM audit_events) e WHERE event_type IN ('security_violation', 'user_login', 'user_logout') OR risk >= 0.7",
    "model_disagreement": _W("verdicts") + """, d AS (SELECT finding_id, round(avg(CASE WHEN is_valid THEN 1.0 ELSE 0.0 END), 9) AS agreement, round(coalesce(stddev_samp(confidence), 0), 9) AS sd, count(*) AS n FROM verdicts GROUP BY 1)
        SELECT CASE WHEN n < 2 THEN 'none' WHEN round(abs(agreement - 0.5), 9) > 0.3 AND sd < 0.2 THEN 'low' WHEN round(abs(agreement - 0.5), 9) <= 0.3 OR sd >= 0.3 THEN 'high' ELSE 'medium' END AS level, count(*) AS n, round(avg(sd), 6) AS mean_stdev FROM d GROUP BY 1""",
    "validation_statistics": _W("verdicts") + """ SELECT model, count(*) AS n, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.5), 6) AS median, round(coalesce(stddev_samp(confidence), 0), 6) AS stdev,
        min(confidence) AS low, max(confidence) AS high, round(100.0 * count(*) FILTER (is_valid) / count(*), 6) AS valid_percent FROM verdicts GROUP BY model""",
    "top_findings_per_file": _W("findings") + """ SELECT file_path, rank, id, confidence FROM (SELECT file_path, id, confidence, row_number() OVER (PARTITION BY file_path ORDER BY confidence DESC, id) AS rank FROM (SELECT DISTINCT * FROM findings) d) x WHERE rank <= 3""",
    "consensus_majority": _W("verdicts") + """, c AS (SELECT finding_id, count(*) AS n, count(*) FILTER (is_valid) AS v, avg(confidence) AS conf FROM verdicts GROUP BY 1)
        SELECT finding_id, v > n / 2.0 AS valid, round(abs(v - (n - v)) * 1.0 / n, 6) AS score, round(abs(v - (n - v)) * 1.0 / n, 6) >= 0.6 AS reached, round(conf, 6) AS confidence FROM c""",
    "consensus_weighted": _W("verdicts") + """, c AS (SELECT finding_id, sum(confidence * weight) / sum(weight) AS conf, sum(CASE WHEN is_valid THEN weight ELSE 0 END) / sum(weight) AS validity FROM verdicts GROUP BY 1),
        d AS (SELECT finding_id, any_value(validity) AS validity, any_value(conf) AS conf, avg(power(CASE WHEN is_valid THEN 1.0 ELSE 0.0 END - validity, 2)) AS var FROM verdicts JOIN c USING (finding_id) GROUP BY 1)
        SELECT finding_id, validity > 0.5 AS valid, round(1 - least(1.0, var), 6) AS score, round(1 - least(1.0, var), 6) >= 0.6 AS reached, round(conf, 6) AS confidence FROM d""",
    "consensus_confidence": _W("verdicts") + """, c AS (SELECT finding_id, count(*) AS n, sum(confidence) AS t, sum(CASE WHEN is_valid THEN confidence ELSE 0 END) AS v, sum(confidence * confidence) AS q, stddev_samp(CASE WHEN is_valid THEN confidence ELSE -confidence END) AS sd FROM verdicts GROUP BY 1)
        SELECT finding_id, coalesce(t > 0 AND round(v / nullif(t, 0), 9) > 0.5, false) AS valid, CASE WHEN t = 0 THEN 0 ELSE round(greatest(0.0, CASE WHEN n > 1 THEN 1 - sd / 2 ELSE 1.0 END), 6) END AS score,
        t > 0 AND round(greatest(0.0, CASE WHEN n > 1 THEN 1 - sd / 2 ELSE 1.0 END), 6) >= 0.6 AS reached, CASE WHEN t = 0 THEN 0 ELSE round(q / t, 6) END AS confidence FROM c""",
    "consensus_unanimous": _W("verdicts") + """ SELECT finding_id, bool_and(is_valid) AS valid, CASE WHEN bool_and(is_valid) OR NOT bool_or(is_valid) THEN CAST(1.0 AS DOUBLE) ELSE 0.0 END AS score, bool_and(is_valid) OR NOT bool_or(is_valid) AS reached, round(avg(confidence), 6) AS confidence FROM verdicts GROUP BY 1""",
    "consensus_threshold": _W("verdicts") + """, c AS (SELECT finding_id, count(*) FILTER (confidence >= 0.6) AS n, count(*) FILTER (confidence >= 0.6 AND is_valid) AS v, avg(confidence) FILTER (confidence >= 0.6) AS conf FROM verdicts GROUP BY 1)
        SELECT finding_id, n > 0 AND v * 1.0 / nullif(n, 0) > 0.5 AS valid, CASE WHEN n = 0 THEN 0.0 ELSE round(abs(v * 1.0 / n - 0.5) * 2, 6) END AS score, n > 0 AND round(abs(v * 1.0 / nullif(n, 0) - 0.5) * 2, 6) >= 0.6 AS reached, round(coalesce(conf, 0), 6) AS confidence FROM c""",
}
