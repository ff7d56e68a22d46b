"""Compositions: integrating task results, validating findings, reports of flows, context of findings, retention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import rules
from ..functions import scoring as S
from . import findings as O
from . import validation as V
from .graph import degrees, simple_paths
from .groups import longest_paths, parted, solved

LEAST_CONFIDENCE = 0.3


def clustered(findings: DataFrame, threshold: float = 0.8, block: list[str] = ()) -> DataFrame:
    """findings of many tasks with cluster_id: weak ones go, similar ones share a cluster."""
    f = findings.withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).filter(F.col("confidence") >= LEAST_CONFIDENCE)
    return f.join(O.greedy_clusters(f, block, threshold), "id")


def integrated(findings: DataFrame, block: list[str] = (), threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(results, metrics) of findings of many tasks: weak ones go, similar ones are clustered, each cluster gives one.

    results: the best member with the confidence that consensus leaves it, cluster size and number of tasks.
    """
    c = clustered(findings, threshold, block)
    outcome = O.resolved_clusters(c, "cluster_id")
    best = c.select(F.col("id").alias("best_id"), "type", "file_path", "start_line", "severity").join(outcome, "best_id")
    results = best.select(F.col("best_id").alias("id"), "type", "file_path", "start_line", "severity", F.col("consensus_confidence").alias("confidence"), "n", "strength")
    return results, O.integration_metrics(c, "cluster_id")


def validated(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """findings with false_positive, reason, confidence and status: rules first, then the models' consensus.

    findings: id, type, file_path, snippet, severity; verdicts: finding_id, confidence, is_valid, weight.
    """
    filters = {"rule": V.rule_match(F.col("file_path"), F.col("snippet"))["confidence"], "protection": V.protected_context(F.col("snippet"), F.lit(None).cast("array<string>"))}
    wrong, reason, _ = V.combined(filters)
    f = findings.withColumns({"false_positive": wrong, "reason": reason})
    agreed = O.consensus(verdicts, "confidence").withColumnRenamed("confidence", "agreed")
    spread = verdicts.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n_models"), F.avg("confidence").alias("mean"), F.stddev_samp("confidence").alias("sd"))
    j = f.join(agreed.join(spread, "finding_id"), F.col("id") == F.col("finding_id"), "left")
    models = F.coalesce("n_models", F.lit(0))
    factors = {
        "code_quality": V.code_quality(F.col("snippet"), F.col("file_path"), F.col("type")), "pattern_match": V.pattern_match(F.col("snippet"), F.col("type")),
        "historical_accuracy": V.default_accuracy(F.col("type")), "cross_validation": V.cross_validation(F.coalesce("reached", F.lit(False)), models, F.coalesce("mean", F.lit(0.5)), F.col("sd")),
    }
    j = j.withColumn("confidence", F.round(F.when(F.col("false_positive"), 0.0).otherwise(V.overall_confidence(factors)), 6))
    status = F.when(F.col("false_positive"), "rejected").otherwise(V.validation_status(F.col("confidence"), F.coalesce("valid", F.lit(True))))
    return j.withColumn("status", status).select(*findings.columns, "false_positive", "reason", "confidence", "status")


def validation_summary(validated_findings: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("validated", "needs_review", "rejected")]
    return validated_findings.agg(n.alias("n"), *counts, F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def flow_report(flows: DataFrame) -> DataFrame:
    """One row over flows (type, risk, level): totals, high and medium risks, flows by type, share sanitised."""
    by_type = flows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    types = by_type.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))
    n = F.count(F.lit(1))
    totals = flows.agg(n.alias("n"), F.count_if(F.col("risk") >= 0.8).alias("high"), F.count_if((F.col("risk") >= 0.5) & (F.col("risk") < 0.8)).alias("medium"), F.round(F.coalesce(F.count_if(F.col("level") == 1) / F.nullif(n, F.lit(0)), F.lit(0.0)), 6).alias("sanitized"))
    return totals.join(F.broadcast(types))


def entry_exit(edges: DataFrame) -> DataFrame:
    """(node, role): entry without incoming edges, exit without outgoing ones."""
    d = degrees(edges)
    return d.withColumn("role", F.when(F.col("in_degree") == 0, "entry").when(F.col("out_degree") == 0, "exit")).filter("role is not null").select("node", "role")


def maximal_paths(paths: DataFrame, limit: int) -> DataFrame:
    """Of simple paths (src, dst, path), those that no longer one from the same source begins with, at most `limit` a source."""
    longer = paths.select("src", F.slice("path", 1, F.size("path") - 1).alias("path")).distinct()
    best = paths.join(longer, ["src", "path"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.size("path")), F.array_join(F.transform("path", lambda x: x.cast("string")), ">")))
    return best.withColumn("_r", rank).filter(F.col("_r") <= limit).select("src", "dst", "path")


def maximal_paths_in(edges: DataFrame, group: Callable[[Column], Column], max_edges: int, limit: int) -> DataFrame:
    """maximal_paths() of the simple paths of a graph in groups: group gives a node's, most edges stay within one; small groups are solved without joins."""
    near, far = parted(edges, group)
    kind = near.schema["src"].dataType
    out = solved(near, longest_paths(max_edges, limit), StructType().add("src", kind).add("dst", kind).add("path", ArrayType(kind)))
    return out if far is None else out.unionByName(maximal_paths(simple_paths(far, max_edges), limit))


def as_findings(cross_file: DataFrame) -> DataFrame:
    """Cross-file pairs as findings with ids made of what they are."""
    key = F.md5(F.concat_ws("|", "type", "source", "target"))
    return cross_file.select(
        key.alias("id"), F.col("type").alias("title"), F.concat_ws(" ", F.lit("input of"), "source", F.lit("reaches"), "target").alias("description"), F.col("source_file").alias("file_path"), F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"), F.col("type").alias("vulnerability_type"), S.normal_severity(F.col("severity")).alias("severity"), F.col("confidence"), F.col("cwe").alias("cwe_id"), F.col("owasp").alias("owasp_category"), F.lit("").alias("snippet"), F.lit("").alias("recommendation"),
    )


def flows_as_findings(flows: DataFrame) -> DataFrame:
    """Taint flows (src, dst, type, risk) as findings: severity by risk, confidence is the risk."""
    return flows.select(F.md5(F.concat_ws("|", "type", F.col("src").cast("string"), F.col("dst").cast("string"))).alias("id"), F.col("type").alias("vulnerability_type"), S.risk_severity(F.col("risk")).alias("severity"), F.col("risk").alias("confidence"))


def entities(units: DataFrame, order: str) -> DataFrame:
    """One row for each path::name, the last in an order."""
    key = F.concat_ws("::", "path", "name")
    return units.withColumn("entity", key).withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc(order)))).filter("_r = 1").drop("_r")


def retained(df: DataFrame, column: str, now: str, days: int) -> DataFrame:
    """Rows not older than so many days."""
    return df.filter(F.col(column).cast("timestamp") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def context_score(calls: Column, flows: Column, functions: Column, similarities: Column) -> Column:
    """Mean of the parts of a context that are there (null parts are left out): calls / 5, flows / 3, functions / 10, similarities / 4."""
    parts = F.filter(F.array(*[F.when(c.isNotNull(), F.least(F.lit(1.0), c / d)) for c, d in ((calls, 5.0), (flows, 3.0), (functions, 10.0), (similarities, 4.0))]), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(F.lit(0.0))


def flat_knowledge(knowledge: DataFrame) -> DataFrame:
    """(id, cve_id, severity, references) of nested knowledge: the first CVE's id and severity, all references once."""
    first = F.get("cves", 0)
    refs = F.array_sort(F.array_distinct(F.flatten(F.transform("cves", lambda c: F.coalesce(c["references"], F.array().cast("array<string>"))))))
    return knowledge.select("id", first["cve_id"].alias("cve_id"), first["severity"].alias("severity"), F.coalesce(refs, F.array().cast("array<string>")).alias("references"))


def impact_level(n_functions: Column, depth: Column, names: Column) -> Column:
    """critical, high, medium or low by the functions affected, the depth, and words of their names."""
    heavy = F.aggregate(names, F.lit(0.0), lambda acc, n: acc + F.when(S.contains_any(F.lower(n), rules.SENSITIVE_PATTERNS), 1.0).otherwise(0.0))
    return S.banded(0.1 * n_functions + 0.2 * depth + heavy, ((8, "critical"), (5, "high"), (2, "medium")), "low")


def ab_summary(comparison: DataFrame) -> DataFrame:
    """One row over compared metrics (control_mean, treatment_mean, significant)."""
    better, worse = F.col("treatment_mean") > F.col("control_mean"), F.col("treatment_mean") < F.col("control_mean")
    return comparison.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("significant") & better).alias("improved"), F.count_if(F.col("significant") & worse).alias("worsened"), F.round(100 * (F.avg("control_mean") - F.avg("treatment_mean")) / F.avg("control_mean"), 6).alias("gain_percent"))
