"""Queries over telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..operators import reports as R
from ..operators import telemetry as T
from ..sources import adapters as A


def layer_stats_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return T.layer_stats(A.metrics(spark, sf), F.window("ts", "1 hour"))


def layer_stats_60s(spark: SparkSession, sf: str) -> DataFrame:
    return T.layer_stats(A.metrics(spark, sf), F.window("ts", "60 seconds")).select("start", "layer", "n", "failures", "mean", "error_rate")


def layer_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return T.ranked_quantiles(A.metrics(spark, sf), "layer", "value", {"p95": 0.95, "p99": 0.99})


def anomaly_vs_history(spark: SparkSession, sf: str) -> DataFrame:
    s = T.with_anomalies(T.layer_stats(A.metrics(spark, sf), F.window("ts", "1 day")))
    return s.select("start", "layer", "n", "slow", "failing", "stalled")


def performance_alerts(spark: SparkSession, sf: str) -> DataFrame:
    s = T.layer_stats(A.metrics(spark, sf), F.window("ts", "1 day"))
    return T.threshold_alerts(s.select("start", "layer", "mean", "error_rate"), {"response_time": F.col("mean") / 10, "error_rate": F.col("error_rate") / 4})


def performance_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = T.layer_stats(A.metrics(spark, sf), F.window("ts", "1 day"))
    score = S.performance_score(F.col("mean") / 10, F.col("error_rate"), F.col("n").cast("double"), F.col("last") / 300)
    return s.select("start", "layer", score.alias("score"))


def tuning_advice(spark: SparkSession, sf: str) -> DataFrame:
    return T.tuning(T.layer_stats(A.metrics(spark, sf), F.window("ts", "1 day"))).groupBy("layer", "advice").agg(F.count(F.lit(1)).alias("n"))


def trend_windows(spark: SparkSession, sf: str) -> DataFrame:
    return T.trends(A.quality_metrics(spark, sf))


def retain_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return T.keep_last(A.metrics(spark, sf), ["layer"], 100).select("event_id", "layer", "value")


def quality_assessments(spark: SparkSession, sf: str) -> DataFrame:
    return T.assessments(A.quality_metrics(spark, sf), ["layer", "operation"])


def quality_metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return T.metric_summary(A.quality_metrics(spark, sf), ["metric_type"]).select("metric_type", "n", "mean", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "median", "stdev", F.round("last", 6).alias("last"))


def quality_alerts(spark: SparkSession, sf: str) -> DataFrame:
    m = A.quality_metrics(spark, sf).groupBy("layer", "operation", "metric_type").agg(F.round(F.avg("value"), 6).alias("value"))
    return m.withColumn("severity", S.quality_alert(F.col("metric_type"), F.col("value"))).filter("severity is not null")


def log_window_agg(spark: SparkSession, sf: str) -> DataFrame:
    return T.log_windows(A.metrics(spark, sf), F.window("ts", "6 hours"))


def sliding_quality(spark: SparkSession, sf: str) -> DataFrame:
    q = A.quality_metrics(spark, sf).groupBy(F.window("ts", "1 day", "6 hours").alias("w"), "metric_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return q.select(F.col("w.start").alias("start"), "metric_type", "n", "mean")


def audit_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    e = A.audit_events(spark, sf).withColumn("risk", S.audit_risk(F.col("event_type"), F.col("result"), F.col("security_level")))
    names = ["event_type", "result", "security_level"]
    return e.groupingSets([[F.col(n)] for n in names], *names).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round("risk", 6) >= 0.7).alias("risky"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return T.sessions(A.table(spark, sf, "events"), "12 hours", ["user_id"])


def health_status(spark: SparkSession, sf: str) -> DataFrame:
    m = A.metrics(spark, sf).groupBy(F.concat_ws("/", "layer", F.col("operation").cast("string")).alias("component")).agg(F.avg("value").alias("v"))
    return T.system_status(m.withColumn("status", F.when(F.col("v") > 130, "unhealthy").when(F.col("v") > 105, "warning").otherwise("healthy")))


def quality_trend_ols(spark: SparkSession, sf: str) -> DataFrame:
    q = A.quality_metrics(spark, sf).select("layer", F.struct("ts", "event_id").alias("ord"), F.col("value").alias("score"))
    return T.ordinary_trend(q, "layer")


def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    d, y = A.table(spark, sf, "documents"), A.table(spark, sf, "labels")
    rows = d.join(y, "doc_id").select("lang", F.regexp_like("text", F.lit(r"(!!|%%%|\*\*\*)")).alias("predicted"), (F.col("quality") == 0).alias("actual"))
    return T.confusion(rows.filter("lang is not null"), ["lang"])


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """1 - Brier score of confidences, and the share of confident verdicts, by model."""
    v = A.verdicts(spark, sf)
    brier = F.avg(F.pow(F.col("confidence") - F.col("is_valid").cast("double"), F.lit(2.0)))
    return v.groupBy("model").agg(F.round(1 - brier, 6).alias("calibration"), F.round(F.avg((F.col("confidence") > 0.8).cast("double")), 6).alias("confident"), F.round(F.avg((F.col("confidence") < 0.5).cast("double")), 6).alias("doubtful"))


def quality_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Nine quality dimensions of verdicts by model, weighted."""
    v = A.verdicts(spark, sf)
    truth = F.col("finding_id") % 3 != 0
    predicted = F.col("confidence") >= 0.5
    n = F.count(F.lit(1))
    tp, pp, ap = F.count_if(predicted & truth), F.count_if(predicted), F.count_if(truth)
    d = {
        "accuracy": F.count_if(predicted == truth) / n, "precision": F.when(pp > 0, tp / pp).otherwise(1.0), "recall": F.when(ap > 0, tp / ap).otherwise(1.0),
        "confidence_calibration": S.clamp(1 - F.avg(F.pow(F.col("confidence") - truth.cast("double"), F.lit(2.0)))),
        "consistency": F.greatest(F.lit(0.0), 1 - 2 * F.coalesce(F.stddev_samp("confidence"), F.lit(0.0))),
        "completeness": 0.3 * F.avg((F.col("confidence") > 0).cast("double")) + 0.25 * F.avg((F.col("weight") > 0.6).cast("double")) + 0.25 * F.avg((F.col("weight") > 1.0).cast("double")) + 0.2 * F.avg(F.col("is_valid").cast("double")),
        "timeliness": S.timeliness(F.avg("weight") * 20), "robustness": 0.4 + 0.35 * S.clamp(1 - F.abs(F.avg((~F.col("is_valid")).cast("double")) - 0.1) / 0.1) + 0.25 * S.clamp(1 - F.abs(F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)) - 0.15) / 0.15),
    }
    g = v.groupBy("model").agg(*[c.alias(k) for k, c in d.items()])
    g = g.withColumn("f1_score", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    overall = F.round(sum((F.col(k) * w for k, w in rules.DIMENSION_WEIGHTS.items()), F.lit(0.0)), 6)
    return g.select("model", *[F.round(k, 6).alias(k) for k in rules.DIMENSION_WEIGHTS], overall.alias("overall"), S.banded(overall, rules.DIMENSION_LEVELS, "critical").alias("level"))


def ab_test_report(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves of orders compared by priority: means, effect size, significance by the normal approximation, power."""
    o = A.table(spark, sf, "orders").select("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "control").otherwise("treatment").alias("grp"), "o_totalprice")
    g = o.groupBy(F.col("o_orderpriority").alias("metric")).pivot("grp", ["control", "treatment"]).agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"), F.count(F.lit(1)).alias("n"))
    c = F.col
    g = g.withColumn("pooled", F.sqrt((c("control_sd") * c("control_sd") + c("treatment_sd") * c("treatment_sd")) / 2)).withColumn("effect", F.when(c("pooled") > 0, (c("treatment_mean") - c("control_mean")) / c("pooled")).otherwise(0.0))
    spread = (c("control_sd") + c("treatment_sd")) / 2
    z = F.when(spread > 0, F.abs(c("treatment_mean") - c("control_mean")) / (spread / F.sqrt(c("control_n")))).otherwise(0.0)
    p = S.first_match(((z > 2.58, 0.01), (z > 1.96, 0.05), (z > 1.64, 0.10)), 0.5)
    power = S.first_match(((F.abs(c("effect")) > 0.8, 0.9), (F.abs(c("effect")) > 0.5, 0.7), (F.abs(c("effect")) > 0.2, 0.5)), 0.3)
    return g.select("metric", F.round("control_mean", 4).alias("control_mean"), F.round("treatment_mean", 4).alias("treatment_mean"), F.round("effect", 6).alias("effect"), p.alias("p_value"), power.alias("power"), ((p < 0.05) & (F.abs(c("effect")) >= 0.1)).alias("significant"))


def ab_t_test(spark: SparkSession, sf: str) -> DataFrame:
    """Two halves of orders compared by priority and status: Student's t with pooled variance, interval, significance, power."""
    o = A.table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "c").otherwise("t").alias("grp"), "o_totalprice")
    g = o.groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("metric")).pivot("grp", ["c", "t"]).agg(F.avg("o_totalprice").alias("mean"), F.var_samp("o_totalprice").alias("var"), F.count(F.lit(1)).alias("n"))
    return R.t_tests(g.filter("c_n > 1 AND t_n > 1"), 0.05, 0.1)


QUERIES = {
    f.__name__: f
    for f in (layer_stats_hourly, layer_stats_60s, layer_quantiles, anomaly_vs_history, performance_alerts, performance_scores, tuning_advice, trend_windows, retain_last_n, quality_assessments, quality_metric_summary,
              quality_alerts, log_window_agg, sliding_quality, audit_grouping_sets, user_sessions, health_status, quality_trend_ols, confusion_metrics, calibration, quality_dimensions, ab_test_report, ab_t_test)
}

_M, _Q = A.with_roles("metrics"), A.with_roles("quality_metrics")


def _quantile(p: float) -> str:
    m = f"({p} * (len(v) + 1))"
    j = f"least(greatest(CAST(floor({m}) AS BIGINT), 1), len(v) - 1)"
    return f"round(CASE WHEN len(v) >= 20 THEN v[{j}] + ({m} - {j}) * (v[{j} + 1] - v[{j}]) ELSE 0.0 END, 6)"


def _stats(bucket: str) -> str:
    return f"""{_M}, g AS (SELECT {bucket} AS start, layer, count(*) AS n, count(*) FILTER (failed) AS failures, avg(value) AS mean, min(value) AS low, max(value) AS high, list_sort(list(value)) AS v,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span, arg_max(value, ts) AS last FROM metrics GROUP BY 1, 2),
        s AS (SELECT start, layer, n, failures, round(mean, 6) AS mean, low, high, {_quantile(0.95)} AS p95, {_quantile(0.99)} AS p99, round(CASE WHEN span > 0 THEN n / span ELSE 0.0 END, 6) AS throughput, round(failures * 1.0 / n, 6) AS error_rate, last FROM g)"""


_DAY, _HOUR = "date_trunc('day', ts)", "date_trunc('hour', ts)"
_RISK = """round(least(CAST(1.0 AS DOUBLE), CAST(CASE event_type WHEN 'security_violation' THEN 0.9 WHEN 'user_login' THEN 0.3 WHEN 'configuration_changed' THEN 0.6 WHEN 'data_access' THEN 0.4 WHEN 'error_occurred' THEN 0.5 ELSE 0.3 END AS DOUBLE)
    * CASE result WHEN 'failure' THEN 1.5 WHEN 'partial' THEN 1.2 ELSE 1.0 END * CASE security_level WHEN 'public' THEN 0.5 WHEN 'confidential' THEN 1.5 WHEN 'restricted' THEN 2.0 ELSE 1.0 END), 6)"""
_PAST = "OVER (PARTITION BY layer ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_DIMS = " + ".join(f"{k} * {w}" for k, w in rules.DIMENSION_WEIGHTS.items())


def _banded(x: str, bands, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {low} THEN '{label}'" for low, label in bands) + f" ELSE '{default}' END"


def _simpson(f: str, low: str, high: str, k: int, i: str = "i") -> str:
    """Integral of f([x]) from low to high by Simpson's rule over k parts."""
    at = f"(({low}) + (({high}) - ({low})) * {i} / CAST({k} AS DOUBLE))"
    return f"(({high}) - ({low})) / {3 * k} * list_sum(list_transform(range({k + 1}), lambda {i}: (CASE WHEN {i} = 0 OR {i} = {k} THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END) * {f.replace('[x]', at)}))"


_DENSITY = "exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * ln(1 + [x] * [x] / df)) / sqrt(pi() * df)"
_SPREAD = "exp(ln(2) + df / 2 * ln(df / 2) + (df - 1) * ln([x]) - df * [x] * [x] / 2 - lgamma(df / 2))"
_NORMAL = _simpson("exp(-([x]) * ([x]) / 2)", "0", "(crit * [s] - shift)", 200, "j").replace("[s]", "[x]")
#: By integration of densities: t's for the probability, and by halving for the critical value; for the power that of the spread s times the normal distribution of t * s - shift.
_T_TEST = f"""WITH RECURSIVE g AS (SELECT o_orderpriority || '/' || o_orderstatus AS metric, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS cm, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS tm, var_samp(o_totalprice) FILTER (o_orderkey % 2 = 0) AS cv,
        var_samp(o_totalprice) FILTER (o_orderkey % 2 = 1) AS tv, CAST(count(*) FILTER (o_orderkey % 2 = 0) AS DOUBLE) AS cn, CAST(count(*) FILTER (o_orderkey % 2 = 1) AS DOUBLE) AS tn FROM orders GROUP BY 1),
    e AS (SELECT *, cn + tn - 2 AS df, sqrt(((cn - 1) * cv + (tn - 1) * tv) / (cn + tn - 2)) AS pooled FROM g WHERE cn > 1 AND tn > 1),
    t AS (SELECT *, (tm - cm) / (pooled * sqrt(1 / cn + 1 / tn)) AS t, (tm - cm) / sqrt((cv + tv) / 2) AS effect FROM e),
    h(metric, df, k, low, high) AS (SELECT metric, df, 0, CAST(0 AS DOUBLE), CAST(40 AS DOUBLE) FROM t UNION ALL
        SELECT metric, df, k + 1, CASE WHEN p > 0.05 THEN m ELSE low END, CASE WHEN p > 0.05 THEN high ELSE m END FROM (SELECT *, 1 - 2 * {_simpson(_DENSITY, "0", "m", 400)} AS p FROM (SELECT *, (low + high) / 2 AS m FROM h WHERE k < 45) x) y),
    c AS (SELECT t.*, h.low AS crit, effect * sqrt((cn + tn) / 2) AS shift FROM t JOIN h ON h.metric = t.metric AND h.k = 45),
    p AS (SELECT *, 1 - 2 * {_simpson(_DENSITY, "0", "abs(t)", 1000)} AS p_value,
        {_simpson(_SPREAD + " * (0.5 - " + _NORMAL + " / sqrt(2 * pi()))", "greatest(1e-6, 1 - 12 / sqrt(2 * df))", "1 + 12 / sqrt(2 * df)", 400)} AS power FROM c)
    SELECT metric, round(t, 6) AS t, CAST(df AS BIGINT) AS df, round(p_value, 6) AS p_value, round(effect, 6) AS effect, round(tm - cm - crit * sqrt(cv / cn + tv / tn), 2) AS low, round(tm - cm + crit * sqrt(cv / cn + tv / tn), 2) AS high,
        round(power, 6) AS power, p_value < 0.05 AND abs(effect) >= 0.1 AS significant FROM p"""

SQL = {
    "layer_stats_hourly": f"{_stats(_HOUR)} SELECT * FROM s",
    "layer_stats_60s": _M + " SELECT date_trunc('minute', ts) AS start, layer, count(*) AS n, count(*) FILTER (failed) AS failures, round(avg(value), 6) AS mean, round(count(*) FILTER (failed) * 1.0 / count(*), 6) AS error_rate FROM metrics GROUP BY 1, 2",
    "layer_quantiles": f"{_M}, g AS (SELECT layer, count(*) AS n, list_sort(list(value)) AS v FROM metrics GROUP BY 1) SELECT layer, CAST(n AS BIGINT) AS n, {_quantile(0.95)} AS p95, {_quantile(0.99)} AS p99 FROM g",
    "anomaly_vs_history": f"""{_stats(_DAY)} SELECT start, layer, n, coalesce(mean > 2 * round(avg(mean) {_PAST}, 9), false) AS slow, coalesce(error_rate > round(3 * avg(error_rate) {_PAST}, 9) AND error_rate > 0.05, false) AS failing,
        coalesce(throughput < round(0.5 * avg(throughput) {_PAST}, 9) AND avg(throughput) {_PAST} > 0, false) AS stalled FROM s""",
    "performance_alerts": f"""{_stats(_DAY)}, a AS (SELECT start, layer, mean, error_rate, 'response_time' AS metric, mean / 10 AS alert_value, CASE WHEN mean / 10 >= 30 THEN 'critical' WHEN mean / 10 >= 10 THEN 'error' WHEN mean / 10 >= 5 THEN 'warning' END AS alert FROM s
        UNION ALL SELECT start, layer, mean, error_rate, 'error_rate', CAST(error_rate AS DOUBLE) / 4, CASE WHEN error_rate / 4 >= 0.2 THEN 'critical' WHEN error_rate / 4 >= 0.1 THEN 'error' WHEN error_rate / 4 >= 0.05 THEN 'warning' END FROM s) SELECT * FROM a WHERE alert IS NOT NULL""",
    "performance_scores": f"""{_stats(_DAY)} SELECT start, layer, CAST(greatest(0.0, 100.0 - CASE WHEN mean / 10 > 10 THEN 40 WHEN mean / 10 > 5 THEN 20 WHEN mean / 10 > 1 THEN 10 ELSE 0 END - CASE WHEN error_rate > 0.1 THEN 30 WHEN error_rate > 0.05 THEN 15 WHEN error_rate > 0.01 THEN 5 ELSE 0 END
        - CASE WHEN n < 1 THEN 20 WHEN n < 5 THEN 10 ELSE 0 END - CASE WHEN last / 300 > 0.9 THEN 10 WHEN last / 300 > 0.8 THEN 5 ELSE 0 END) AS DOUBLE) AS score FROM s""",
    "tuning_advice": f"""{_stats(_DAY)}, a AS (SELECT layer, unnest([CASE WHEN mean > 10 THEN 'raise concurrency' END, CASE WHEN error_rate > 0.1 THEN 'add retries' END, CASE WHEN high > 8 * mean THEN 'cut outliers' END, CASE WHEN throughput < 1 THEN 'enlarge batches' END]) AS advice FROM s)
        SELECT layer, advice, count(*) AS n FROM a WHERE advice IS NOT NULL GROUP BY 1, 2""",
    "trend_windows": f"""{_Q}, w AS (SELECT *, row_number() OVER (PARTITION BY metric_type, layer ORDER BY ts DESC, event_id DESC) AS r FROM quality_metrics), g AS (SELECT metric_type, layer, count(*) AS k, avg(value) FILTER (r <= 10) AS c, avg(value) FILTER (r > 10) AS p FROM w WHERE r <= 20 GROUP BY 1, 2),
        h AS (SELECT *, round(CASE WHEN p <> 0 THEN (c - p) / p ELSE 0.0 END, 6) AS change FROM g WHERE k = 20)
        SELECT metric_type, layer, round(c, 6) AS current, round(p, 6) AS previous, change, CASE WHEN abs(change) < 0.05 THEN 'stable' WHEN (change > 0) = (metric_type <> 'false_positive_rate') THEN 'improving' ELSE 'declining' END AS direction, CASE WHEN abs(change) < 0.05 THEN 0.0 ELSE least(1.0, abs(change)) END AS strength FROM h""",
    "retain_last_n": _M + " SELECT event_id, layer, value FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY ts DESC, event_id DESC) AS r FROM metrics) x WHERE r <= 100",
    "quality_assessments": f"""{_Q}, m AS (SELECT layer, operation, metric_type, least(1.0, greatest(0.0, avg(value))) AS v FROM quality_metrics GROUP BY 1, 2, 3), w AS (SELECT *, CASE metric_type WHEN 'accuracy' THEN 0.25 WHEN 'precision' THEN 0.2 ELSE 0.1 END AS w, CASE WHEN metric_type = 'false_positive_rate' THEN 1 - v ELSE v END AS x FROM m),
        o AS (SELECT layer, operation, round(sum(w * x) / sum(w), 6) AS overall, count(*) AS n_types FROM w GROUP BY 1, 2) SELECT *, {_banded('overall', rules.QUALITY_LEVELS, 'critical')} AS level FROM o""",
    "quality_metric_summary": _Q + " SELECT metric_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS stdev, round(arg_max(value, ts), 6) AS last FROM quality_metrics GROUP BY 1",
    "quality_alerts": f"""{_Q}, m AS (SELECT layer, operation, metric_type, round(avg(value), 6) AS value FROM quality_metrics GROUP BY 1, 2, 3), a AS (SELECT *, CASE metric_type WHEN 'accuracy' THEN CASE WHEN value <= 0.5 THEN 'critical' WHEN value <= 0.65 THEN 'high' WHEN value <= 0.75 THEN 'medium' WHEN value <= 0.85 THEN 'low' END
        WHEN 'false_positive_rate' THEN CASE WHEN value >= 0.4 THEN 'critical' WHEN value >= 0.25 THEN 'high' WHEN value >= 0.15 THEN 'medium' WHEN value >= 0.1 THEN 'low' END
        WHEN 'confidence_score' THEN CASE WHEN value <= 0.4 THEN 'critical' WHEN value <= 0.55 THEN 'high' WHEN value <= 0.7 THEN 'medium' WHEN value <= 0.8 THEN 'low' END END AS severity FROM m) SELECT * FROM a WHERE severity IS NOT NULL""",
    "log_window_agg": _M + """, w AS (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start FROM metrics) SELECT start, count(*) AS n, count(*) FILTER (failed) AS errors, count(DISTINCT layer) AS layers, round(count(*) FILTER (failed) * 1.0 / count(*), 6) AS error_rate,
        coalesce(array_to_string(list_sort(list(event_id) FILTER (failed))[1:5], ','), '') AS first_errors FROM w GROUP BY start""",
    "sliding_quality": _Q + """, w AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS start, metric_type, value FROM quality_metrics, (VALUES (0), (1), (2), (3)) s(k)) SELECT start, metric_type, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2""",
    "audit_grouping_sets": A.with_roles("audit_events") + f", e AS (SELECT *, {_RISK} AS risk FROM audit_events) SELECT event_type, result, security_level, count(*) AS n, count(*) FILTER (risk >= 0.7) AS risky FROM e GROUP BY GROUPING SETS ((event_type), (result), (security_level))",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "health_status": _M + """, m AS (SELECT layer, operation, avg(value) AS v FROM metrics GROUP BY 1, 2), s AS (SELECT count(*) AS n, count(*) FILTER (v > 130) AS unhealthy, count(*) FILTER (v > 105 AND v <= 130) AS warning FROM m)
        SELECT n, CAST(0 AS BIGINT) AS critical, unhealthy, warning, CASE WHEN unhealthy > n * 0.5 THEN 'unhealthy' WHEN unhealthy > 0 OR warning > n * 0.3 THEN 'warning' ELSE 'healthy' END AS status FROM s""",
    "quality_trend_ols": f"""{_Q}, h AS (SELECT layer, value AS score, row_number() OVER (PARTITION BY layer ORDER BY ts, event_id) - 1 AS x FROM quality_metrics), g AS (SELECT layer, count(*) AS n, regr_slope(score, x) AS slope, regr_intercept(score, x) AS i, avg(score) AS m, coalesce(stddev_samp(score), 0) AS sd, arg_max(score, x) AS c FROM h GROUP BY 1)
        SELECT layer, n, round(slope, 8) AS slope, round(i, 6) AS intercept, round(m, 6) AS mean, round(sd, 6) AS stdev, round(c, 6) AS current, CASE WHEN round(slope, 8) > 0.01 THEN 'improving' WHEN round(slope, 8) < -0.01 THEN 'declining' ELSE 'stable' END AS direction,
        round(least(1.0, greatest(0.0, c + slope * 7)), 6) AS forecast, round(greatest(0.1, 1 - sd), 6) AS forecast_confidence FROM g WHERE n >= 3""",
    "confusion_metrics": """WITH r AS (SELECT lang, regexp_matches(text, '(!!|%%%|\\*\\*\\*)') AS p, quality = 0 AS a FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL), g AS (SELECT lang, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (NOT p AND a) AS fn FROM r GROUP BY 1),
        q AS (SELECT *, tp * 1.0 / nullif(tp + fp, 0) AS pr, tp * 1.0 / nullif(tp + fn, 0) AS re FROM g) SELECT lang, tp, fp, tn, fn, round((tp + tn) * 1.0 / nullif(tp + fp + tn + fn, 0), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END, 6) AS f1,
        round(fp * 1.0 / nullif(fp + tn, 0), 6) AS fpr, round(fn * 1.0 / nullif(fn + tp, 0), 6) AS fnr FROM q""",
    "calibration": A.with_roles("verdicts") + " SELECT model, round(1 - avg(power(confidence - CASE WHEN is_valid THEN 1.0 ELSE 0.0 END, 2)), 6) AS calibration, round(avg(CASE WHEN confidence > 0.8 THEN 1.0 ELSE 0.0 END), 6) AS confident, round(avg(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS doubtful FROM verdicts GROUP BY model",
    "quality_dimensions": A.with_roles("verdicts") + f""", x AS (SELECT *, finding_id % 3 <> 0 AS t, confidence >= 0.5 AS p FROM verdicts), g AS (SELECT model, count(*) FILTER (p = t) * 1.0 / count(*) AS accuracy, CASE WHEN count(*) FILTER (p) > 0 THEN count(*) FILTER (p AND t) * 1.0 / count(*) FILTER (p) ELSE 1.0 END AS precision,
        CASE WHEN count(*) FILTER (t) > 0 THEN count(*) FILTER (p AND t) * 1.0 / count(*) FILTER (t) ELSE 1.0 END AS recall, least(1.0, greatest(0.0, 1 - avg(power(confidence - CASE WHEN t THEN 1.0 ELSE 0.0 END, 2)))) AS confidence_calibration,
        coalesce(stddev_samp(confidence), 0) AS sd, 0.3 * avg(CASE WHEN confidence > 0 THEN 1.0 ELSE 0.0 END) + 0.25 * avg(CASE WHEN weight > 0.6 THEN 1.0 ELSE 0.0 END) + 0.25 * avg(CASE WHEN weight > 1.0 THEN 1.0 ELSE 0.0 END) + 0.2 * avg(CASE WHEN is_valid THEN 1.0 ELSE 0.0 END) AS completeness,
        avg(weight) * 20 AS secs, avg(CASE WHEN is_valid THEN 0.0 ELSE 1.0 END) AS inv FROM x GROUP BY model),
        h AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score, greatest(0.0, 1 - 2 * sd) AS consistency, CASE WHEN secs <= 5 THEN 1.0 WHEN secs <= 15 THEN 0.8 + 0.2 * (15 - secs) / 10 WHEN secs <= 30 THEN 0.6 + 0.2 * (30 - secs) / 15 WHEN secs <= 60 THEN 0.4 + 0.2 * (60 - secs) / 30 ELSE greatest(0.0, 0.4 - (secs - 60) / 60) END AS timeliness,
        0.4 + 0.35 * least(1.0, greatest(0.0, 1 - abs(inv - 0.1) / 0.1)) + 0.25 * least(1.0, greatest(0.0, 1 - abs(sd - 0.15) / 0.15)) AS robustness FROM g), o AS (SELECT *, round({_DIMS}, 6) AS overall FROM h)
        SELECT model, {", ".join(f"round({k}, 6) AS {k}" for k in rules.DIMENSION_WEIGHTS)}, overall, {_banded('overall', rules.DIMENSION_LEVELS, 'critical')} AS level FROM o""",
    "ab_test_report": """WITH g AS (SELECT o_orderpriority AS metric, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS cm, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS tm, stddev_samp(o_totalprice) FILTER (o_orderkey % 2 = 0) AS cs, stddev_samp(o_totalprice) FILTER (o_orderkey % 2 = 1) AS ts, count(*) FILTER (o_orderkey % 2 = 0) AS cn FROM orders GROUP BY 1),
        e AS (SELECT *, (tm - cm) / sqrt((cs * cs + ts * ts) / 2) AS effect, abs(tm - cm) / (((cs + ts) / 2) / sqrt(cn)) AS z FROM g), p AS (SELECT *, CAST(CASE WHEN z > 2.58 THEN 0.01 WHEN z > 1.96 THEN 0.05 WHEN z > 1.64 THEN 0.1 ELSE 0.5 END AS DOUBLE) AS p_value FROM e)
        SELECT metric, round(cm, 4) AS control_mean, round(tm, 4) AS treatment_mean, round(effect, 6) AS effect, p_value, CAST(CASE WHEN abs(effect) > 0.8 THEN 0.9 WHEN abs(effect) > 0.5 THEN 0.7 WHEN abs(effect) > 0.2 THEN 0.5 ELSE 0.3 END AS DOUBLE) AS power, p_value < 0.05 AND abs(effect) >= 0.1 AS significant FROM p""",
    "ab_t_test": _T_TEST,
}
