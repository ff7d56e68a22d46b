"""Metrics, quality and audit telemetry.  Every transformation works on batch and streaming tables alike where its windows allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..storage import numbered, stored
from .joins import small


def exclusive_quantile(values: Column, p: float, least: int = 20) -> Column:
    """Quantile of an array at p * (n + 1), interpolated; 0 for fewer than `least` values."""
    v, n = F.array_sort(values), F.size(values)
    m = p * (n + 1)
    j = F.least(F.greatest(F.floor(m).cast("int"), F.lit(1)), n - 1)
    low, high = F.element_at(v, j), F.element_at(v, j + 1)
    return F.when(n >= least, low + (m - j) * (high - low)).otherwise(F.lit(0.0))


def layer_stats(metrics: DataFrame, window: Column, keys: list[str] | None = None) -> DataFrame:
    """Statistics of metrics (ts, value, failed and keys) by window: requests, failures, mean, least, most, P95, P99, rates."""
    keys = keys or ["layer"]
    g = metrics.groupBy(window.alias("window"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.collect_list("value").alias("values"), (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("span"), F.max_by("value", "ts").alias("last"),
    )
    span = F.col("span") / 1e6
    return g.select(
        F.col("window.start").alias("start"), *keys, "n", "failures", F.round("mean", 6).alias("mean"), "low", "high",
        F.round(exclusive_quantile(F.col("values"), 0.95), 6).alias("p95"), F.round(exclusive_quantile(F.col("values"), 0.99), 6).alias("p99"),
        F.round(F.when(span > 0, F.col("n") / span).otherwise(0.0), 6).alias("throughput"), F.round(F.col("failures") / F.col("n"), 6).alias("error_rate"), "last",
    )


def ranked_quantiles(rows: DataFrame, key: str, value: str, quantiles: dict[str, float], least: int = 20) -> DataFrame:
    """(key, n, the quantiles by name): exclusive_quantile() of all values of a key, whose values are in no one task.

    Equal values are counted first, then dealt by ranges of (key, value); a range's first rank comes from one row for each key and
    range.  n counts all rows, ranks only those with a value; a null key is a key.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = stored(counts.repartitionByRange("_key", "_value").withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy(F.col("_key").alias("_k"), F.col("_range").alias("_r")).agg(F.sum("_c").alias("_size"))
    of_key = Window.partitionBy("_k")
    starts = sizes.select("_k", "_r", (F.sum("_size").over(of_key.orderBy("_r")) - F.col("_size")).alias("_before"), F.sum("_size").over(of_key).alias("_all"))
    within = F.sum("_c").over(Window.partitionBy("_key", "_range").orderBy("_value"))
    d = dealt.withColumn("_within", within).join(small(starts), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    last, n = F.col("_before") + F.col("_within"), F.col("_all")
    rank = {q: F.least(F.greatest(F.floor(p * (n + 1)), F.lit(1)), n - 1) for q, p in quantiles.items()}
    at = lambda j: F.max(F.when((last - F.col("_c") < j) & (j <= last), F.col("_value")))
    found = [x for q, j in rank.items() for x in (at(j).alias(f"_low_{q}"), at(j + 1).alias(f"_high_{q}"))]
    g = d.groupBy("_key").agg(F.max("_all").alias("_all"), *found)
    part = lambda q, p: p * (F.col("_all") + 1) - rank[q]
    value_of = lambda q, p: F.when(F.col("_all") >= least, F.col(f"_low_{q}") + part(q, p) * (F.col(f"_high_{q}") - F.col(f"_low_{q}"))).otherwise(F.lit(0.0))
    g = g.select("_key", *[value_of(q, p).alias(f"_{q}") for q, p in quantiles.items()])
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return totals.join(g, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "n", *[F.round(F.coalesce(F.col(f"_{q}"), F.lit(0.0)), 6).alias(q) for q in quantiles])


def with_anomalies(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Flags against the mean of all earlier windows of the same key."""
    keys = keys or ["layer"]
    past = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    old = {c: F.avg(c).over(past) for c in ("mean", "error_rate", "throughput")}
    return stats.select(
        "*", F.coalesce(F.col("mean") > 2 * F.round(old["mean"], 9), F.lit(False)).alias("slow"),
        F.coalesce((F.col("error_rate") > F.round(3 * old["error_rate"], 9)) & (F.col("error_rate") > 0.05), F.lit(False)).alias("failing"),
        F.coalesce((F.col("throughput") < F.round(0.5 * old["throughput"], 9)) & (old["throughput"] > 0), F.lit(False)).alias("stalled"),
    )


def threshold_alerts(stats: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row for each metric that reaches a threshold, with its highest level.  values: metric to column."""
    alerts = [F.when(S.alert_level(m, c).isNotNull(), F.struct(F.lit(m).alias("metric"), S.alert_level(m, c).alias("level"), c.cast("double").alias("value"))) for m, c in values.items()]
    return stats.withColumn("_a", F.explode(F.array_compact(F.array(*alerts)))).select(*stats.columns, F.col("_a.metric").alias("metric"), F.col("_a.level").alias("alert"), F.col("_a.value").alias("alert_value"))


def tuning(stats: DataFrame) -> DataFrame:
    """Advice for each layer: slow, failing, short of memory, idle."""
    s = F.col
    advice = F.array_compact(F.array(
        F.when(s("mean") > 10, F.lit("raise concurrency")), F.when(s("error_rate") > 0.1, F.lit("add retries")),
        F.when(s("high") > 8 * s("mean"), F.lit("cut outliers")), F.when(s("throughput") < 1, F.lit("enlarge batches")),
    ))
    return stats.withColumn("advice", F.explode(advice))


def trends(metrics: DataFrame, n: int = 10, keys: tuple[str, ...] = ("metric_type", "layer")) -> DataFrame:
    """Mean of the last n values against the n before them, by key; keys with fewer than 2n values have none."""
    recent = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))
    w = metrics.withColumn("r", recent).filter(F.col("r") <= 2 * n)
    g = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.avg(F.when(F.col("r") <= n, F.col("value"))).alias("current"), F.avg(F.when(F.col("r") > n, F.col("value"))).alias("previous")).filter(F.col("k") == 2 * n)
    change = F.round(F.when(F.col("previous") != 0, (F.col("current") - F.col("previous")) / F.col("previous")).otherwise(0.0), 6)
    lower = F.col("metric_type").isin("false_positive_rate", "false_negative_rate", "response_time")
    rising = F.when(lower, F.lit("declining")).otherwise(F.lit("improving"))
    falling = F.when(lower, F.lit("improving")).otherwise(F.lit("declining"))
    direction = F.when(F.abs(change) < 0.05, F.lit("stable")).when(change > 0, rising).otherwise(falling)
    strength = F.when(F.abs(change) < 0.05, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.abs(change)))
    return g.select(*keys, F.round("current", 6).alias("current"), F.round("previous", 6).alias("previous"), change.alias("change"), direction.alias("direction"), strength.alias("strength"))


def keep_last(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n latest rows of each key; the rank limit is applied before the shuffle too."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("_r") <= n).drop("_r")


def assessments(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted quality of each key from its means by metric type, and its level; rates of false positives count inverted."""
    means = metrics.groupBy(*keys, "metric_type").agg(F.avg("value").alias("mean"))
    weight = S.lookup(F.col("metric_type"), rules.QUALITY_WEIGHTS, 0.0)
    clamped = S.clamp(F.col("mean"))
    value = F.when(weight < 0, 1 - clamped).otherwise(clamped)
    overall = F.round(F.coalesce(F.sum(F.abs(weight) * value) / F.nullif(F.sum(F.abs(weight)), F.lit(0.0)), F.lit(0.0)), 6)
    return means.groupBy(*keys).agg(overall.alias("overall"), F.count(F.lit(1)).alias("n_types")).withColumn("level", S.banded(F.col("overall"), rules.QUALITY_LEVELS, "critical"))


def metric_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("stdev"), F.max_by("value", F.struct("ts", "event_id")).alias("last"),
    )


def log_windows(logs: DataFrame, window: Column) -> DataFrame:
    """Counts by level and layer in each window, error share and the first five errors."""
    w = logs.groupBy(window.alias("window")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors"), F.countDistinct("layer").alias("layers"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("event_id")))), 1, 5).alias("first_errors"),
    )
    return w.select(F.col("window.start").alias("start"), "n", "errors", "layers", F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"), F.array_join(F.transform("first_errors", lambda x: x.cast("string")), ",").alias("first_errors"))


def system_status(components: DataFrame) -> DataFrame:
    """One row from component states (component, status): critical if any is; unhealthy above half; warning above 30 % or if any is unhealthy."""
    n = F.count(F.lit(1))
    bad, warn, crit = F.count_if(F.col("status") == "unhealthy"), F.count_if(F.col("status") == "warning"), F.count_if(F.col("status") == "critical")
    status = F.when(n == 0, "unknown").when(crit > 0, "critical").when(bad > n * 0.5, "unhealthy").when((bad > 0) | (warn > n * 0.3), "warning").otherwise("healthy")
    return components.agg(n.alias("n"), crit.alias("critical"), bad.alias("unhealthy"), warn.alias("warning"), status.alias("status"))


def sessions(events: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Runs of events of a key with no gap as long as `gap`."""
    s = events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*keys, F.col("w.start").alias("start"), "n")


def ordinary_trend(history: DataFrame, key: str) -> DataFrame:
    """Least-squares line through scores in time order by key (key, ord, score): slope, direction, forecast a week on.

    ord is unique within its key.  Rows are numbered by ranges of (key, ord), so a key's rows may lie in any number of tasks; a
    line's slope is the same over numbers that start elsewhere, and its intercept is moved to the key's first.
    """
    h = numbered(history, [F.col(key), F.col("ord")], "_place").withColumn("x", F.col("_place").cast("double"))
    start = F.avg("score") - F.regr_slope("score", "x") * (F.avg("x") - F.min("x"))
    g = h.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("score", "x").alias("slope"), start.alias("intercept"), F.avg("score").alias("mean"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("stdev"), F.max_by("score", "x").alias("current"),
    ).filter("n >= 3")
    slope = F.round("slope", 8)
    return g.select(
        key, "n", slope.alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), F.round("current", 6).alias("current"),
        F.when(slope > 0.01, "improving").when(slope < -0.01, "declining").otherwise("stable").alias("direction"), F.round(S.clamp(F.col("current") + F.col("slope") * 7), 6).alias("forecast"),
        F.round(F.greatest(F.lit(0.1), 1 - F.col("stdev")), 6).alias("forecast_confidence"),
    )


def confusion(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts of (predicted, actual) by key, and the rates they give; null where undefined."""
    p, a = F.col("predicted"), F.col("actual")
    g = rows.groupBy(*keys).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & ~a).alias("tn"), F.count_if(~p & a).alias("fn"))

    def rate(x: Column, y: Column) -> Column:
        return F.when(y > 0, x / y)

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = rate(tp, tp + fp), rate(tp, tp + fn)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))
    out = {"accuracy": rate(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "f1": f1, "fpr": rate(fp, fp + tn), "fnr": rate(fn, fn + tp)}
    return g.select(*keys, "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(n) for n, c in out.items()])
