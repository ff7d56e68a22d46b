"""Look-ups, statistics and summaries over what an audit keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..functions import statistics as T
from .joins import met


def latest(rows: DataFrame, since: str | None = None, limit: int | None = None, ts: str = "ts", order: tuple[str, ...] = (), **equal: object) -> DataFrame:
    """Rows with the given values, not older than since, the latest first, at most limit of them."""
    out = rows
    for column, value in equal.items():
        if value is not None:
            out = out.filter(F.col(column) == F.lit(value))
    if since is not None:
        out = out.filter(F.col(ts) >= F.lit(since).cast("timestamp"))
    out = out.orderBy(F.desc(ts), *order)
    return out if limit is None else out.limit(limit)


def metrics_of(metrics: DataFrame, layer: str | None = None, operation: object = None, since: str | None = None) -> DataFrame:
    """Metrics of a layer, or without one of an operation, or all; not older than since."""
    out = metrics.filter(F.col("layer") == layer) if layer else metrics.filter(F.col("operation") == operation) if operation is not None else metrics
    return out if since is None else out.filter(F.col("ts") >= F.lit(since).cast("timestamp"))


def fresh(results: DataFrame, now: str, seconds: int = 30, ts: str = "ts") -> DataFrame:
    """Cached results younger than so many seconds."""
    return results.filter(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp")) < seconds)


def project_statistics(entities: DataFrame, **edges: DataFrame) -> DataFrame:
    """(kind, value): entities, files, entities by type, and the number of edges of each graph given."""
    totals = entities.agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("path").alias("files"))
    out = totals.select(F.explode(F.array(F.struct(F.lit("entities").alias("kind"), F.col("entities").alias("value")), F.struct(F.lit("files").alias("kind"), F.col("files").alias("value")))).alias("x")).select("x.*")
    out = out.unionByName(entities.groupBy(F.concat(F.lit("type:"), F.col("type")).alias("kind")).agg(F.count(F.lit(1)).alias("value")))
    for name, e in edges.items():
        out = out.unionByName(e.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("value")))
    return out


def merged_clusters(findings: DataFrame, cluster: str) -> DataFrame:
    """A row for each cluster with all that its members say: the one of the longest description, descriptions, confidence, tasks."""
    base = F.min_by("id", F.struct(-F.length("description"), F.col("id"))).alias("id")
    merged = F.array_join(F.array_sort(F.collect_set("description")), "\n\n").alias("description")
    return findings.groupBy(cluster).agg(base, merged, F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("merged"), F.countDistinct("task_id").alias("n_tasks"))


def overall_summary(layers: DataFrame) -> DataFrame:
    """One row over layers (n, errors, mean): mean response weighted by requests, error rate."""
    n = F.sum("n")
    return layers.agg(n.alias("n"), F.sum("errors").alias("errors"), F.round(F.sum(F.col("mean") * F.col("n")) / n, 6).alias("mean_response"), F.round(F.sum("errors") / n, 6).alias("error_rate"))


def executive_summary(assessments: DataFrame, trends: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: assessments by level, mean score and its level, trends up and down, critical alerts."""
    counts = assessments.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    by_level = counts.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "level", F.col("n").cast("string")))), ",").alias("levels"))
    mean = assessments.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    mean = mean.withColumn("overall", S.banded(F.col("mean_score"), rules.SUMMARY_LEVELS, "critical"))
    moves = trends.agg(F.count_if(F.col("direction") == "improving").alias("improving"), F.count_if(F.col("direction") == "declining").alias("declining"))
    critical = alerts.agg(F.count_if(F.col("severity") == "critical").alias("critical_alerts"))
    return mean.join(F.broadcast(by_level)).join(F.broadcast(moves)).join(F.broadcast(critical))  # one row each


def metric_level(metric: Column, value: Column) -> Column:
    """Quality level by the metric's own thresholds; of a rate of false positives less is better."""
    out = F.lit(None).cast("string")
    for name, levels in rules.METRIC_LEVELS.items():
        better = (lambda t: value <= t) if name == "false_positive_rate" else (lambda t: value >= t)
        out = F.when(metric == name, S.first_match(((better(t), level) for level, t in levels), "critical")).otherwise(out)
    return out


def grouped_statistics(table: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): counts by each column alone, in one pass, and the total."""
    sets = [[F.col(c)] for c in columns] + [[]]
    g = table.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(columns)])
    name, value = F.lit("total"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        name, value = F.when(F.col(f"_g{i}") == 0, F.lit(c)).otherwise(name), F.when(F.col(f"_g{i}") == 0, F.col(c).cast("string")).otherwise(value)
    return g.select(name.alias("column"), value.alias("value"), "n")


def case_statistics(cases: DataFrame) -> DataFrame:
    """One row over cases (similarity_score, case_date): number, mean similarity, first and last date."""
    return cases.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity_score"), 6).alias("mean_similarity"), F.min("case_date").alias("earliest"), F.max("case_date").alias("latest"))


def pattern_statistics(patterns: DataFrame) -> DataFrame:
    """One row over learned patterns (pattern_id, usage, success): number, those in use, the most used, mean success."""
    most = F.min_by("pattern_id", F.struct(-F.col("usage"), F.col("pattern_id")))
    return patterns.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("usage") > 0).alias("active"), most.alias("most_used"), F.round(F.avg("success"), 6).alias("mean_success"))


def top_factors(factors: dict[str, Column], weights: dict[str, float], k: int = 3) -> Column:
    """array<struct<name, contribution>>: the k factors whose score times weight is largest."""
    parts = [F.struct(F.round(-c * weights[n], 9).alias("order"), F.lit(n).alias("name")) for n, c in factors.items()]
    return F.transform(F.slice(F.array_sort(F.array(*parts)), 1, k), lambda x: F.struct(x["name"].alias("name"), F.round(-x["order"], 6).alias("contribution")))


def explanation(score: Column) -> Column:
    """Band of an overall confidence."""
    return S.banded(score, ((0.8, "high"), (0.6, "medium")), "low")


def running_means(rows: DataFrame, keys: list[str], batch: str, value: str) -> DataFrame:
    """(keys, batch, n, mean): the mean of all values up to each batch, from sums by batch."""
    sums = rows.groupBy(*keys, batch).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    upto = Window.partitionBy(*keys).orderBy(batch)
    n = F.sum("_n").over(upto)
    return sums.select(*keys, batch, n.alias("n"), F.round(F.sum("_s").over(upto) / n, 6).alias("mean"))


def task_confidence(task_type: Column, n_findings: Column) -> Column:
    """1 without findings, else 0.8 times the type's factor."""
    return F.when(n_findings == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 0.8 * S.lookup(task_type, rules.TASK_FACTORS, 0.8)))


def due(frequency: Column, updated: Column, now: Column) -> Column:
    """Whether a source is due for refresh: never read, or longer ago than its frequency; of other frequencies never."""
    days = S.lookup(frequency, {"daily": 1, "weekly": 7, "monthly": 30})
    return F.when(updated.isNull(), F.lit(True)).otherwise(F.coalesce(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(updated.cast("timestamp")) > days * 86400, F.lit(False)))


def expired(created: Column, ttl: Column, now: Column) -> Column:
    """Whether a cache entry (seconds) is past its time to live; a null ttl never is."""
    return F.coalesce(now - created > ttl, F.lit(False))


def cache_reads(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests (request, entry, at) with hit: whether an entry (entry, created, ttl) is there and not expired."""
    j = requests.join(entries.select("entry", "created", "ttl"), "entry", "left")
    return j.select("request", "entry", (F.col("created").isNotNull() & (F.col("created") <= F.col("at")) & ~expired(F.col("created"), F.col("ttl"), F.col("at"))).alias("hit"))


def rag_evidence(relevance: Column, similarities: Column, cases: Column) -> Column:
    """Mean of what is there of the highest relevance, the highest similarity and the cases' mean similarity; arrays, 0 without any."""
    mean = F.aggregate(cases, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(cases), F.lit(1))
    parts = F.filter(F.array(F.coalesce(F.array_max(relevance), F.lit(0.0)), F.coalesce(F.array_max(similarities), F.lit(0.0)), mean), lambda x: x > 0)
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)).otherwise(F.lit(0.0))


def integrated_confidence(validation: Column, evidence: Column) -> Column:
    """0.7 of the validation's confidence and 0.3 of the evidence, where there is evidence."""
    return F.when(evidence > 0, 0.7 * validation + 0.3 * evidence).otherwise(validation)


def source_health(checks: DataFrame) -> DataFrame:
    """(source, status, response_time): the latest check of each source (source, ts, ok, seconds)."""
    last = checks.groupBy("source").agg(F.max_by(F.struct("ok", "seconds"), F.struct("ts", "check_id")).alias("c"))
    return last.select("source", F.when(F.col("c.ok"), "healthy").otherwise("unhealthy").alias("status"), F.when(F.col("c.ok"), F.col("c.seconds")).otherwise(0.0).alias("response_time"))


def merged_results(results: DataFrame) -> DataFrame:
    """(query, items, relevance): the distinct items of all sources of a query, and the relevance of those that gave any.

    results: query, source, kind (cve, practice, case, rag), item.
    """
    r = results.filter("item is not null")
    named = F.concat_ws("_", F.col("kind"), F.col("source"))
    scored = F.concat_ws(":", named, S.lookup(F.col("kind"), rules.SOURCE_RELEVANCE, 0.6).cast("string"))
    return r.groupBy("query").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(scored)).alias("relevance"))


def first_contexts(hits: DataFrame, limit: int = 10) -> DataFrame:
    """(place, id): the first `limit` distinct ids of several ranked queries (query, rank, id), in order of query and rank."""
    once = hits.groupBy("id").agg(F.min(F.struct("query", "rank")).alias("at"))
    top = once.orderBy("at", "id").limit(limit)
    return top.select(F.row_number().over(Window.orderBy("at", "id")).cast("long").alias("place"), "id")


def best_practices(findings: DataFrame, exact: DataFrame, simple: DataFrame, default: list[str]) -> DataFrame:
    """(id, practices): those of the index by type, else of the simple table by type, else by one type holding the other, else
    the default ones.  exact, simple: type, practice; types are matched once, and a finding meets one list."""
    kinds = findings.select(F.lower("type").alias("type")).distinct()

    def lists(table: DataFrame) -> DataFrame:
        return table.groupBy(F.lower("type").alias("known")).agg(F.array_sort(F.collect_set("practice")).alias("practices"))

    one, two = lists(exact), lists(simple)
    a = kinds.join(one, kinds.type == one.known).select("type", F.col("practices").alias("a"))
    b = kinds.join(two, kinds.type == two.known).select("type", F.col("practices").alias("b"))
    holds = F.contains(F.col("type"), F.col("known")) | F.contains(F.col("known"), F.col("type"))
    c = met(kinds, two, holds).groupBy("type").agg(F.min_by("practices", "known").alias("c"))
    found = kinds.join(a, "type", "left").join(b, "type", "left").join(c, "type", "left")
    found = found.select("type", F.coalesce("a", "b", "c", F.array(*[F.lit(x) for x in default])).alias("practices"))
    return findings.withColumn("_t", F.lower("type")).join(found.withColumnRenamed("type", "_t"), "_t").select("id", "practices")


def path_nodes(paths: DataFrame) -> DataFrame:
    """paths (id, path, clean: the nodes that sanitise) exploded to nodes with their role: source, sink or intermediate."""
    p = paths.select("id", F.size("path").alias("n"), "clean", F.posexplode("path").alias("pos", "node"))
    role = F.when(F.col("pos") == 0, "source").when(F.col("pos") == F.col("n") - 1, "sink").otherwise("intermediate")
    return p.select("id", "pos", "node", role.alias("role"), F.array_contains("clean", F.col("node")).alias("sanitizes"))


def path_edges(paths: DataFrame) -> DataFrame:
    """paths (id, path) exploded to edges (id, pos, src, dst)."""
    steps = F.transform(F.slice("path", 1, F.size("path") - 1), lambda x, i: F.struct(x.alias("src"), F.get("path", i + 1).alias("dst")))
    return paths.select("id", F.posexplode(steps).alias("pos", "e")).select("id", "pos", "e.src", "e.dst")


def named_paths(edges: DataFrame, nodes: DataFrame, source: str, target: str) -> DataFrame:
    """Shortest paths from nodes (node, name) whose name has one word to nodes whose name has the other."""
    from .graph import shortest_paths

    has = lambda w: F.contains(F.lower("name"), F.lit(w.lower()))
    p = shortest_paths(edges, sources=nodes.filter(has(source)).select(F.col("node").alias("src")))
    return p.filter("src <> dst").join(nodes.filter(has(target)).select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "path", "n")


def structure_metrics(units: DataFrame, edges: DataFrame) -> DataFrame:
    """units (unit, start_line, end_line, code) with lines, complexity, dependencies and dependents of the graph of edges."""
    e = edges.select("src", "dst").distinct()
    # both ends of an edge in one reading and one shuffle
    end = lambda c, o, i: F.struct(F.col(c).alias("unit"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    ends = e.select(F.explode(F.array(end("src", 1, 0), end("dst", 0, 1))).alias("x")).select("x.*")
    counts = ends.groupBy("unit").agg(F.sum("o").alias("dependencies"), F.sum("i").alias("dependents"))
    size = F.col("end_line") - F.col("start_line") + 1
    u = units.select("unit", size.alias("lines"), unit_complexity(F.col("code"), size).alias("complexity"))
    return u.join(counts, "unit", "left").select("unit", "lines", "complexity", F.coalesce("dependencies", F.lit(0)).alias("dependencies"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


def unit_complexity(code: Column, n_lines: Column) -> Column:
    """Lines, two points a branch word, one a call; 1 at least."""
    branches = F.regexp_count(code, F.lit(r"\b(if|else|elif|for|while|try|except|catch|switch|case)\b"))
    return F.greatest(F.lit(1), n_lines + 2 * branches + F.regexp_count(code, F.lit(r"(?<!\w)\w++\(")))


def t_tests(groups: DataFrame, alpha: float, least_effect: float) -> DataFrame:
    """metric, t, df, p_value, effect, low, high, power, significant: Student's t test of rows of two groups' means, variances and sizes.

    groups: metric, c_mean, c_var, c_n (control) and t_mean, t_var, t_n (treatment), sizes of 2 at least.  The interval is that of the
    difference of the means; the effect is the difference by the root of the mean variance, the power that of finding it.
    """
    c = F.col
    df, difference = c("c_n") + c("t_n") - 2, c("t_mean") - c("c_mean")
    pooled = F.sqrt(((c("c_n") - 1) * c("c_var") + (c("t_n") - 1) * c("t_var")) / df)
    t = F.when(pooled > 0, difference / (pooled * F.sqrt(1 / c("c_n") + 1 / c("t_n")))).otherwise(0.0)
    spread = F.sqrt((c("c_var") + c("t_var")) / 2)
    g = groups.withColumns({"_t": t, "_df": df, "_effect": F.when(spread > 0, difference / spread).otherwise(0.0), "_crit": T.t_critical(alpha, df)})
    g = g.withColumns({"_p": T.t_two_sided(c("_t"), c("_df")), "_power": T.t_power(c("_crit"), c("_df"), c("_effect") * F.sqrt((c("c_n") + c("t_n")) / 2)), "_margin": c("_crit") * F.sqrt(c("c_var") / c("c_n") + c("t_var") / c("t_n"))})
    return g.select(
        "metric", F.round("_t", 6).alias("t"), c("_df").cast("long").alias("df"), F.round("_p", 6).alias("p_value"), F.round("_effect", 6).alias("effect"), F.round(difference - c("_margin"), 2).alias("low"),
        F.round(difference + c("_margin"), 2).alias("high"), F.round("_power", 6).alias("power"), ((c("_p") < alpha) & (F.abs(c("_effect")) >= least_effect)).alias("significant"),
    )
