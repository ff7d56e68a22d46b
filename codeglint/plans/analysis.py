"""Queries over texts, filters, retrieval and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import tasks as K
from ..operators import validation as V
from ..operators import vector_index as VI
from ..sources import adapters as A
from ..storage import new_path


def _docs(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.max(X.token_estimate(F.col("text"))).alias("most"))


def char_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = _docs(spark, sf).select("doc_id", F.posexplode(X.char_chunks(F.col("text"))).alias("pos", "chunk"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("chunk").cast("long").alias("size"), F.md5("chunk").alias("digest"))


def nesting_depth(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "pages")
    return p.select("page_id", X.nesting_depth(F.col("html")).cast("long").alias("depth"))


def truncated_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = X.truncated(F.col("text"), 300)
    return _docs(spark, sf).select("doc_id", F.length(t).cast("long").alias("size"), F.md5(t).alias("digest"))


def keyword_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword similarity of each document with the one before it in its source, by the keywords of their whole texts.

    The window moves ids only; keywords are joined to them.
    """
    docs = _docs(spark, sf)
    pairs = docs.select("doc_id", F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("other")).filter("other is not null")
    words = docs.select("doc_id", X.tokens(F.col("text")).alias("k"))
    d = pairs.join(words, "doc_id").join(words.select(F.col("doc_id").alias("other"), F.col("k").alias("before")), "other")
    jaccard, similarity = S.jaccard(F.col("k"), F.col("before"), 1.0, 0.0), X.keyword_similarity(F.col("k"), F.col("before"))
    return d.select("doc_id", F.round(jaccard, 6).alias("jaccard"), F.round(similarity, 6).alias("similarity"))


def context_windows_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with shouting or markup, three lines around, merged."""
    files = _docs(spark, sf).withColumnRenamed("text", "content")
    w = V.line_windows(files, F.regexp_like("line", F.lit("[|<>]|!!")), 3)
    w = w.withColumn("relevance", F.round(F.col("start_line") % 10 / 10.0, 6)).withColumn("important", F.col("start_line") % 11 == 0)
    return V.merged_windows(w, "doc_id", 0.2).select("doc_id", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "relevance", "n")


def html_script_blocks(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "pages")
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    return p.select("page_id", F.size(blocks).cast("long").alias("n_scripts"), F.coalesce(F.aggregate(blocks, F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)).cast("long").alias("script_chars"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<a\s"), F.lit(0))).cast("long").alias("n_links"))


def file_risks(spark: SparkSession, sf: str) -> DataFrame:
    f = A.source_files(spark, sf)
    risk = X.file_risk(F.col("path"), F.col("content"), F.lit(0))
    return f.groupBy("language", X.file_group(F.col("path"), F.col("content")).alias("grp"), risk.cast("long").alias("risk")).agg(F.count(F.lit(1)).alias("n"))


def _findings(spark, sf):
    f = A.findings(spark, sf).dropDuplicates(["id"])
    line = F.col("start_line")
    snippet = F.when(line % 7 == 0, "# test sql query here").when(line % 7 == 1, "cursor.execute(select + where or 1=1)").when(line % 7 == 2, "validate(x); escape(x); check(x)").when(line % 7 == 3, "TODO {{ value }}").otherwise("os.system(cmd); subprocess")
    path = F.when(line % 5 == 0, F.concat(F.lit("tests/"), "file_path")).when(line % 5 == 1, F.concat(F.lit("docs/"), "file_path")).otherwise(F.col("file_path"))
    return f.withColumn("snippet", snippet).withColumn("file_path", path)


def fp_rules(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf).withColumn("m", V.rule_match(F.col("file_path"), F.col("snippet")))
    return f.groupBy(F.coalesce("m.rule", F.lit("none")).alias("rule"), "type").agg(F.count(F.lit(1)).alias("n"), F.max("m.confidence").alias("confidence"))


def fp_rule_rates(spark: SparkSession, sf: str) -> DataFrame:
    return V.rule_rates(_findings(spark, sf).select(V.rule_match(F.col("file_path"), F.col("snippet"))["rule"].alias("rule")))


def fp_combined(spark: SparkSession, sf: str) -> DataFrame:
    """Rules, protection, impact and semantics combined to verdicts."""
    f = _findings(spark, sf)
    c = {
        "rule": V.rule_match(F.col("file_path"), F.col("snippet"))["confidence"], "protection": V.protected_context(F.col("snippet"), F.array(F.col("file_path"))),
        "impact": V.low_impact(F.col("confidence") / 2, F.col("start_line") % 3, F.lit("low")), "semantics": V.semantic_mismatch(F.col("confidence") / 2, F.col("start_line") % 2),
    }
    verdict, reason, confidence = V.combined(c)
    g = f.select(verdict.alias("false_positive"), F.coalesce(reason, F.lit("none")).alias("reason"), confidence.alias("c"))
    return g.groupBy("false_positive", "reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_confidence"))


def learned_patterns(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.createDataFrame([(*x, f"2024-05-{10 * i + 1:02d}", i, 0.5) for i, x in enumerate(rules.LEARNED_PATTERNS)], "pattern_id string, finding_type string, pattern string, confidence double, created string, usage int, success double")
    m = V.learned_matches(_findings(spark, sf), p.withColumn("created", F.to_date("created")), "2024-06-15")
    return m.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))


def confidence_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf).withColumn("description", F.concat_ws(" ", "type", F.lit("near cursor.execute(select")))
    factors = {
        "code_quality": V.code_quality(F.col("snippet"), F.col("file_path"), F.col("type")), "pattern_match": V.pattern_match(F.col("snippet"), F.col("type")),
        "historical_accuracy": V.default_accuracy(F.col("type")), "semantic_coherence": V.semantic_coherence(F.col("description"), F.col("snippet"), F.col("type"), F.col("file_path"), F.col("severity")),
        "cross_validation": V.cross_validation(F.col("confidence") > 0.5, F.col("start_line") % 4, F.col("confidence"), F.lit(0.1)),
    }
    f = f.select("type", "severity", F.round(V.overall_confidence(factors), 6).alias("score"))
    return f.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 5).alias("mean"), F.round(F.min("score"), 5).alias("low"), F.round(F.max("score"), 5).alias("high"))


def time_decayed_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    e = A.metrics(spark, sf).select("layer", "ts", (F.col("value") / 200).alias("predicted"), (F.col("operation") % 2 == 0).alias("actual"))
    return V.decayed_accuracy(e, "layer", "2025-01-01 00:00:00")


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of all vectors to each whose id is divisible by 50."""
    return _topk(spark, sf, "cosine")


def _indexed(spark, sf, probes):
    v, path = A.table(spark, sf, "embeddings"), new_path(spark, "vector-index")
    VI.build(v, path)
    found = VI.search(spark, path, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, probes)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest to each vector whose id is divisible by 50 that an index of all vectors finds in the cells nearest to it."""
    return _indexed(spark, sf, None)


def index_search_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same with all cells opened: every vector is in the index."""
    return _indexed(spark, sf, VI.MOST_CELLS)


def l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _topk(spark, sf, "l2")


def _topk(spark, sf, by):
    v = A.table(spark, sf, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.nearest(v, q, 5, by).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def practice_match(spark: SparkSession, sf: str) -> DataFrame:
    f = _findings(spark, sf).select("id", F.lit("general").alias("language"), F.concat_ws(" ", F.lit("chmod 777"), "snippet", F.lit("md5(password) SELECT a + 'x'")).alias("content"))
    return R.practice_matches(f).groupBy("rule", "type", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))


CASES = (
    ("c1", "sql injection", "cursor.execute(select from where)"), ("c2", "xss", "document write script"), ("c3", "injection", "os.system(cmd)"), ("c4", "sql injection", "execute select or"),
)


def _cases(spark, sf):
    f = _findings(spark, sf).select("id", "type", F.col("snippet").alias("code"))
    return f, spark.createDataFrame(CASES, "case_id string, type string, code string")


def similar_cases(spark: SparkSession, sf: str) -> DataFrame:
    """How often each case has which rank among those similar to a finding, by the whole of code similarity."""
    return R.similar_cases(*_cases(spark, sf)).groupBy("case_id", "rank").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("similarity"))


def case_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The same by tokens alone."""
    return R.similar_cases(*_cases(spark, sf), by="tokens").groupBy("case_id", "rank").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("similarity"))


def planned_tasks(spark: SparkSession, sf: str) -> DataFrame:
    f = A.source_files(spark, sf).select("path", "content")
    return K.planned_tasks(f).groupBy("task_type", "priority", "risk", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("files")).alias("n_files"), F.round(F.sum("seconds"), 4).alias("seconds"))


def task_schedule(spark: SparkSession, sf: str) -> DataFrame:
    t = K.planned_tasks(A.source_files(spark, sf).select("path", "content"))
    return K.schedule(t, K.task_dependencies(t)).select("task_id", "task_type", "layer", "position")


def task_batches(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return K.consecutive_batches(o, "o_orderkey", ["o_orderstatus"], 3, ["o_custkey"]).groupBy("o_custkey", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


def breaker_states(spark: SparkSession, sf: str) -> DataFrame:
    m = A.metrics(spark, sf)
    c = m.select(F.col("operation").alias("service"), F.col("event_id").alias("call_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), (~F.col("failed")).alias("ok"))
    return K.breaker_states(c, "service", failures=2, pause=3600).groupBy("service", "state", "allowed").agg(F.count(F.lit(1)).alias("n"))


def ema_success(spark: SparkSession, sf: str) -> DataFrame:
    """Moving success rate of each layer and operation over all metrics, folded day by day."""
    m = A.metrics(spark, sf).select("layer", "operation", F.struct("ts", "event_id").alias("ord"), (F.col("value") > 50).alias("ok"), F.to_date("ts").alias("day"))
    return K.moving_success(m, ["layer", "operation"], "day")


def message_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last three turns of each conversation and role."""
    c = A.table(spark, sf, "conversations")
    r = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"), F.desc("text")))
    return c.withColumn("r", r).filter("r <= 3").select("conv_id", "role", "turn", F.length("text").cast("long").alias("size"))


QUERIES = {
    f.__name__: f
    for f in (token_counts, char_chunks, nesting_depth, truncated_texts, keyword_jaccard, context_windows_merged, html_script_blocks, file_risks, fp_rules, fp_rule_rates, fp_combined, learned_patterns, confidence_scores,
              time_decayed_accuracy, cosine_topk, index_search, index_search_exact, l2_topk, practice_match, similar_cases, case_tokens, planned_tasks, task_schedule, task_batches, breaker_states, ema_success, message_history)
}

_TEXT = "SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents"
_FIND = A.with_roles("findings") + """, f AS (SELECT id, type, severity, confidence, start_line, CASE start_line % 7 WHEN 0 THEN '# test sql query here' WHEN 1 THEN 'cursor.execute(select + where or 1=1)' WHEN 2 THEN 'validate(x); escape(x); check(x)' WHEN 3 THEN 'TODO {{ value }}' ELSE 'os.system(cmd); subprocess' END AS snippet,
    CASE start_line % 5 WHEN 0 THEN 'tests/' || file_path WHEN 1 THEN 'docs/' || file_path ELSE file_path END AS file_path FROM (SELECT DISTINCT * FROM findings) x)"""
_RULE = ", r AS (SELECT *, CASE WHEN start_line % 5 = 0 THEN 'test_file_rule' WHEN start_line % 7 = 0 THEN 'comment_rule' WHEN start_line % 5 = 1 THEN 'documentation_rule' WHEN start_line % 7 = 3 THEN 'placeholder_rule' END AS rule FROM f), c AS (SELECT *, CAST(CASE rule WHEN 'test_file_rule' THEN 0.9 WHEN 'comment_rule' THEN 0.95 WHEN 'documentation_rule' THEN 0.8 WHEN 'placeholder_rule' THEN 0.75 END AS DOUBLE) AS rc FROM r)"


def _count(text: str, words) -> str:
    return "(" + " + ".join("CASE WHEN contains(" + text + ", '" + w.replace("'", "''") + "') THEN 1 ELSE 0 END" for w in words) + ")"


_GROUP = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({w}), '{x}')" for x in words) + f" THEN '{g}'" for g, w, words in rules.FILE_GROUPS) + " ELSE 'low_risk' END"
_LINES = "len(string_split(content, chr(10)))"
_FILE_RISK = f"least(10, 2 * {_count('lower(content)', rules.FILE_HIGH_RISK)} + {_count('lower(content)', rules.FILE_MEDIUM_RISK)} + CASE WHEN contains(lower(path), '.py') OR contains(lower(path), '.js') OR contains(lower(path), '.php') OR contains(lower(path), '.java') THEN 1 ELSE 0 END + CASE WHEN {_LINES} > 500 THEN 2 WHEN {_LINES} > 200 THEN 1 ELSE 0 END)"
_TASKS = A.with_roles("source_files") + f""", g AS (SELECT path, {_LINES} AS n_lines, {_GROUP} AS grp, {_FILE_RISK} AS score FROM source_files),
    h AS (SELECT *, CASE WHEN score >= 8 THEN 'critical' WHEN score >= 6 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS risk FROM g), p AS (SELECT *, CASE WHEN grp IN ('test', 'config') THEN grp ELSE risk END AS plan, CAST(floor((row_number() OVER (PARTITION BY risk, grp ORDER BY path) - 1) / 10.0) AS BIGINT) AS batch FROM h),
    b AS (SELECT risk, grp, plan, batch, list_sort(list(path)) AS files, sum(n_lines) AS n_lines FROM p GROUP BY 1, 2, 3, 4),
    k(plan, task_type, priority) AS (VALUES {", ".join(f"('{plan}', '{t}', {n})" for plan, ts in rules.TASK_PLANS.items() for t, n in ts)}),
    t AS (SELECT md5(concat_ws('|', task_type, risk, grp, batch)) AS task_id, task_type, priority, risk, grp, files, CASE task_type WHEN 'syntax_check' THEN 0.5 WHEN 'logic_analysis' THEN 2.0 WHEN 'security_scan' THEN 3.0 ELSE 1.5 END * CASE WHEN n_lines > 1000 THEN 1.3 ELSE 1.0 END AS seconds FROM b JOIN k USING (plan))"""

def _profile_sql() -> str:
    """Pattern match of snippet s (lower case) for type k, as in operators.validation.pattern_match."""
    parts = []
    for name, (words, dangerous) in rules.PATTERN_PROFILES.items():
        meant = " OR ".join(f"contains(k, '{w}')" for w in (name, *name.split()))
        parts.append(f"CASE WHEN {meant} THEN {_count('s', words)} / CAST({len(words)} AS DOUBLE) * 0.6 + least(1.0, {_count('s', dangerous)} / CAST({max(1.0, len(dangerous) * 0.5)} AS DOUBLE)) * 0.4 ELSE 0.0 END")
    best = f"greatest({', '.join(parts)})"
    return f"CASE WHEN {best} > 0 THEN {best} ELSE least(0.6, {_count('s', rules.GENERIC_SECURITY_WORDS)} / 10.0) END"


def _confidence_sql() -> str:
    length = "CASE WHEN length(snippet) BETWEEN 20 AND 500 THEN 1.0 WHEN length(snippet) < 20 THEN length(snippet) / 20.0 ELSE greatest(0.3, 1.0 - (length(snippet) - 500) / 1000.0) END"
    shape = f"least(1.0, {_count('snippet', '{}()[];')} / 5.0)"
    named = "least(1.0, len(list_filter(tw, lambda w: contains(s, w))) / CAST(greatest(1, len(tw)) AS DOUBLE))"
    place = "CASE WHEN contains(lower(file_path), 'test') OR contains(lower(file_path), 'example') OR contains(lower(file_path), 'demo') OR contains(lower(file_path), 'mock') OR contains(lower(file_path), 'temp') THEN 0.3 ELSE 1.0 END"
    deep = f"least(1.0, {_count('s', ('if', 'for', 'while', 'try', 'catch', 'function', 'class'))} / 3.0)"
    quality = f"least(1.0, greatest(0.0, 0.5 + {length} * 0.2 + {shape} * 0.15 + {named} * 0.25 + {place} * 0.15 + {deep} * 0.25))"
    history = "CASE k " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in rules.DEFAULT_ACCURACIES.items()) + f" ELSE {rules.DEFAULT_ACCURACY} END"
    overlap = "len(list_intersect({0}, sw)) / CAST(greatest(1, len({0})) AS DOUBLE)"
    place_fits = "CASE WHEN contains(k, 'sql') OR contains(k, 'command') OR contains(k, 'path') THEN 1.0 ELSE 0.0 END"
    wanted, found = "CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.4 ELSE 0.5 END", f"least(1.0, {_count('s', ('if', 'for', 'while', 'try', 'function', 'class', 'import'))} / 5.0)"
    meaning = f"least(1.0, greatest(0.0, 0.5 + ({overlap.format('dw')} + {overlap.format('tw')}) / 2 * 0.3 + {place_fits} * 0.1 + (1 - abs({wanted} - {found})) * 0.1))"
    models = "start_line % 4"
    cross = f"CASE WHEN {models} > 0 THEN least(1.0, greatest(0.0, CASE WHEN confidence > 0.5 THEN 0.4 ELSE 0.0 END + least(1.0, {models} / 3.0) * 0.2 + confidence * 0.25 + CASE WHEN {models} > 1 THEN least(1.0, greatest(0.0, 1 - 0.1 / greatest(0.1, confidence))) * 0.15 ELSE 0.0 END)) ELSE 0.5 END"
    w = rules.CONFIDENCE_WEIGHTS
    factors = {"code_quality": quality, "pattern_match": _profile_sql(), "historical_accuracy": history, "semantic_coherence": meaning, "cross_validation": cross}
    total = " + ".join(f"CAST({x} AS DOUBLE) * {w[n]}" for n, x in factors.items())
    return f"""{_FIND}, x AS (SELECT *, lower(snippet) AS s, lower(type) AS k, string_split(type, ' ') AS tw, list_distinct(string_split(lower(snippet), ' ')) AS sw, list_distinct(string_split(type || ' near cursor.execute(select', ' ')) AS dw FROM f),
        y AS (SELECT type, severity, round(({total}) / {sum(w[n] for n in factors)}, 6) AS score FROM x) SELECT type, severity, count(*) AS n, round(avg(score), 5) AS mean, round(min(score), 5) AS low, round(max(score), 5) AS high FROM y GROUP BY 1, 2"""


_SIMILAR = """, q AS (SELECT id, type, list_distinct(regexp_extract_all(lower(snippet), '[\\p{L}\\p{N}_]+')) AS w FROM f), c(case_id, c_type, code) AS (VALUES ('c1', 'sql injection', 'cursor.execute(select from where)'), ('c2', 'xss', 'document write script'), ('c3', 'injection', 'os.system(cmd)'), ('c4', 'sql injection', 'execute select or')),
    d AS (SELECT *, list_distinct(regexp_extract_all(lower(code), '[\\p{L}\\p{N}_]+')) AS v FROM c), j AS (SELECT id, case_id, round(len(list_intersect(w, v)) * 1.0 / len(list_distinct(list_concat(w, v))), 6) AS s FROM q JOIN d ON type = c_type OR (type NOT IN (SELECT c_type FROM c) AND (contains(type, c_type) OR contains(c_type, type)))),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, case_id) AS rank FROM j WHERE s >= 0.3) SELECT case_id, rank, count(*) AS n, CAST(max(s) AS DOUBLE) AS similarity FROM r WHERE rank <= 10 GROUP BY 1, 2"""

SQL = {
    "confidence_scores": _confidence_sql(),
    "case_tokens": _FIND + _SIMILAR,
    "token_counts": f"WITH d AS ({_TEXT}), t AS (SELECT lang, CAST(floor(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) * 1.3) AS BIGINT) AS t FROM d) SELECT lang, count(*) AS n, CAST(sum(t) AS BIGINT) AS tokens, max(t) AS most FROM t GROUP BY lang",
    "char_chunks": f"WITH d AS ({_TEXT}), c AS (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT)))) AS pos FROM d WHERE length(text) > 0) SELECT doc_id, pos, length(substr(text, pos * 800 + 1, 1000)) AS size, md5(substr(text, pos * 800 + 1, 1000)) AS digest FROM c",
    "nesting_depth": """WITH b AS (SELECT page_id, string_split(regexp_replace(html, '[^{}()\\[\\]]', '', 'g'), '') AS c FROM pages), e AS (SELECT page_id, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM b), s AS (SELECT page_id, i, CASE WHEN c IN ('{', '(', '[') THEN 1 WHEN c IN ('}', ')', ']') THEN -1 ELSE 0 END AS d FROM e),
        r AS (SELECT page_id, i, sum(d) OVER (PARTITION BY page_id ORDER BY i) AS p FROM s), q AS (SELECT page_id, p - least(0, min(p) OVER (PARTITION BY page_id ORDER BY i)) AS depth FROM r) SELECT p.page_id, CAST(coalesce(max(depth), 0) AS BIGINT) AS depth FROM pages p LEFT JOIN q USING (page_id) GROUP BY p.page_id""",
    "truncated_texts": f"""WITH d AS ({_TEXT}), h AS (SELECT doc_id, text, substr(text, 1, 300) AS h FROM d), l AS (SELECT *, CASE WHEN contains(h, chr(10)) THEN 300 - instr(reverse(h), chr(10)) ELSE -1 END AS last FROM h),
        t AS (SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN last > 0 AND 300 - last < 50 THEN substr(h, 1, last) || '...' ELSE h || '...' END AS t FROM l) SELECT doc_id, length(t) AS size, md5(t) AS digest FROM t""",
    "keyword_jaccard": f"""WITH d AS ({_TEXT}), k AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS k FROM d), b AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM k),
        j AS (SELECT doc_id, CASE WHEN len(k) = 0 AND len(p) = 0 THEN 1.0 WHEN len(k) = 0 OR len(p) = 0 THEN 0.0 ELSE len(list_intersect(k, p)) * 1.0 / len(list_distinct(list_concat(k, p))) END AS j, len(k) * len(p) AS sized, len(list_intersect(list_intersect(k, p), [{", ".join(f"'{w}'" for w in X.IMPORTANT_WORDS)}])) AS n FROM b WHERE p IS NOT NULL)
        SELECT doc_id, round(j, 6) AS jaccard, round(CASE WHEN sized = 0 THEN 0.0 ELSE least(1.0, j + 0.1 * n) END, 6) AS similarity FROM j""",
    "context_windows_merged": f"""WITH d AS ({_TEXT}), l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
        w AS (SELECT doc_id, greatest(pos - 3, 1) AS start_line, least(pos + 3, n_lines) AS end_line FROM l WHERE regexp_matches(line, '[|<>]|!!')), x AS (SELECT *, round(start_line % 10 / 10.0, 6) AS relevance, start_line % 11 = 0 AS important FROM w),
        f AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY doc_id ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM x WHERE NOT important), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM f),
        g AS (SELECT doc_id, min(start_line) AS start_line, max(end_line) AS end_line, max(relevance) AS relevance, count(*) AS n FROM i GROUP BY doc_id, island) SELECT doc_id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, relevance, n FROM g WHERE relevance >= 0.2
        UNION ALL SELECT doc_id, CAST(start_line AS BIGINT), CAST(end_line AS BIGINT), relevance, 1 FROM x WHERE important""",
    "html_script_blocks": r"""WITH b AS (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS s, len(regexp_extract_all(html, '(?i)<a\s')) AS a FROM pages) SELECT page_id, CAST(len(s) AS BIGINT) AS n_scripts, CAST(length(array_to_string(s, '')) AS BIGINT) AS script_chars, CAST(a AS BIGINT) AS n_links FROM b""",
    "file_risks": A.with_roles("source_files") + f" SELECT language, {_GROUP} AS grp, CAST({_FILE_RISK} AS BIGINT) AS risk, count(*) AS n FROM source_files GROUP BY 1, 2, 3",
    "fp_rules": f"{_FIND}{_RULE} SELECT coalesce(rule, 'none') AS rule, type, count(*) AS n, max(rc) AS confidence FROM c GROUP BY 1, 2",
    "fp_rule_rates": f"""{_FIND}{_RULE}, o(rule, i) AS (VALUES {", ".join(f"('{r[0]}', {i})" for i, r in enumerate(rules.FALSE_POSITIVE_RULES))}), n AS (SELECT o.rule, o.i, count(c.rule) AS filtered FROM o LEFT JOIN c USING (rule) GROUP BY 1, 2), a AS (SELECT *, (SELECT count(*) FROM c) - coalesce(sum(filtered) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS applied FROM n)
        SELECT rule, CAST(applied AS BIGINT) AS applied, filtered, round(CASE WHEN applied > 0 THEN filtered * 1.0 / applied ELSE 0 END, 6) AS rate FROM a""",
    "fp_combined": f"""{_FIND}{_RULE}, x AS (SELECT rc, CASE WHEN start_line % 7 = 2 THEN 0.6 + 0.3 END AS pc, CASE WHEN confidence / 2 < 0.3 AND start_line % 3 <= 1 THEN 0.7 END AS ic, CASE WHEN confidence / 2 < 0.3 AND start_line % 2 > 0 THEN 0.5 + (0.3 - confidence / 2) END AS sc FROM c),
        g AS (SELECT *, greatest(rc, pc, ic, sc) AS best FROM x), v AS (SELECT coalesce(best >= 0.7, false) AS fp, coalesce(best, 0.0) AS best, CASE WHEN best >= 0.7 THEN CASE best WHEN rc THEN 'rule' WHEN pc THEN 'protection' WHEN ic THEN 'impact' ELSE 'semantics' END ELSE 'none' END AS reason FROM g) SELECT fp AS false_positive, reason, count(*) AS n, round(avg(best), 6) AS mean_confidence FROM v GROUP BY 1, 2""",
    "learned_patterns": f"{_FIND} SELECT 'test_sql_1' AS pattern_id, count(*) AS n, CAST(0.8 AS DOUBLE) AS score FROM f WHERE start_line % 7 = 0 AND (contains(type, 'sql') OR contains(type, 'injection')) HAVING count(*) > 0",
    "time_decayed_accuracy": A.with_roles("metrics") + """, r AS (SELECT layer, CASE WHEN (value / 200 > 0.5) = (operation % 2 = 0) THEN 1.0 ELSE 0.0 END AS ok, exp(-floor((epoch(TIMESTAMP '2025-01-01 00:00:00') - floor(epoch(ts))) / 86400) / 30.0) AS w FROM metrics) SELECT layer, count(*) AS n, round(avg(ok), 6) AS accuracy, round(sum(ok * w) / sum(w), 6) AS decayed FROM r GROUP BY layer""",
    "index_search_exact": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10",
    "cosine_topk": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5",
    "l2_topk": "WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(greatest(0.0, 1 - power(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 2) / 100), 9) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 5",
    "practice_match": _FIND + """, t AS (SELECT 'chmod 777 ' || snippet || ' md5(password) SELECT a + ''x''' AS content FROM f), p(rule, type, severity, score, pattern) AS (VALUES ('sql_injection_001', 'sql injection', 'HIGH', 0.9, '(SELECT|INSERT|UPDATE|DELETE).*\\+.*[''"]'), ('owasp_a02_001', 'cryptographic failures', 'MEDIUM', 0.9, '(md5|sha1)\\s*\\([^)]*password'),
        ('owasp_a03_001', 'injection', 'HIGH', 0.85, 'query\\s*=\\s*[''"].*\\$.*[''"]'), ('owasp_a07_001', 'authentication failures', 'MEDIUM', 0.7, 'password\\s*=\\s*[''"][^''"]{1,7}[''"]'), ('nist_ac_001', 'access control', 'HIGH', 0.95, 'chmod\\s+777'), ('nist_sc_001', 'insecure communication', 'MEDIUM', 0.8, 'http://[^/]*password'))
        SELECT rule, type, severity, count(*) AS n, CAST(max(score) AS DOUBLE) AS score FROM t, p WHERE regexp_matches(content, '(?i)' || pattern) GROUP BY 1, 2, 3""",
    "planned_tasks": f"{_TASKS} SELECT task_type, priority, risk, grp, count(*) AS n, CAST(sum(len(files)) AS BIGINT) AS n_files, CAST(round(sum(seconds), 4) AS DOUBLE) AS seconds FROM t GROUP BY 1, 2, 3, 4",
    "task_schedule": f"""{_TASKS.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT DISTINCT a.task_id AS src, b.task_id AS dst FROM (SELECT task_id, task_type, unnest(files) AS f FROM t) a JOIN (SELECT task_id, task_type, unnest(files) AS f FROM t) b ON a.f = b.f WHERE (a.task_type = 'syntax_check' AND b.task_type = 'logic_analysis') OR (a.task_type IN ('logic_analysis', 'dependency_analysis') AND b.task_type = 'security_scan')),
        r(node, layer) AS (SELECT task_id, 0 FROM t UNION SELECT e.dst, layer + 1 FROM r JOIN e ON r.node = e.src), l AS (SELECT node, CAST(max(layer) AS BIGINT) AS layer FROM r GROUP BY node) SELECT task_id, task_type, layer, row_number() OVER (ORDER BY layer, priority, seconds DESC, task_id) AS position FROM t JOIN l ON l.node = t.task_id""",
    "task_batches": """WITH g AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <> o_orderstatus THEN 1 ELSE 0 END AS c FROM orders), r AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM g), b AS (SELECT *, CAST(run AS BIGINT) || '-' || CAST(floor((row_number() OVER (PARTITION BY o_custkey, run ORDER BY o_orderkey) - 1) / 3.0) AS BIGINT) AS batch FROM r)
        SELECT o_custkey, batch, count(*) AS n, min(o_orderkey) AS first_key FROM b GROUP BY 1, 2""",
    "breaker_states": "WITH RECURSIVE " + A.SQL["metrics"] + """, o AS (SELECT operation AS service, epoch(date_trunc('second', ts)) AS sec, NOT failed AS ok,
            row_number() OVER (PARTITION BY operation ORDER BY date_trunc('second', ts), event_id) AS i FROM metrics),
        r(service, i, state, failed, since, allowed) AS (SELECT DISTINCT service, CAST(0 AS BIGINT), 'closed', 0, CAST(0 AS DOUBLE), true FROM o UNION ALL
            SELECT service, i, CASE WHEN blocked THEN 'open' WHEN ok THEN 'closed' WHEN tried OR failed + 1 >= 2 THEN 'open' ELSE 'closed' END, CASE WHEN blocked THEN failed WHEN ok THEN 0 ELSE failed + 1 END,
                CASE WHEN blocked OR ok THEN since ELSE sec END, NOT blocked
            FROM (SELECT o.service, o.i, o.sec, o.ok, r.failed, r.since, r.state = 'open' AND o.sec - r.since <= 3600 AS blocked, r.state = 'open' AND o.sec - r.since > 3600 AS tried FROM r JOIN o ON o.service = r.service AND o.i = r.i + 1) x)
        SELECT CAST(service AS VARCHAR) AS service, state, allowed, count(*) AS n FROM r WHERE i > 0 GROUP BY 1, 2, 3""",
    "ema_success": A.with_roles("metrics") + """, o AS (SELECT layer, operation, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS x,
            row_number() OVER (PARTITION BY layer, operation ORDER BY ts DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY layer, operation) AS n FROM metrics)
        SELECT layer, operation, count(*) AS n, round(CAST(sum(x * power(0.9, i - 1) * CASE WHEN i = n THEN 1.0 ELSE 0.1 END) AS DOUBLE), 6) AS rate FROM o GROUP BY 1, 2""",
    "message_history": "SELECT conv_id, role, turn, length(text) AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS r FROM conversations) x WHERE r <= 3",
}
