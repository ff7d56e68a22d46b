"""Queries for functions of texts, names, replies and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..functions import text as X
from ..operators import integration as I
from ..operators import knowledge as N
from ..operators import parsers as P
from ..operators import reports as R
from ..operators import retrieval as Q
from ..operators import validation as V
from ..sources import adapters as A
from . import analysis

#: Snippets of code by the part of an order line; # stands for a number.
SNIPPETS = (
    "if (a > #) { run(a, 'x#'); } // note #", "for i in range(#):\n    password = get_user(i)  # sql #", 'query = "SELECT * FROM t# WHERE id=" + user_id', "try { eval(code#); } catch (e) { log(e); }",
    "def __load#(path):\n    return open('../' + path).read()", "while (x < #) { x = escape(x); }", "system('rm ' + name#)", "strcpy(buffer, input#); /* copy # */",
)
MODELS = (
    "gpt-4o", "text-embedding-3", "deepseek-chat", "moonshot-v1", "qwen-max", "baichuan2", "glm-4", "chatglm3", "mxbai-embed-large", "my-gpt4-x", "yi-34b", "claude-3", "llama3:8b", "mistral.gguf", "phi-2", "embedding-bert-1", "Meta-Llama", "gemma:2b",
)


def _code(spark, sf):
    """id, code: a snippet with numbers for every function."""
    f = A.functions(spark, sf)
    code = F.get(F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("part") % len(SNIPPETS)).cast("int"))
    return f.select(F.col("node").alias("id"), F.col("part"), F.replace(code, F.lit("#"), F.col("size").cast("string")).alias("code"))


def code_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Complexities, flags and guesses of pages and snippets."""
    c = _code(spark, sf).select("id", "code").unionByName(A.table(spark, sf, "pages").select((-F.col("page_id") - 1).alias("id"), F.col("html").alias("code")))
    code, flags = F.col("code"), X.security_flags(F.col("code"))
    return c.select(
        "id", F.round(X.complexity(code), 4).alias("complexity"), X.branch_complexity(code).cast("long").alias("branches"), R.unit_complexity(code, F.size(X.lines(code))).cast("long").alias("unit"),
        *[flags[k].cast("long").alias(k) for k in flags], X.inferred_type(code).alias("inferred"),
    )


def code_words(spark: SparkSession, sf: str) -> DataFrame:
    """Variables, keywords and patterns of snippets."""
    code = F.col("code")
    join = lambda a: F.array_join(F.array_sort(a), " ")
    return _code(spark, sf).select(
        "id", join(X.snippet_variables(code)).alias("variables"), join(X.snippet_keywords(code)).alias("keywords"), join(X.keywords(code)).alias("known"), join(X.code_patterns(code)).alias("patterns"),
        join(X.search_terms(F.lit("SQL injection"), code)).alias("terms"), F.size(X.mock_analysis(code)).alias("n_mock"),
    )


def normalised_code(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets without comments and literals in three languages, and as patterns."""
    lang = F.element_at(F.array(F.lit("python"), F.lit("javascript"), F.lit("sql")), (F.col("part") % 3 + 1).cast("int"))
    return _code(spark, sf).select("id", X.normal_code(F.col("code"), lang).alias("normal"), X.code_to_pattern(F.col("code")).alias("pattern"))


def code_similarities(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of each kind of snippet with each other, without its structure."""
    kinds = _code(spark, sf).select("code").distinct()
    known = spark.createDataFrame([(s,) for s in SNIPPETS], "other string")
    both = kinds.join(F.broadcast(known))  # eight fixed snippets
    s = X.code_similarity(F.col("code"), F.col("other"), F.lit("python"), F.lit(0.0))
    return both.groupBy("other").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.max(s), 6).alias("most"))


def model_providers(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as calls of models, by provider."""
    p = A.table(spark, sf, "part").select(F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("p_partkey") % len(MODELS)).cast("int")).alias("model"))
    return p.groupBy("model", X.provider_of(F.col("model")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of files made of pages' addresses, some too long."""
    p = A.table(spark, sf, "pages").select("page_id", F.concat(F.repeat("url", F.lit(1)), F.repeat(F.lit('a<b>|"?*:'), (F.col("page_id") % 40).cast("int")), F.when(F.col("page_id") % 2 == 0, ".html").otherwise("")).alias("name"))
    return p.select("page_id", X.safe_filename(F.col("name")).alias("name"))


def fenced_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of code in turns of conversations."""
    c = A.table(spark, sf, "conversations").filter("text is not null")
    t = c.select("conv_id", "turn", F.concat(F.lit("see\n```py\n"), "text", F.lit("```\nand\n```\nx = 1\n``` end")).alias("t"))
    b = t.select("conv_id", "turn", F.posexplode(X.fenced_code(F.col("t"))).alias("pos", "b"))
    return b.select("conv_id", "turn", "pos", F.col("b.language").alias("language"), F.md5(F.col("b.code")).alias("digest"))


def name_visibility(spark: SparkSession, sf: str) -> DataFrame:
    """Names by their underscores, and languages by paths and contents."""
    p, k = A.table(spark, sf, "part"), F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat(F.lit("__"), "p_name", F.lit("__"))).when(k == 1, F.concat(F.lit("__"), "p_name")).when(k == 2, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name"))
    path = F.when(k == 0, "a/b.PY").when(k == 1, "x.java").otherwise("README")
    code = F.when(k == 2, "<?php echo").when(k == 3, "def go(x):").when(k == 4, "public class A {}").otherwise("(a) => a")
    return p.groupBy(X.visibility(name).alias("visibility"), X.guessed_language(path, code).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def model_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as replies of models: JSON, words, numbers."""
    k = F.col("event_id") % 5
    n = F.round("value", 1).cast("string")
    reply = (
        F.when(k == 0, F.concat(F.lit('Sure: {"is_valid": '), (F.col("value") > 50).cast("string"), F.lit(', "confidence": 0.7} ok'))).when(k == 1, F.concat(F.lit("Confirmed, "), n, F.lit(" %")))
        .when(k == 2, F.lit("a false positive, 0.9")).when(k == 3, F.lit("not sure")).otherwise(F.lit("it is VALID"))
    )
    e = A.table(spark, sf, "events").withColumn("v", N.model_verdict(reply))
    return e.select("event_id", F.col("v.valid").alias("valid"), F.round("v.confidence", 6).alias("confidence"))


def _replies(spark, sf):
    """id, reply: order lines as the lines of a model's reply."""
    l, k = A.functions(spark, sf), F.col("part") % 4
    line = (
        F.when(k == 0, F.concat(F.col("pos").cast("string"), F.lit(". High issue of part "), F.col("part").cast("string"))).when(k == 1, F.concat(F.lit("- critical SQL injection at "), F.col("part").cast("string")))
        .when(k == 2, F.lit("  more about it  ")).otherwise(F.concat(F.lit("an error in line "), F.col("size").cast("string")))
    )
    g = l.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return g.select(F.col("module").alias("id"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("reply"))


def reply_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered and bulleted issues of replies."""
    return N.reply_issues(_replies(spark, sf))


def keyword_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues that begin with a word for one."""
    return N.keyword_issues(_replies(spark, sf))


def named_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of issue that replies name, with the text behind."""
    r = _replies(spark, sf).select("id", F.explode(X.named_issues(F.col("reply"))).alias("i"))
    return r.select("id", F.col("i.type").alias("type"), F.col("i.description").alias("description"))


def reply_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Properties and code of replies in four forms."""
    p, k = A.table(spark, sf, "part"), F.col("p_partkey") % 4
    reply = (
        F.when(k == 0, F.concat(F.lit("finding\n- severity: high\n- location: line "), F.col("p_size").cast("string"), F.lit("\n```py\nrun(x) = 1;\n```"))).when(k == 1, F.concat(F.lit('{"severity": "low", "location": "'), F.col("p_size").cast("string"), F.lit('"}')))
        .when(k == 2, F.concat(F.lit("Severity: 'medium'\nuse `call(a, b + c)` here"))).otherwise(F.concat(F.lit("severity = "), F.repeat("p_name", F.lit(12)), F.lit(" <code>x</code>")))
    )
    return p.select("p_partkey", X.text_property(reply, "severity").alias("severity"), X.text_property(reply, "location").alias("location"), X.text_snippet(reply).alias("snippet"))


def reply_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies that replies list, an order line an entry."""
    f = A.functions(spark, sf)
    entry = F.concat(F.lit("- target: f"), (F.col("part") % 5).cast("string"), F.when(F.col("part") % 2 == 0, "\n  type: call").otherwise(""), F.lit("\n  location: line "), F.col("size").cast("string"))
    g = f.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("l"))
    return N.reply_dependencies(g.select(F.col("module").alias("id"), F.concat(F.lit("found:\n"), F.array_join(F.transform("l", lambda x: x["e"]), "\n")).alias("reply")))


def retry_delays(spark: SparkSession, sf: str) -> DataFrame:
    """Delays before retries under four strategies, for every attempt that occurs."""
    a = A.functions(spark, sf).select((F.col("pos") - 1).alias("attempt")).distinct()
    return a.select("attempt", *[F.round(S.backoff(F.col("attempt"), 0.5, 30.0, s), 4).alias(s) for s in ("fixed", "linear", "exponential", "fibonacci")])


def score_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of contexts, windows, knowledge and paths over all functions."""
    f = A.functions(spark, sf)
    a, b, c, x = (F.col("part") % m for m in (6, 9, 4, 11))
    kinds = F.transform(F.sequence(F.lit(1), c.cast("int") + 1), lambda i: F.when(i % 3 == 0, "return").when(i % 3 == 1, "direct").otherwise("parameter"))
    risk, level = N.path_risk(a + 2, kinds, F.when(x > 8, 1).otherwise(0), F.when(x > 5, "high").otherwise("low"))
    empty = F.lit(None).cast("double")
    return f.select(
        "node", F.round(V.window_completeness(a, b, x / 11), 6).alias("windows"), F.round(I.context_score(F.when(a > 0, a.cast("double")).otherwise(empty), F.when(c > 0, c.cast("double")).otherwise(empty), b.cast("double"), empty), 6).alias("context"),
        F.round(V.context_completeness(a, c, a, c, b, a, x, c, x > 5, x / 11), 6).alias("complete"), F.round(V.knowledge_relevance(a, F.least(a, c), b, F.least(b, c), c, x / 11, x / 11, x / 22), 6).alias("relevance"),
        F.round(risk, 6).alias("risk"), level.alias("level"), V.validation_status(x / 11, a > 0).alias("status"),
    )


def indexed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of documents that an index of every third one doesn't have; equal chunks have equal vectors."""
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), F.coalesce("text", F.lit("")).alias("text"))
    c = Q.indexed(d, d.filter("unit % 3 = 0").select("unit"), 8)
    dot = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return c.select("chunk_id", "unit", F.col("pos").cast("long").alias("pos"), F.col("size").cast("long").alias("size"), F.round(dot, 4).alias("norm"))


def paired_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as findings with their customer as context and their lines as knowledge."""
    o = A.table(spark, sf, "orders")
    f = o.select(F.col("o_orderkey").alias("id"), "o_custkey")
    context = o.filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("context"))
    knowledge = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n_known"))
    return Q.paired(f, context, knowledge)


def variable_states(spark: SparkSession, sf: str) -> DataFrame:
    """Variables of all Python files with taint, what they depend on, and aliases."""
    v = P.variable_states(A.code_files(spark, sf))
    return v.select("path", "scope", "name", "line", "taint", "kind", F.array_join("dependencies", ",").alias("dependencies"), "alias")


def flat_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """Brands with the first of their parts as CVE and all references."""
    p = A.table(spark, sf, "part")
    c = F.struct(F.concat(F.lit("CVE-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("cve_id"), F.when(F.col("p_size") > 20, "high").otherwise("low").alias("severity"), F.array(F.concat(F.lit("u"), (F.col("p_size") % 7).cast("string"))).alias("references"))
    k = p.groupBy(F.col("p_brand").alias("id")).agg(F.array_sort(F.collect_list(c)).alias("cves"))
    return I.flat_knowledge(k).select("id", "cve_id", "severity", F.array_join("references", ",").alias("references"))


def latest_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Of functions of one file and name the last one."""
    u = A.functions(spark, sf).select(F.concat(F.lit("p"), (F.col("part") % 97).cast("string")).alias("path"), F.col("size").cast("string").alias("name"), "node")
    return I.entities(u, "node").select("entity", "node")


def ab_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """One row over comparisons of order priorities between two groups of orders."""
    o = A.table(spark, sf, "orders")
    g = lambda i: F.avg(F.when(F.col("o_orderkey") % 2 == i, F.col("o_totalprice")))
    c = o.groupBy("o_orderpriority").agg(F.round(g(0), 4).alias("control_mean"), F.round(g(1), 4).alias("treatment_mean"))
    return I.ab_summary(c.withColumn("significant", F.abs(F.col("control_mean") - F.col("treatment_mean")) > 100))


def validated_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings by the outcome of validation: the rules, then consensus of models, then confidence."""
    f, v = _validation(spark, sf)
    out = I.validated(f, v)
    return out.groupBy("status", "false_positive", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 5).alias("mean_confidence"))


def validation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by status and mean confidence of all validated findings."""
    return I.validation_summary(I.validated(*_validation(spark, sf)))


def _validation(spark, sf):
    f = analysis._findings(spark, sf)
    v = A.verdicts(spark, sf)
    first = f.groupBy("batch").agg(F.min("id").alias("id"))
    v = v.join(first, F.col("finding_id") == F.col("batch")).select(F.col("id").alias("finding_id"), "confidence", "is_valid", "weight")
    return f.select("id", "type", "file_path", "snippet", "severity"), v


_ALL = (
    code_measures, code_words, normalised_code, code_similarities, model_providers, safe_names, fenced_blocks, name_visibility, model_verdicts, reply_issues, keyword_issues, named_issues, reply_properties,
    reply_dependencies, retry_delays, score_functions, indexed_chunks, paired_findings, variable_states, flat_knowledge, latest_entities, ab_summaries, validated_findings, validation_summary,
)
QUERIES = {f.__name__: f for f in _ALL}

_W = A.with_roles
_ID = X.IDENTIFIER
_QUOTED = [s.replace("'", "''") for s in SNIPPETS]
_SNIPPET = "CASE part % 8 " + " ".join(f"WHEN {i} THEN replace('{s}', '#', CAST(size AS VARCHAR))" for i, s in enumerate(_QUOTED)) + " END"
_SNIPPET = _SNIPPET.replace("\n", "' || chr(10) || '")
_CODE = _W("functions") + f", c AS (SELECT node AS id, part, {_SNIPPET} AS code FROM functions)"


def _words(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + w.replace("'", "''") + "')" for w in words) + ")"


_FLAGS = {
    "n_conditions": _n("lower(code)", r"\b(if|elif|else|switch|case)\b"), "n_loops": _n("lower(code)", r"\b(for|while)\b"), "n_returns": _n("lower(code)", r"\breturn\b"),
    **{k: f"CAST(regexp_matches(lower(code), '{p}') AS BIGINT)" for k, p in (
        ("has_try", r"\btry\b"), ("has_catch", r"\b(except|catch)\b"), ("has_finally", r"\bfinally\b"), ("validates", "validate|check|verify"), ("escapes", "escape|encode|quote"),
        ("authenticates", "auth|login|permission"), ("encrypts", "encrypt|hash|crypt"), ("sanitizes", "sanitize|clean|filter"), ("logs", "log|audit"),
    )},
}
_SEARCHED = list(rules.CODE_TOKENS)
_PATTERNS = """list_distinct(list_concat(list_concat(list_transform(regexp_extract_all({0}, '\\w+\\s*\\('), lambda x: rtrim(x)), list_transform(regexp_extract_all({0}, '\\w+\\s*='), lambda x: rtrim(x))),
    list_concat(regexp_extract_all({0}, 'if\\s*\\(.*?\\)'), regexp_extract_all({0}, '(for|while)\\s*\\(.*?\\)', 1))))"""
_TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_KNOWN = dict.fromkeys((*rules.PROGRAMMING_WORDS, *rules.SECURITY_WORDS))


def _normal(code: str, bare: str) -> str:
    """Spaces collapsed and literals blanked, of code whose comments are gone."""
    return f"""regexp_replace(regexp_replace(trim(regexp_replace({bare.format(code)}, '\\s+', ' ', 'g')), '["''].*?["'']', '""', 'g'), '\\b\\d+\\b', '0', 'g')"""


_HASHES = "regexp_replace({0}, '(?m)#.*$', '', 'g')"
_SLASHES = "regexp_replace(regexp_replace({0}, '(?m)//.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')"
_DASHES = "regexp_replace(regexp_replace({0}, '(?m)--.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')"
_PIECE = f"""CASE WHEN t[1] = '"' THEN '".*?"' WHEN t[1] = '''' THEN '''.*?''' WHEN regexp_full_match(t, '\\d+') THEN '\\d+'
    WHEN regexp_full_match(t, '\\w+') THEN CASE WHEN list_contains({_words(X.KEEP_IN_PATTERN)}, lower(t)) OR regexp_full_match(t, '[A-Z_]+') THEN t ELSE '\\w+' END
    WHEN contains('()[]{{}}+*?^$|.', t) THEN '\\' || t ELSE t END"""
_PATTERN = f"""list_aggregate(list_transform(regexp_extract_all(code, '"[^"]*"|''[^'']*''|\\w+|\\s|[^\\w\\s]'), lambda t: {_PIECE}), 'string_agg', '')"""


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) * 1.0 / len(list_distinct(list_concat({a}, {b}))) END"


_SETS = f"{_TOKENS.format('n')} AS t, list_intersect({_TOKENS.format('n')}, {_words(_KNOWN)}) AS k, {_PATTERNS.format('n')} AS p"
_LINE = """CASE part % 4 WHEN 0 THEN pos || '. High issue of part ' || part WHEN 1 THEN '- critical SQL injection at ' || part WHEN 2 THEN 'more about it' ELSE 'an error in line ' || size END"""


def _issues(head: str) -> str:
    return f"""{_W("functions")}, l AS (SELECT module AS id, pos, {_LINE} AS line, sum(CASE WHEN part % 4 IN ({head}) THEN 1 ELSE 0 END) OVER (PARTITION BY module ORDER BY pos) AS n FROM functions),
        g AS (SELECT id, CAST(n AS BIGINT) AS n, string_agg(line, ' ' ORDER BY pos) AS text FROM l WHERE n > 0 GROUP BY 1, 2)"""


_SCORE = """x AS (SELECT node, part % 6 AS a, part % 9 AS b, part % 4 AS c, part % 11 AS x, CAST(part % 11 AS DOUBLE) / 11 AS r FROM functions),
    k AS (SELECT *, CASE WHEN x > 8 THEN 1 ELSE 0 END AS clean, 0.1 + CASE WHEN c >= 1 THEN 0.15 ELSE 0 END + CASE WHEN c >= 2 THEN 0.12 ELSE 0 END + CASE WHEN c >= 3 THEN 0.1 ELSE 0 END AS steps FROM x),
    p AS (SELECT *, (0.5 + least(1.0, (a + 2) / 10.0) * 0.2 + steps) * CASE WHEN clean > 0 THEN 0.8 ELSE 1.0 END + CASE WHEN x > 5 THEN 0.2 ELSE 0.0 END AS base FROM k),
    q AS (SELECT *, CASE WHEN a > 0 THEN least(1.0, a / 5.0) + least(0.2, c / 10.0) ELSE 0 END + CASE WHEN a > 0 THEN 0.4 ELSE 0 END + CASE WHEN c > 0 THEN 0.4 ELSE 0 END + CASE WHEN b > 0 THEN 0.2 ELSE 0 END
            + least(0.4, a / 5.0) + least(0.4, a / 10.0) + CASE WHEN x > 0 THEN 0.2 ELSE 0 END + least(0.5, c / 3.0) + CASE WHEN x > 5 THEN 0.3 ELSE 0 END + r * 0.2 AS whole,
        CASE WHEN a > 0 THEN least(1.0, least(1.0, a / 3.0) + least(0.3, least(a, c) / CAST(greatest(1, a) AS DOUBLE))) * 0.4 ELSE 0 END
            + CASE WHEN b > 0 THEN least(1.0, least(1.0, b / 2.0) + least(b, c) / CAST(b AS DOUBLE) * 0.2) * 0.3 ELSE 0 END + CASE WHEN c > 0 THEN r * 0.3 ELSE 0 END AS known FROM p)"""

SQL = {
    "code_measures": f"""{_CODE}, d AS (SELECT id, code FROM c UNION ALL SELECT -page_id - 1, html FROM pages),
        k AS (SELECT id, code, regexp_replace(code, '[^{{}}()\\[\\]]', '', 'g') AS marks FROM d),
        b AS (SELECT marks, unnest(string_split(marks, '')) AS c, generate_subscripts(string_split(marks, ''), 1) AS i FROM (SELECT DISTINCT marks FROM k) x),
        s AS (SELECT marks, i, sum(CASE WHEN c IN ('{{', '(', '[') THEN 1 WHEN c IN ('}}', ')', ']') THEN -1 ELSE 0 END) OVER (PARTITION BY marks ORDER BY i) AS p FROM b),
        m AS (SELECT marks, max(q) AS depth FROM (SELECT marks, p - least(0, min(p) OVER (PARTITION BY marks ORDER BY i)) AS q FROM s) y GROUP BY marks),
        z AS (SELECT d.id, code, len(string_split(code, chr(10))) AS n_lines, coalesce(depth, 0) AS depth FROM k AS d LEFT JOIN m ON m.marks = d.marks)
        SELECT id, round(least(10.0, CAST(n_lines * 0.1 + {_n("code", "(?i)\\b(if|for|while|switch|try)\\b")} * 0.5 + {_n("code", "\\w+\\s*\\(")} * 0.2 + depth * 0.3 AS DOUBLE)), 4) AS complexity,
            1 + {_n("code", "\\b(if|while|for|switch)\\b")} + {_n("code", "\\bcatch\\b")} + {_n("code", "\\?\\s*.*\\s*:")} AS branches,
            greatest(1, n_lines + 2 * {_n("code", "\\b(if|else|elif|for|while|try|except|catch|switch|case)\\b")} + {_n("code", "\\w+\\(")}) AS unit, {", ".join(f"{v} AS {k}" for k, v in _FLAGS.items())},
            CASE WHEN {_any("lower(code)", ("sql", "query", "select", "insert", "update", "delete"))} THEN 'sql injection' WHEN {_any("lower(code)", ("<script>", "javascript:", "onerror", "onload"))} THEN 'xss'
                WHEN {_any("lower(code)", ("system", "exec", "shell", "command"))} THEN 'command injection' WHEN {_any("lower(code)", ("../", "..\\", "path", "file"))} THEN 'path traversal'
                WHEN {_any("lower(code)", ("buffer", "overflow", "strcpy", "strcat"))} THEN 'buffer overflow' ELSE 'general' END AS inferred FROM z""",
    "code_words": f"""{_CODE} SELECT id,
        array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(code, '{_ID}'), lambda w: length(w) > 1 AND NOT list_contains({_words(X.PYTHON_WORDS)}, w)))), ' ') AS variables,
        array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(code), '{_ID}'), list_concat(regexp_extract_all(lower(array_to_string(regexp_extract_all(code, '["'']([^"'']*)["'']', 1), ' ')), '[a-zA-Z]+'),
            regexp_extract_all(lower(array_to_string(regexp_extract_all(code, '#\\s*(.+)', 1), ' ')), '[a-zA-Z]+'))))), ' ') AS keywords,
        array_to_string(list_sort(list_intersect({_TOKENS.format("code")}, {_words(_KNOWN)})), ' ') AS known, array_to_string(list_sort({_PATTERNS.format("code")}), ' ') AS patterns,
        array_to_string(list_sort(list_distinct(list_concat(['sql', 'injection', 'database'], list_filter({_words(_SEARCHED)}, lambda w: contains(lower(code), w))))), ' ') AS terms,
        CAST(CASE WHEN {_any("lower(code)", ("eval(", "exec("))} THEN 1 ELSE 0 END + CASE WHEN contains(lower(code), 'password') AND {_any("lower(code)", ("=", ":"))} THEN 1 ELSE 0 END AS INTEGER) AS n_mock FROM c""",
    "normalised_code": f"""{_CODE} SELECT id, CASE part % 3 WHEN 0 THEN {_normal("code", _HASHES)} WHEN 1 THEN {_normal("code", _SLASHES)} ELSE {_normal("code", _DASHES)} END AS normal,
        CASE WHEN length({_PATTERN}) > 200 THEN substr({_PATTERN}, 1, 200) || '.*' ELSE {_PATTERN} END AS pattern FROM c""",
    "code_similarities": f"""{_CODE}, a AS (SELECT code, {_SETS} FROM (SELECT DISTINCT code, {_normal("code", _HASHES)} AS n FROM c) x),
        b AS (SELECT other, {_SETS} FROM (SELECT other, {_normal("other", _HASHES)} AS n FROM (VALUES {", ".join("('" + s.replace(chr(10), "' || chr(10) || '") + "')" for s in _QUOTED)}) v(other)) x),
        s AS (SELECT other, CAST(0.3 * {_jaccard("a.t", "b.t")} + 0.25 * {_jaccard("a.k", "b.k")} + 0.2 * {_jaccard("a.p", "b.p")} AS DOUBLE) AS s FROM a, b) SELECT other, count(*) AS n, round(avg(s), 6) AS mean, round(max(s), 6) AS most FROM s GROUP BY 1""",
    "model_providers": f"""WITH m AS (SELECT {_words(MODELS)}[p_partkey % {len(MODELS)} + 1] AS model FROM part), l AS (SELECT *, lower(model) AS m FROM m)
        SELECT model, CASE WHEN starts_with(m, 'gpt-') OR starts_with(m, 'text-embedding-') THEN 'openai' WHEN starts_with(m, 'deepseek-') THEN 'deepseek' WHEN starts_with(m, 'moonshot-') THEN 'moonshot' WHEN starts_with(m, 'qwen-') THEN 'qwen'
            WHEN starts_with(m, 'baichuan') THEN 'baichuan' WHEN starts_with(m, 'glm-') OR starts_with(m, 'chatglm') THEN 'zhipu' WHEN starts_with(m, 'mxbai-embed') THEN 'ollama_emd' WHEN contains(m, 'gpt4') OR contains(m, 'gpt3') THEN 'openai'
            WHEN contains(m, 'embedding-bert') THEN 'deepseek' WHEN contains(m, 'yi-') THEN '01ai' WHEN contains(m, 'claude') THEN 'anthropic' WHEN contains(m, 'llama') THEN 'meta' WHEN contains(m, 'mxbai') THEN 'ollama_emd'
            WHEN (contains(m, 'mistral') OR contains(m, 'qwen') OR contains(m, 'gemma')) AND (contains(m, ':') OR ends_with(m, '.bin') OR ends_with(m, '.gguf')) THEN 'ollama' ELSE 'openai' END AS provider, count(*) AS n FROM l GROUP BY 1, 2""",
    "safe_names": """WITH n AS (SELECT page_id, regexp_replace(url || repeat('a<b>|"?*:', CAST(page_id % 40 AS BIGINT)) || CASE WHEN page_id % 2 = 0 THEN '.html' ELSE '' END, '[\\\\/*?:"<>|]', '_', 'g') AS n FROM pages)
        SELECT page_id, CASE WHEN length(n) <= 200 THEN n WHEN contains(n, '.') THEN substr(regexp_replace(n, '\\.[^.]*$', ''), 1, 190) || '.' || regexp_extract(n, '([^.]*)$', 1) ELSE substr(n, 1, 200) END AS name FROM n""",
    "fenced_blocks": """SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'py' ELSE 'text' END AS language, md5(CASE pos WHEN 0 THEN text ELSE 'x = 1' || chr(10) END) AS digest
        FROM conversations, (VALUES (0), (1)) p(pos) WHERE text IS NOT NULL""",
    "name_visibility": """WITH p AS (SELECT p_partkey % 6 AS k FROM part) SELECT CASE k WHEN 0 THEN 'special' WHEN 1 THEN 'private' WHEN 2 THEN 'protected' ELSE 'public' END AS visibility,
        CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'php' WHEN 3 THEN 'python' WHEN 4 THEN 'java' ELSE 'javascript' END AS language, count(*) AS n FROM p GROUP BY 1, 2""",
    "model_verdicts": """WITH e AS (SELECT event_id, event_id % 5 AS k, value, round(value, 1) AS r FROM events) SELECT event_id, CASE k WHEN 0 THEN value > 50 WHEN 1 THEN true WHEN 4 THEN true ELSE false END AS valid,
        round(CAST(CASE k WHEN 0 THEN 0.7 WHEN 1 THEN CASE WHEN r > 1 THEN least(1.0, r / 100) ELSE r END WHEN 2 THEN 0.9 ELSE 0.5 END AS DOUBLE), 6) AS confidence FROM e""",
    "reply_issues": _issues("0, 1") + " SELECT id, n, CASE WHEN contains(lower(text), 'critical') THEN 'critical' WHEN contains(lower(text), 'high') THEN 'high' ELSE 'medium' END AS severity, substr(text, 1, 100) AS text FROM g",
    "keyword_issues": _issues("0, 3") + " SELECT id, n, text FROM g",
    "named_issues": f"""{_W("functions")}, r AS (SELECT module AS id, string_agg(CASE part % 4 WHEN 2 THEN '  more about it  ' ELSE {_LINE} END, chr(10) ORDER BY pos) AS reply FROM functions GROUP BY 1)
        SELECT id, 'sql injection' AS type, substr(reply, instr(reply, 'SQL injection'), 213) AS description FROM r WHERE contains(reply, 'SQL injection')""",
    "reply_properties": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE CASE WHEN length(repeat(p_name, 12) || ' <code>x</code>') <= 100 THEN repeat(p_name, 12) || ' <code>x</code>' END END AS severity,
        CASE p_partkey % 4 WHEN 0 THEN 'line ' || p_size || chr(10) || '```py' || chr(10) || 'run(x) = 1;' || chr(10) || '```' WHEN 1 THEN CAST(p_size AS VARCHAR) END AS location,
        CASE p_partkey % 4 WHEN 0 THEN 'run(x) = 1;' WHEN 2 THEN 'call(a, b + c)' END AS snippet FROM part""",
    "reply_dependencies": f"""{_W("functions")} SELECT module AS id, 'f' || (part % 5) AS target, CASE part % 2 WHEN 0 THEN 'call' ELSE 'unknown' END AS kind, CAST(min(size) AS INTEGER) AS line FROM functions GROUP BY 1, 2, 3""",
    "retry_delays": f"""{_W("functions")}, a AS (SELECT DISTINCT pos - 1 AS attempt FROM functions) SELECT attempt, CAST(0.5 AS DOUBLE) AS fixed, round(least(30.0, CAST(0.5 * (attempt + 1) AS DOUBLE)), 4) AS linear,
        round(least(30.0, 0.5 * power(2.0, attempt)), 4) AS exponential, round(least(30.0, 0.5 * round((power((1 + sqrt(5.0)) / 2, attempt + 1) - power((1 - sqrt(5.0)) / 2, attempt + 1)) / sqrt(5.0))), 4) AS fibonacci FROM a""",
    "score_functions": f"""{_W("functions")}, {_SCORE} SELECT node, round(CAST(least(1.0, 0.3 + least(0.4, a * 0.05) + least(0.2, b * 0.02) + r * 0.1) AS DOUBLE), 6) AS windows,
        round(CAST((CASE WHEN a > 0 THEN least(1.0, a / CAST(5 AS DOUBLE)) ELSE 0 END + CASE WHEN c > 0 THEN least(1.0, c / CAST(3 AS DOUBLE)) ELSE 0 END + least(1.0, b / CAST(10 AS DOUBLE))) / (1 + (a > 0)::INT + (c > 0)::INT) AS DOUBLE), 6) AS context,
        round(CAST(least(1.0, whole * 0.25) AS DOUBLE), 6) AS complete, round(CAST(least(1.0, known * 0.8 + (r * 0.7 + CAST(x AS DOUBLE) / 22 * 0.3) * 0.2) AS DOUBLE), 6) AS relevance, round(CAST(least(1.0, base) AS DOUBLE), 6) AS risk,
        CASE WHEN round(base, 9) >= 0.8 THEN 'dangerous' WHEN round(base, 9) >= 0.6 THEN 'tainted' WHEN clean > 0 THEN 'sanitized' ELSE 'safe' END AS level,
        CASE WHEN a > 0 AND r >= 0.8 THEN 'validated' WHEN r >= 0.5 THEN 'needs_review' ELSE 'rejected' END AS status FROM q""",
    "indexed_chunks": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 3 <> 0), c AS (SELECT doc_id, text, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 1000) / 800.0) AS BIGINT)))) AS pos FROM d WHERE length(text) > 0)
        SELECT doc_id || '#' || pos AS chunk_id, doc_id AS unit, pos, length(substr(text, pos * 800 + 1, 1000)) AS size, CAST(1 AS DOUBLE) AS norm FROM c""",
    "paired_findings": """SELECT o_orderkey AS id, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS context, n AS n_known FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""",
    "variable_states": _W("functions", "code") + """ SELECT path, name AS scope, CASE kind WHEN 0 THEN 'q' WHEN 4 THEN 'y' ELSE 'val' END AS name, CAST(line + 1 AS INTEGER) AS line, CASE kind WHEN 2 THEN 'sanitized' WHEN 6 THEN 'tainted' ELSE 'safe' END AS taint,
        CAST(NULL AS VARCHAR) AS kind, CASE kind WHEN 0 THEN 'request' WHEN 2 THEN 'escape,val' WHEN 3 THEN 'eval,val' WHEN 4 THEN 'i' WHEN 6 THEN 'open,val' WHEN 7 THEN 'check_token,val' ELSE 'drop,val' END AS dependencies, CASE kind WHEN 4 THEN 'i' END AS alias
        FROM code WHERE lang = 'python' AND kind NOT IN (1, 5)""",
    "flat_knowledge": """WITH r AS (SELECT p_brand, string_agg(DISTINCT 'u' || (p_size % 7), ',' ORDER BY 'u' || (p_size % 7)) AS r FROM part GROUP BY 1), f AS (SELECT p_brand, min(p_partkey) AS k, arg_min(p_size, p_partkey) AS s FROM part GROUP BY 1)
        SELECT p_brand AS id, 'CVE-' || lpad(CAST(k AS VARCHAR), 7, '0') AS cve_id, CASE WHEN s > 20 THEN 'high' ELSE 'low' END AS severity, r AS "references" FROM f JOIN r USING (p_brand)""",
    "latest_entities": _W("functions") + " SELECT 'p' || (part % 97) || '::' || size AS entity, max(node) AS node FROM functions GROUP BY 1",
    "ab_summaries": """WITH c AS (SELECT round(avg(o_totalprice) FILTER (o_orderkey % 2 = 0), 4) AS c, round(avg(o_totalprice) FILTER (o_orderkey % 2 = 1), 4) AS t FROM orders GROUP BY o_orderpriority)
        SELECT count(*) AS n, count(*) FILTER (abs(c - t) > 100 AND t > c) AS improved, count(*) FILTER (abs(c - t) > 100 AND t < c) AS worsened, round(100 * (avg(c) - avg(t)) / avg(c), 6) AS gain_percent FROM c""",
}
