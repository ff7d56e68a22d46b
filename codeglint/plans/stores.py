"""Queries over sources and sinks: trees of files, manifests, feeds, runs, reports, graphs, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import postings as P
from ..sources import adapters as A
from ..sources import feeds, files, sinks
from ..storage import new_path


def source_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by folder of a tree that holds all documents, a folder a language; one folder is ignored, one is hidden."""
    path = new_path(spark, "tree")
    d = A.table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("none")).alias("lang"))
    d.write.partitionBy("lang").text(path)
    d.filter("lang = 'en'").select("text").write.text(f"{path}/lang=de/.hidden")
    found = files.scan(spark, path, ignored_directories=["lang=F*"], ignored_extensions=[".crc"], max_size=1 << 31)
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return found.groupBy(F.split("relative_path", "/")[0].alias("folder"), "extension", "language").agg(F.sum(lines).cast("long").alias("n_lines"))


def project_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files of their customer's project: the hash of each project."""
    o = A.table(spark, sf, "orders")
    f = o.select("o_custkey", F.format_string("src/m%d.py", "o_orderkey").alias("relative_path"), F.col("o_orderdate").cast("timestamp").alias("modified_time"))
    return files.project_hash(f, "o_custkey")


def _manifests(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.concat(F.lit("lib"), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("v"))
    k = F.col("k")
    line = F.when(k % 4 == 0, F.concat("name", F.lit("=="), "v")).when(k % 4 == 1, F.concat("name", F.lit(" >= "), "v")).when(k % 4 == 2, F.col("name")).otherwise(F.concat(F.lit("# "), "name"))
    tag = F.concat(F.lit("<dependency><groupId>org."), "brand", F.lit("</groupId><artifactId>"), "name", F.lit("</artifactId>"), F.when(k % 2 == 0, F.concat(F.lit("<version>"), "v", F.lit("</version>"))).otherwise(F.lit("")), F.lit("</dependency>"))
    pair = lambda odd: F.map_from_entries(F.array_sort(F.collect_list(F.when(k % 2 == odd, F.struct("name", "v")))))
    g = p.groupBy("brand").agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("requirements.txt"), F.concat(F.lit("<project>"), F.array_join(F.collect_list(tag), ""), F.lit("</project>")).alias("pom.xml"),
        F.to_json(F.struct(pair(0).alias("dependencies"), pair(1).alias("devDependencies"))).alias("package.json"), F.lit("x").alias("README.md"),
    )
    names = ("requirements.txt", "pom.xml", "package.json", "README.md")
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("content")) for n in names])
    return g.select("brand", F.explode(rows).alias("f")).select(F.concat_ws("/", "brand", "f.name").alias("relative_path"), "f.*")


def dependency_manifests(spark: SparkSession, sf: str) -> DataFrame:
    return files.manifests(_manifests(spark, sf)).select("relative_path", "ecosystem")


def listed_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return files.dependencies(_manifests(spark, sf))


def nvd_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as the CVEs of stored responses, one a brand."""
    p, k = A.table(spark, sf, "part"), F.col("p_partkey")
    text = lambda lang, value: F.struct(F.lit(lang).alias("lang"), value.alias("value"))
    metric = F.array(F.struct(F.struct((F.col("p_size") / 5.0).alias("baseScore"), F.when(F.col("p_size") > 40, "HIGH").alias("baseSeverity")).alias("cvssData")))
    cve = F.struct(
        F.concat(F.lit("CVE-2024-"), k.cast("string")).alias("id"), F.array(text("de", F.lit("nein")), text("en", F.col("p_name"))).alias("descriptions"), F.lit("2024-01-02T03:04:05.000").alias("published"),
        F.struct(F.when(k % 3 == 0, metric).alias("cvssMetricV31"), F.when(k % 3 == 1, metric).alias("cvssMetricV2")).alias("metrics"), F.array(F.struct(F.lit("http://a").alias("url")), F.struct(F.lit("").alias("url"))).alias("references"),
        F.array(F.struct(F.array(text("en", F.concat(F.lit("CWE-"), (k % 9).cast("string"))), text("en", F.lit("NVD-noinfo"))).alias("description"))).alias("weaknesses"),
        F.array(F.struct(F.array(F.struct(F.array(F.struct(F.concat(F.lit("cpe:2.3:a:"), "p_brand", F.lit(":"), "p_type", F.lit(":1")).alias("criteria"))).alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    )
    bodies = p.groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(F.struct(cve.alias("cve"))).alias("vulnerabilities"))).alias("body"))
    c = feeds.nvd_cves(bodies)
    return c.select("cve_id", "description", "severity", F.round("cvss_score", 4).alias("cvss_score"), F.date_format("published", "yyyy-MM-dd").alias("day"), F.size("references").alias("n_references"), F.array_join("products", ",").alias("products"), F.array_join("cwe_ids", ",").alias("cwe_ids"))


def _list_pages(spark, sf):
    o = A.table(spark, sf, "orders")
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit("</td>"))
    key = F.col("o_orderkey").cast("string")
    row = F.concat(
        F.lit("<tr class='r'>"), cell(F.concat(F.lit('<a href="/d/'), key, F.lit('">CVE-'), key, F.lit("</a>"))), cell(F.concat(F.lit("order <b>of</b>  "), F.col("o_custkey").cast("string"))),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(cell(F.lit("CWE-79"))), cell(F.date_format("o_orderdate", "yyyy-MM-dd")), cell(F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise((F.col("o_orderkey") % 120 / 10).cast("string"))), F.lit("</tr>"),
    )
    return o.groupBy("o_orderpriority").agg(F.concat(F.lit("<table><tr><th>id</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))


def cve_list(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of list pages with scores and bands; rows of four cells are left out."""
    return feeds.scored(feeds.list_rows(_list_pages(spark, sf))).select("cve_id", "title", "cwe_type", "disclosed", "cvss_score", "severity", "detail_url")


def cve_list_since(spark: SparkSession, sf: str) -> DataFrame:
    """Those disclosed since a date, the known ones left out."""
    new = feeds.since(feeds.list_rows(_list_pages(spark, sf)), "2000-01-01")
    known = A.table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("CVE-"), F.col("o_orderkey").cast("string")).alias("cve_id"))
    return new.join(known, "cve_id", "left_anti").select("cve_id", "disclosed")


def cve_details(spark: SparkSession, sf: str) -> DataFrame:
    """Text, identifiers and links of pages."""
    p = A.table(spark, sf, "pages").withColumn("html", F.concat("html", F.lit("<p>CWE-79 CWE-89 CWE-79 CVSS:3.1/AV:N/AC:L <a href='https://x.org/1'>x</a></p>")))
    d = feeds.detail_fields(p)
    return d.select("page_id", F.length("description").cast("long").alias("size"), F.md5("description").alias("digest"), "cvss_vector", F.array_join("cwe_ids", ",").alias("cwe_ids"), F.size("links").alias("n_links"))


def _cves(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("CVE-"), F.col("p_partkey").cast("string")).alias("cve_id"), F.repeat(F.concat("p_name", F.lit(" ")), (F.col("p_size") % 20 + 1).cast("int")).alias("description"),
        F.when(F.col("p_size") > 25, "HIGH").otherwise("LOW").alias("severity"), F.round(F.col("p_size") / 5.0, 4).alias("cvss_score"), "p_brand",
    )


def stored_cves(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred stored CVEs that have a keyword."""
    path = new_path(spark, "cves")
    c = _cves(spark, sf)
    c.groupBy("p_brand").agg(F.collect_list(F.struct("cve_id", "description", "severity", "cvss_score")).alias("cves")).write.partitionBy("p_brand").json(path)
    return feeds.stored_cves(spark, path, "CVE-1", 100).select("cve_id", "severity", "cvss_score")


def cve_keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every brand, and some words of suppliers' names, as keywords in three sources of CVEs: parts, orders, suppliers."""
    part, orders, supplier = (A.table(spark, sf, t) for t in ("part", "orders", "supplier"))
    columns = lambda n, key, text, day: [F.lit(n).alias("source"), F.concat(F.lit("CVE-"), key).alias("cve_id"), text.alias("description"), F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int")).alias("published")]
    sources = part.select(*columns(1, F.col("p_partkey").cast("string"), F.concat_ws(" ", "p_name", "p_brand"), F.col("p_partkey") % 700))
    sources = sources.unionByName(orders.select(*columns(2, F.col("o_orderkey").cast("string"), F.concat(F.lit("of brand#"), (F.col("o_custkey") % 30).cast("string"), F.lit(" "), F.col("o_orderpriority")), F.col("o_orderkey") % 900)))
    sources = sources.unionByName(supplier.select(*columns(3, F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_name"), F.col("s_suppkey") % 50)))
    q = part.select(F.col("p_brand").alias("query_id"), F.col("p_brand").alias("query")).distinct()
    q = q.unionByName(supplier.select(F.col("s_name").alias("query_id"), F.substring("s_name", -3, 3).alias("query")))
    return P.keyword_search(q, sources).withColumn("published", F.date_format("published", "yyyy-MM-dd"))


def knowledge_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches appended to a store and its index, read back."""
    path, c = new_path(spark, "knowledge"), _cves(spark, sf).drop("p_brand")
    for name, part in (("b1", c.filter("severity = 'HIGH'")), ("b2", c.filter("severity = 'LOW'"))):
        sinks.append_knowledge(part, f"{path}/store", name)
        sinks.append_index(part, f"{path}/index")
    schema = "cve_id string, description string, severity string, cvss_score double, ingest string"
    index = spark.read.schema("cve_id string, description string, severity string, cvss_score double").parquet(f"{path}/index")
    store = spark.read.schema(schema).json(f"{path}/store").select("cve_id", "ingest")
    return store.join(index, "cve_id").select("cve_id", "ingest", F.length("description").alias("size"), "cvss_score")


def _run(spark, sf):
    f = A.findings(spark, sf).dropDuplicates(["id"])
    return f.select(
        "id", F.when(F.col("start_line") % 9 > 0, F.concat_ws(" ", F.lit("found"), "type")).alias("title"), F.when(F.col("start_line") % 8 > 0, F.lit(" some text ")).otherwise(F.lit(" ")).alias("description"), "file_path",
        F.when(F.col("start_line") % 7 == 0, F.lit("n/a")).otherwise(F.col("start_line").cast("string")).alias("start_line"), F.lit("3").alias("end_line"), F.col("type").alias("vulnerability_type"),
        F.when(F.col("severity") == "info", F.lit("odd")).otherwise(F.upper("severity")).alias("severity"), F.when(F.col("start_line") % 6 > 0, (F.col("confidence") * 1.5).cast("string")).alias("confidence"), F.lit("fix it").alias("recommendation"),
    )


def _loaded(spark, sf):
    path = new_path(spark, "run")
    sinks.save_run(_run(spark, sf), path, name="r1")
    return sinks.load_run(spark, path)


def saved_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run's findings saved and loaded again, with what was missing or wrong repaired."""
    return _loaded(spark, sf).select("id", "title", "description", "file_path", "start_line", "end_line", "vulnerability_type", "severity", F.round("confidence", 6).alias("confidence"), "snippet", "cwe_id", "recommendation")


def saved_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs saved in a folder, one a brand letter."""
    root = new_path(spark, "runs")
    f = _run(spark, sf)
    for name in ("run-b", "run-a"):
        sinks.save_run(f, f"{root}/{name}", name=name)
    return sinks.saved_runs(spark, root).select("run", (F.col("bytes") > 0).alias("has_bytes"))


def text_report(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the text report, counted."""
    path = new_path(spark, "report")
    sinks.text_report(_loaded(spark, sf), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.json_report(_loaded(spark, sf))


def html_report(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the page, counted."""
    path = new_path(spark, "page")
    sinks.html_report(_loaded(spark, sf), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def graph_dot(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the call graph in dot syntax."""
    path = new_path(spark, "dot")
    sinks.graph_dot(A.part_calls(spark, sf), path)
    return spark.read.text(path)


def graph_gexf(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the call graph in GEXF."""
    path = new_path(spark, "gexf")
    sinks.graph_gexf(A.part_calls(spark, sf), path)
    return spark.read.text(path)


def graph_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.graph_json(A.part_calls(spark, sf)).select("id", F.md5("node").alias("digest"))


def vector_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors saved and loaded."""
    path = new_path(spark, "vectors")
    sinks.save_vectors(A.table(spark, sf, "embeddings"), path)
    v = sinks.load_vectors(spark, path)
    return v.select("vec_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def pattern_store(spark: SparkSession, sf: str) -> DataFrame:
    """Learned patterns exported and imported; those without a pattern are dropped."""
    path = new_path(spark, "patterns")
    p = A.table(spark, sf, "part").select(
        F.format_string("p%d", "p_partkey").alias("pattern_id"), F.col("p_type").alias("finding_type"), F.when(F.col("p_partkey") % 5 > 0, F.concat("p_name", F.lit(".*"))).alias("pattern"), (F.col("p_size") / 100.0).alias("confidence"),
        F.lit("2024-05-01").alias("created"), F.col("p_size").alias("usage"), F.lit(0.5).alias("success"),
    )
    sinks.export_patterns(p, path)
    return sinks.import_patterns(spark, path).select("pattern_id", "finding_type", "pattern", F.round("confidence", 6).alias("confidence"), F.col("usage").cast("long").alias("usage"))


def usage_export(spark: SparkSession, sf: str) -> DataFrame:
    """Usage records exported with their summary: the summary, and how many records there are."""
    path = new_path(spark, "usage")
    m = A.metrics(spark, sf).select("event_id", "layer", "operation", (~F.col("failed")).alias("success"), F.round("value", 4).alias("execution_time"))
    sinks.export_usage(m, path)
    s = spark.read.schema("layer string, operation long, n long, succeeded long, seconds double").json(f"{path}/summary")
    r = spark.read.schema("event_id long, layer string").json(f"{path}/records").groupBy("layer").agg(F.count(F.lit(1)).alias("n_records"))
    return s.join(r, "layer").select("layer", "operation", "n", "succeeded", F.round("seconds", 2).alias("seconds"), "n_records")


def vulnerability_cwe(spark: SparkSession, sf: str) -> DataFrame:
    """CWE by type of finding and by old score band."""
    f = A.findings(spark, sf)
    kind = S.lookup(F.col("type"), {"sql injection": "Cross-File SQL Injection", "xss": "Cross-File XSS"}, "Cross-File Authorization Bypass")
    return f.groupBy(S.cwe_of(kind).alias("cwe"), S.cvss_v2_severity(F.col("confidence") * 10).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_ALL = (
    source_tree, project_hashes, dependency_manifests, listed_dependencies, nvd_feed, cve_list, cve_list_since, cve_details, stored_cves, cve_keyword_search, knowledge_batches, saved_run, saved_runs, text_report, json_report,
    html_report, graph_dot, graph_gexf, graph_json, vector_store, pattern_store, usage_export, vulnerability_cwe,
)
QUERIES = {f.__name__: f for f in _ALL}

_RUN = A.with_roles("findings") + """, f AS (SELECT DISTINCT id, file_path, start_line, type, severity, confidence FROM findings),
    r AS (SELECT id, CASE WHEN start_line % 9 > 0 THEN 'found ' || type ELSE 'unknown finding' END AS title, CASE WHEN start_line % 8 > 0 THEN 'some text' ELSE '' END AS description, file_path,
        CAST(CASE WHEN start_line % 7 = 0 THEN 1 ELSE start_line END AS INTEGER) AS start_line, CAST(greatest(3, CASE WHEN start_line % 7 = 0 THEN 1 ELSE start_line END) AS INTEGER) AS end_line, type AS vulnerability_type,
        CASE WHEN severity = 'info' THEN 'medium' ELSE severity END AS severity, round(CASE WHEN start_line % 6 > 0 THEN least(1.0, confidence * 1.5) ELSE 0.5 END, 6) AS confidence, '' AS snippet, '' AS cwe_id, 'fix it' AS recommendation FROM f)"""
_CVE = """c AS (SELECT 'CVE-' || p_partkey AS cve_id, repeat(p_name || ' ', CAST(p_size % 20 + 1 AS BIGINT)) AS description, CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END AS severity, round(p_size / CAST(5 AS DOUBLE), 4) AS cvss_score FROM part)"""
_PARTS = "SELECT p_partkey AS k, p_brand AS brand, 'lib' || p_partkey AS name, '1.' || p_size AS v FROM part"
_BARE = "trim(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"

SQL = {
    "source_tree": """SELECT 'lang=' || coalesce(lang, 'none') AS folder, '.txt' AS extension, 'other' AS language, CAST(sum(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) AS BIGINT) AS n_lines
        FROM documents WHERE lang IS NULL OR lang <> 'fr' GROUP BY 1""",
    "project_hashes": "SELECT o_custkey, md5(string_agg(l, chr(10) ORDER BY l)) AS hash FROM (SELECT o_custkey, 'src/m' || o_orderkey || '.py:' || CAST(epoch_ms(o_orderdate) AS BIGINT) AS l FROM orders) x GROUP BY 1",
    "dependency_manifests": "SELECT DISTINCT p_brand || '/' || f.name AS relative_path, ecosystem FROM part, (VALUES ('requirements.txt', 'python'), ('pom.xml', 'java'), ('package.json', 'javascript')) f(name, ecosystem)",
    "listed_dependencies": f"""WITH p AS ({_PARTS}) SELECT brand || '/requirements.txt' AS relative_path, 'python' AS ecosystem, name, CASE k % 4 WHEN 0 THEN v WHEN 1 THEN '>=' || v ELSE 'latest' END AS version, 'prod' AS scope FROM p WHERE k % 4 <> 3
        UNION ALL SELECT brand || '/package.json', 'javascript', name, v, CASE k % 2 WHEN 0 THEN 'prod' ELSE 'dev' END FROM p
        UNION ALL SELECT brand || '/pom.xml', 'java', 'org.' || brand || ':' || name, CASE k % 2 WHEN 0 THEN v ELSE 'unspecified' END, 'prod' FROM p""",
    "nvd_feed": """SELECT 'CVE-2024-' || p_partkey AS cve_id, p_name AS description, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size > 40 THEN 'HIGH' ELSE 'MEDIUM' END WHEN 1 THEN CASE WHEN p_size / 5.0 >= 7 THEN 'HIGH' WHEN p_size / 5.0 >= 4 THEN 'MEDIUM' ELSE 'LOW' END
            ELSE 'MEDIUM' END AS severity, round(CASE WHEN p_partkey % 3 = 2 THEN CAST(5 AS DOUBLE) ELSE p_size / CAST(5 AS DOUBLE) END, 4) AS cvss_score, '2024-01-02' AS day, 1 AS n_references, p_brand || ' ' || p_type AS products, 'CWE-' || (p_partkey % 9) AS cwe_ids FROM part""",
    "cve_list": """WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN CAST(5 AS DOUBLE) ELSE least(10.0, o_orderkey % 120 / CAST(10 AS DOUBLE)) END AS s FROM orders WHERE o_orderkey % 7 <> 0)
        SELECT 'CVE-' || o_orderkey AS cve_id, 'order of ' || o_custkey AS title, 'CWE-79' AS cwe_type, strftime(o_orderdate, '%Y-%m-%d') AS disclosed, CAST(s AS DOUBLE) AS cvss_score,
            CASE WHEN s >= 9 THEN 'CRITICAL' WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, '/d/' || o_orderkey AS detail_url FROM o""",
    "cve_keyword_search": """WITH s AS (SELECT 1 AS source, 'CVE-' || p_partkey AS cve_id, concat_ws(' ', p_name, p_brand) AS description, DATE '2020-01-01' + CAST(p_partkey % 700 AS INTEGER) AS published FROM part
            UNION ALL SELECT 2, 'CVE-' || o_orderkey, 'of brand#' || (o_custkey % 30) || ' ' || o_orderpriority, DATE '2020-01-01' + CAST(o_orderkey % 900 AS INTEGER) FROM orders
            UNION ALL SELECT 3, 'CVE-S' || s_suppkey, s_name, DATE '2020-01-01' + CAST(s_suppkey % 50 AS INTEGER) FROM supplier),
        q AS (SELECT DISTINCT p_brand AS query_id, p_brand AS query FROM part UNION ALL SELECT s_name, substr(s_name, -3, 3) FROM supplier),
        f AS (SELECT DISTINCT query_id, source, cve_id, published FROM q JOIN s ON contains(lower(cve_id), lower(query)) OR contains(lower(description), lower(query))),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY published DESC, cve_id) AS n, least(5, count(*) FILTER (source = 1) OVER (PARTITION BY query_id)) AS n1, count(*) FILTER (source = 2) OVER (PARTITION BY query_id) AS all2 FROM f),
        k AS (SELECT *, least(all2, greatest(1, 10 - n1)) AS n2 FROM n), t AS (SELECT * FROM k WHERE n <= CASE source WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE 10 - n1 - n2 END),
        o AS (SELECT query_id, cve_id, arg_min(published, source) AS published, min(source) AS source FROM t GROUP BY 1, 2),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY published DESC, cve_id) AS INTEGER) AS rank, cve_id, source, strftime(published, '%Y-%m-%d') AS published FROM o)
        SELECT * FROM r WHERE rank <= 10""",
    "cve_list_since": "SELECT 'CVE-' || o_orderkey AS cve_id, strftime(o_orderdate, '%Y-%m-%d') AS disclosed FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 2 <> 0 AND o_orderdate >= TIMESTAMP '2000-01-01'",
    "cve_details": f"""WITH h AS (SELECT page_id, html || '<p>CWE-79 CWE-89 CWE-79 CVSS:3.1/AV:N/AC:L <a href=''https://x.org/1''>x</a></p>' AS html FROM pages),
        t AS (SELECT page_id, html, {_BARE.format("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g')")} AS t FROM h)
        SELECT page_id, length(t) AS size, md5(t) AS digest, 'CVSS:3.1/AV:N/AC:L' AS cvss_vector, array_to_string(['CWE-79', 'CWE-89'], ',') AS cwe_ids,
            CAST(len(list_distinct(regexp_extract_all(html, '(?i)href=["''](https?://[^"'']*)', 1))) AS INTEGER) AS n_links FROM t""",
    "stored_cves": f"WITH {_CVE} SELECT cve_id, severity, cvss_score FROM c WHERE contains(lower(cve_id), 'cve-1') OR contains(lower(description), 'cve-1') ORDER BY cve_id LIMIT 100",
    "knowledge_batches": f"WITH {_CVE} SELECT cve_id, CASE severity WHEN 'HIGH' THEN 'b1' ELSE 'b2' END AS ingest, CAST(least(200, length(description)) AS INTEGER) AS size, cvss_score FROM c",
    "saved_run": _RUN + " SELECT * FROM r",
    "saved_runs": "SELECT * FROM (VALUES ('run-a', true), ('run-b', true)) r(run, has_bytes)",
    "text_report": _RUN + """, l AS (SELECT '[' || upper(severity) || '] ' || title AS value FROM r UNION ALL SELECT '  file: ' || file_path || ':' || start_line FROM r UNION ALL SELECT '  type: ' || vulnerability_type FROM r
        UNION ALL SELECT '  fix: ' || recommendation FROM r) SELECT value, count(*) AS n FROM l GROUP BY 1""",
    "json_report": _RUN + """, s AS (SELECT severity, count(*) AS n FROM r GROUP BY 1) SELECT '{"total":' || sum(n) || ',"by_severity":{' || string_agg('"' || severity || '":' || n, ',' ORDER BY severity) || '}}' AS report FROM s""",
    "html_report": _RUN + """, l AS (SELECT '<tr><td>' || severity || '</td><td>' || title || '</td><td>' || file_path || '</td><td>' || vulnerability_type || '</td></tr>' AS value FROM r
        UNION ALL SELECT * FROM (VALUES ('<!DOCTYPE html><html><body><table>'), ('</table></body></html>')) x(value)) SELECT value, count(*) AS n FROM l GROUP BY 1""",
    "graph_dot": A.with_roles("part_calls") + """ SELECT '  "' || src || '" -> "' || dst || '";' AS value FROM part_calls UNION ALL SELECT * FROM (VALUES ('digraph calls {'), ('}')) x(value)""",
    "graph_gexf": A.with_roles("part_calls") + """, n AS (SELECT src AS id FROM part_calls UNION SELECT dst FROM part_calls) SELECT '<node id="' || id || '" label="' || id || '"/>' AS value FROM n
        UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"/>' FROM part_calls
        UNION ALL SELECT * FROM (VALUES ('<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">'), ('<nodes>'), ('</nodes>'), ('<edges>'), ('</edges>'), ('</graph></gexf>')) x(value)""",
    "graph_json": A.with_roles("part_calls") + """, n AS (SELECT src AS id FROM part_calls UNION SELECT dst FROM part_calls), l AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS d FROM part_calls GROUP BY 1)
        SELECT id, md5('{"id":' || id || ',"links":[' || coalesce(d, '') || ']}') AS digest FROM n LEFT JOIN l ON l.src = n.id""",
    "vector_store": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings",
    "pattern_store": "SELECT 'p' || p_partkey AS pattern_id, p_type AS finding_type, p_name || '.*' AS pattern, round(p_size / CAST(100 AS DOUBLE), 6) AS confidence, CAST(p_size AS BIGINT) AS usage FROM part WHERE p_partkey % 5 > 0",
    "usage_export": A.with_roles("metrics") + """, s AS (SELECT layer, operation, count(*) AS n, count(*) FILTER (NOT failed) AS succeeded, round(sum(round(value, 4)), 2) AS seconds FROM metrics GROUP BY 1, 2),
        r AS (SELECT layer, count(*) AS n_records FROM metrics GROUP BY 1) SELECT layer, operation, n, succeeded, seconds, n_records FROM s JOIN r USING (layer)""",
    "vulnerability_cwe": A.with_roles("findings") + """ SELECT CASE type WHEN 'sql injection' THEN 'CWE-89' WHEN 'xss' THEN 'CWE-79' ELSE 'CWE-285' END AS cwe,
        CASE WHEN confidence * 10 >= 7 THEN 'HIGH' WHEN confidence * 10 >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS band, count(*) AS n FROM findings GROUP BY 1, 2""",
}
