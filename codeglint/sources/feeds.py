"""Vulnerability feeds: NVD JSON, HTML tables of lists, detail pages, JSON files on disk.

Fetching is left to whoever has a network; these readers start at stored responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import banded, clamp, cvss_v2_severity

_METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string>>>"
_TEXT = "array<struct<lang:string,value:string>>"
NVD = (
    f"vulnerabilities array<struct<cve:struct<id:string,descriptions:{_TEXT},published:string,lastModified:string,metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV2:{_METRIC}>,"
    f"references:array<struct<url:string>>,weaknesses:array<struct<description:{_TEXT}>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>>>>"
)


def nvd_cves(responses: DataFrame, json_col: str = "body") -> DataFrame:
    """cve_id, description, severity, cvss_score, published, modified, references, products, cwe_ids of stored NVD responses.

    English descriptions; the 3.1 score if there is one, else 2, else 5.0; products are vendor and name, each once.
    """
    c = responses.select(F.explode(F.from_json(json_col, NVD)["vulnerabilities"]).alias("v")).select("v.cve.*")
    english = lambda texts: F.filter(texts, lambda d: d["lang"] == "en")
    v3, v2 = (F.get(F.col(f"metrics.{m}"), 0)["cvssData"] for m in ("cvssMetricV31", "cvssMetricV2"))
    score = F.coalesce(F.when(v3.isNotNull(), F.coalesce(v3["baseScore"], F.lit(5.0))), v2["baseScore"], F.lit(5.0))
    severity = F.when(v3.isNotNull(), F.coalesce(v3["baseSeverity"], F.lit("MEDIUM"))).when(v2.isNotNull(), cvss_v2_severity(score)).otherwise(F.lit("MEDIUM"))
    none = F.array().cast("array<string>")
    urls = F.filter(F.coalesce(F.transform("references", lambda r: r["url"]), none), lambda u: u.isNotNull() & (u != ""))
    cwe = F.flatten(F.transform("weaknesses", lambda w: F.transform(english(w["description"]), lambda d: d["value"])))
    criteria = F.flatten(F.flatten(F.transform("configurations", lambda k: F.transform(k["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))
    parts = F.filter(F.transform(criteria, lambda x: F.split(x, ":")), lambda p: F.size(p) > 4)
    stamp = lambda c: F.try_to_timestamp(F.col(c))
    return c.select(
        F.col("id").alias("cve_id"), F.coalesce(F.get(english(F.col("descriptions")), 0)["value"], F.lit("")).alias("description"), severity.alias("severity"), score.alias("cvss_score"),
        stamp("published").alias("published"), stamp("lastModified").alias("modified"), urls.alias("references"),
        F.array_distinct(F.coalesce(F.transform(parts, lambda p: F.concat_ws(" ", p[3], p[4])), none)).alias("products"), F.filter(F.coalesce(cwe, none), lambda x: x.startswith("CWE-")).alias("cwe_ids"),
    )


def _bare(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))


def list_rows(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of pages to keep, cve_id, title, cwe_type, disclosed, cvss, detail_url of the table rows of list pages; rows under five cells or without a link go."""
    rows = F.regexp_extract_all(html_col, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    r = pages.select(*keep, F.explode(rows).alias("row")).withColumn("c", F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)))
    r = r.filter((F.size("c") >= 5) & F.regexp_like(F.get("c", 0), F.lit("(?i)<a[^>]*>")))
    cell = lambda i: _bare(F.get("c", i))
    return r.select(*keep, cell(0).alias("cve_id"), cell(1).alias("title"), cell(2).alias("cwe_type"), cell(3).alias("disclosed"), cell(4).alias("cvss"), F.regexp_extract(F.get("c", 0), r"""(?i)href=["']([^"']*)""", 1).alias("detail_url"))


def detail_fields(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with description (the text without tags and scripts), CVSS 3.1 vector, CWE ids and links."""
    text = _bare(F.regexp_replace(html_col, r"(?is)<(script|style)[^>]*>.*?</\1>", " "))
    return pages.withColumns({
        "description": text, "cvss_vector": F.nullif(F.regexp_extract(html_col, r"(CVSS:3\.1/[A-Z:/]+)", 1), F.lit("")),
        "cwe_ids": F.array_distinct(F.regexp_extract_all(html_col, F.lit(r"CWE-\d+"), F.lit(0))), "links": F.array_distinct(F.regexp_extract_all(html_col, F.lit(r"""(?i)href=["'](https?://[^"']*)"""), F.lit(1))),
    })


def scored(items: DataFrame, score_col: str = "cvss") -> DataFrame:
    """items with cvss_score (a number from 0 to 10, 5.0 if there is none) and severity."""
    number = F.regexp_extract(score_col, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    out = items.withColumn("cvss_score", clamp(F.coalesce(number, F.lit(5.0)), 0.0, 10.0))
    return out.withColumn("severity", banded(F.col("cvss_score"), ((9.0, "CRITICAL"), (7.0, "HIGH"), (4.0, "MEDIUM")), "LOW"))


def since(items: DataFrame, date: str, column: str = "disclosed") -> DataFrame:
    """Items disclosed on a date or later; dates that can't be read go."""
    return items.filter(F.col(column).try_cast("date") >= F.lit(date).cast("date"))


def stored_cves(spark: SparkSession, path: str, keyword: str, limit: int) -> DataFrame:
    """CVEs of JSON files (objects with a list `cves`) whose id or description has the keyword, by id."""
    j = spark.read.schema("cves array<struct<cve_id:string,description:string,severity:string,cvss_score:double>>").option("multiLine", "true").json(path)
    c = j.select(F.explode("cves").alias("c")).select("c.*")
    word = F.lit(keyword.lower())
    return c.filter(F.contains(F.lower("cve_id"), word) | F.contains(F.lower("description"), word)).orderBy("cve_id").limit(limit)
