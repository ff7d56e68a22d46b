"""Sources and sinks: a tree on disk, feeds, reports."""

import json

import pytest
from pyspark.sql import functions as F

from codeglint.sources import feeds, files, sinks


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, data in {
        "app/main.py": b"print(1)\n", "app/.git/x.py": b"no", "node_modules/y.js": b"no", "data.bin": b"a\x00b", "notes": b"plain", "bad.js": b"a\xffb", "big.py": b"x" * 5000, "logo.png": b"png",
        "requirements.txt": b"# c\na==1.0\nb>=2\nc\n\n", "web/package.json": json.dumps({"dependencies": {"x": "1"}, "devDependencies": {"y": "2"}}).encode(),
        "pom.xml": b"<p><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></p>",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_scan(spark, tree):
    got = {r.relative_path: r for r in files.scan(spark, tree, ["node_*"], [".PNG"], 1000).collect()}
    assert set(got) == {"app/main.py", "notes", "bad.js", "requirements.txt", "web/package.json", "pom.xml"}
    assert got["app/main.py"].language == "python" and got["notes"].language == "other" and "�" in got["bad.js"].content


def test_dependencies(spark, tree):
    f = files.scan(spark, tree)
    assert {(r.name, r.ecosystem) for r in files.manifests(f).collect()} == {("requirements.txt", "python"), ("package.json", "javascript"), ("pom.xml", "java")}
    assert {(r.name, r.version, r.scope) for r in files.dependencies(f).collect()} == {("a", "1.0", "prod"), ("b", ">=2", "prod"), ("c", "latest", "prod"), ("x", "1", "prod"), ("y", "2", "dev"), ("g:a", "unspecified", "prod")}
    assert len(files.project_hash(f).first().hash) == 32


def test_nvd(spark):
    cve = {
        "id": "CVE-1", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "yes"}], "published": "2024-01-02T03:04:05.000", "lastModified": "bad", "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}]},
        "references": [{"url": "u"}, {"url": ""}], "weaknesses": [{"description": [{"lang": "en", "value": "CWE-79"}, {"lang": "en", "value": "NVD-other"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:v:p:1"}, {"criteria": "cpe:2.3:a:v:p:2"}, {"criteria": "x"}]}]}],
    }
    body = json.dumps({"vulnerabilities": [{"cve": cve}, {"cve": {"id": "CVE-2", "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 4.3}}]}}}, {"cve": {"id": "CVE-3"}}]})
    got = {r.cve_id: r for r in feeds.nvd_cves(spark.createDataFrame([(body,), ("junk",)], "body string")).collect()}
    a = got["CVE-1"]
    assert (a.description, a.severity, a.cvss_score, a.references, a.products, a.cwe_ids, a.modified) == ("yes", "CRITICAL", 9.8, ["u"], ["v p"], ["CWE-79"], None)
    assert (got["CVE-2"].severity, got["CVE-2"].cvss_score, got["CVE-3"].severity, got["CVE-3"].products) == ("MEDIUM", 4.3, "MEDIUM", [])


def test_html(spark):
    page = "<table><tr><th>h</th></tr><tr><td><a href='/d/1'>CVE-9</a></td><td> t <b>x</b></td><td>CWE-1</td><td>2024-02-03</td><td>7.5 high</td></tr><tr><td>no</td></tr></table>"
    rows = feeds.list_rows(spark.createDataFrame([(page,)], "html string"))
    assert [tuple(r) for r in rows.collect()] == [("CVE-9", "t x", "CWE-1", "2024-02-03", "7.5 high", "/d/1")]
    assert feeds.scored(rows).first().severity == "HIGH"
    assert feeds.since(rows, "2024-02-03").count() == 1 and feeds.since(rows, "2024-02-04").count() == 0
    d = feeds.detail_fields(spark.createDataFrame([("<p>hi</p><script>x</script> CVSS:3.1/AV:N/AC:L CWE-5 <a href='https://q'>l</a>",)], "html string")).first()
    assert (d.cvss_vector, d.cwe_ids, d.links) == ("CVSS:3.1/AV:N/AC:L", ["CWE-5"], ["https://q"]) and "x" not in d.description.split()


FINDING = "id string, title string, description string, file_path string, start_line int, end_line int, vulnerability_type string, severity string, confidence double, cwe_id string, owasp_category string, snippet string, recommendation string"


def test_runs_and_reports(spark, tmp_path):
    rows = [("1", None, "d", "f.py", 3, None, "xss", "HIGH", 1.7, None, None, "s", "fix"), ("2", "t", "d", "f.py", None, 1, None, "odd", None, "c", "o", "s", "")]
    df, path = spark.createDataFrame(rows, FINDING), str(tmp_path / "runs" / "r1")
    sinks.save_run(df, path, project="p")
    with open(f"{path}/part-x.json", "w") as f:
        f.write("{broken\n")
    got = {r.id: r for r in sinks.load_run(spark, path).collect()}
    assert (got["1"].title, got["1"].severity, got["1"].confidence, got["1"].end_line) == ("unknown finding", "high", 1.0, 3)
    assert (got["2"].severity, got["2"].start_line, got["2"].confidence) == ("medium", 1, 0.5) and got[None]._corrupt_record == "{broken"
    clean = sinks.normalised(df)
    assert json.loads(sinks.json_report(clean).first().report) == {"total": 2, "by_severity": {"high": 1, "medium": 1}}
    sinks.text_report(clean, str(tmp_path / "text"))
    assert "[HIGH] unknown finding" in {r.value for r in spark.read.text(str(tmp_path / "text")).collect()}
    assert [r.run for r in sinks.saved_runs(spark, str(tmp_path / "runs")).collect()] == ["r1"]


def test_other_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (1, 3)], "src int, dst int")
    sinks.graph_dot(e, str(tmp_path / "dot"))
    assert [r.value for r in spark.read.text(str(tmp_path / "dot")).collect()] == ["digraph calls {", '  "1" -> "2";', '  "1" -> "3";', "}"]
    assert {json.loads(r.node)["id"] for r in sinks.graph_json(e).collect()} == {1, 2, 3}
    v = spark.createDataFrame([(1, [0.5, 1.0])], "vec_id long, embedding array<float>")
    sinks.save_vectors(v, str(tmp_path / "v"))
    assert sinks.load_vectors(spark, str(tmp_path / "v")).collect() == v.collect()
    c = spark.createDataFrame([("CVE-1", "long " * 90, "HIGH", 7.0)], "cve_id string, description string, severity string, cvss_score double")
    for batch in ("a", "b"):
        sinks.append_knowledge(c, str(tmp_path / "k"), batch)
        sinks.append_index(c, str(tmp_path / "i"))
    assert spark.read.json(str(tmp_path / "k")).count() == 2 and spark.read.parquet(str(tmp_path / "i")).agg(F.max(F.length("description"))).first()[0] == 200
    (tmp_path / "cves.json").write_text(json.dumps({"cves": [{"cve_id": "CVE-7", "description": "An XSS"}]}))
    assert feeds.stored_cves(spark, str(tmp_path / "cves.json"), "xss", 5).count() == 1
    p = spark.createDataFrame([("p", "xss", "a.*b", 0.5, 1, 0.5)], "pattern_id string, finding_type string, pattern string, confidence double, usage int, success double")
    sinks.export_patterns(p, str(tmp_path / "p"))
    assert sinks.import_patterns(spark, str(tmp_path / "p")).count() == 1
