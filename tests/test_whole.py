"""Queries over whole tables against brute force."""

import re

import numpy as np
import pytest

from codeglint.operators import detect, graph
from codeglint.operators.knowledge import packed_paragraphs
from codeglint.plans import analysis, graphs, knowledge


def whole_calls(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").collect()
    rows = sorted(rows)
    return {(a.l_partkey, b.l_partkey) for a, b in zip(rows, rows[1:]) if a.l_orderkey == b.l_orderkey and a.l_partkey != b.l_partkey}


def steps_from(edges, starts):
    depth, now, n = {}, set(starts), 0
    while now:
        n += 1
        now = {b for a, b in edges if a in now} - depth.keys()
        depth |= dict.fromkeys(now, n)
    return depth


def test_whole_call_graph(spark, sf):
    edges = whole_calls(spark, sf)
    size = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    depth = steps_from(edges, [k for k, s in size.items() if s % 6 == 1])
    want = {b: depth.get(b) for _, b in edges if size[b] % 6 == 0}
    assert {r.node: r.depth for r in graphs.auth_distance(spark, sf).collect()} == want
    got = {r.node: (r.in_degree, r.out_degree) for r in graphs.degree_centrality(spark, sf).collect()}
    assert got == {n: (sum(b == n for _, b in edges), sum(a == n for a, _ in edges)) for n in {x for e in edges for x in e}}


def test_distances_have_no_bound(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 5)], "src int, dst int")
    start = spark.createDataFrame([(0,)], "src int")
    assert {r.dst: r.depth for r in graph.distances(e, None, start).collect()} == {i: i for i in range(1, 13)}
    assert {r.node: r.depth for r in graph.nearest_start(e, start).collect()} == {i: i for i in range(1, 13)}


def test_paragraph_chunks_of_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, n, len(c)) for r in docs for n, c in enumerate(packed_paragraphs((r.text or "").replace("\n", "\n\n"), 120, 30)))
    assert sorted(map(tuple, knowledge.paragraph_chunks(spark, sf).collect())) == want


def test_keywords_of_whole_texts(spark, sf):
    words = {r.doc_id: (r.source, set(re.findall(r"\w+", (r.text or "").lower()))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, last = {}, {}
    for i, (source, k) in sorted(words.items()):
        if source in last:
            p = last[source]
            want[i] = 1.0 if not k and not p else len(k & p) / len(k | p)
        last[source] = k
    got = {r.doc_id: (r.jaccard, r.similarity) for r in analysis.keyword_jaccard(spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, j in want.items():
        assert got[i][0] == pytest.approx(j, abs=2e-6)


def test_similar_cases_by_all_of_the_similarity(spark, sf):
    """Tokens, structure, keywords and patterns of each kind of snippet against each case of its type."""
    from codeglint.functions import rules
    from codeglint.operators.retrieval import structure_ratio

    def parts(code):
        bare = re.sub(r"\s+", " ", re.sub(r"(?m)#.*$", "", code)).strip()
        plain = re.sub(r"\b\d+\b", "0", re.sub("[\"'].*?[\"']", '""', bare))
        words = set(re.findall(r"\w+", plain.lower()))
        shapes = {x.rstrip() for x in re.findall(r"\w+\s*\(", plain) + re.findall(r"\w+\s*=", plain)} | set(re.findall(r"if\s*\(.*?\)", plain))
        return plain, words, words & {*rules.PROGRAMMING_WORDS, *rules.SECURITY_WORDS}, shapes

    def jaccard(x, y):
        return 1.0 if not x and not y else len(x & y) / len(x | y) if x and y else 0.0

    def similarity(a, b):
        (p, *x), (q, *y) = parts(a), parts(b)
        token, semantic, pattern = (jaccard(m, n) for m, n in zip(x, y))
        return 0.3 * token + 0.25 * structure_ratio(p, q) + 0.25 * semantic + 0.2 * pattern

    want = {}
    for f in analysis._findings(spark, sf).collect():
        near = [c for c in analysis.CASES if c[1] == f.type] or [c for c in analysis.CASES if c[1] in f.type or f.type in c[1]]
        scored = sorted((-round(similarity(f.snippet, c[2]), 6), c[0]) for c in near)
        for rank, (s, c) in enumerate([x for x in scored if -x[0] >= 0.3], 1):
            n, most = want.get((c, rank), (0, 0.0))
            want[c, rank] = (n + 1, max(most, -s))
    got = {(r.case_id, r.rank): (r.n, r.similarity) for r in analysis.similar_cases(spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)


def tree(spark, nodes):
    return spark.createDataFrame([(n, p, n.split("::")[1], c, whole) for n, p, c, whole in nodes], "node string, path string, name string, code string, file_code string")


def test_audit_follows_long_paths(spark):
    """An input and an authenticating caller twelve calls off."""
    codes = {0: "request.args", 12: "cursor.execute(x)"}
    nodes = tree(spark, [(f"m{i}::f{i}", f"m{i}.py", codes.get(i, "pass"), "") for i in range(13)])
    e = spark.createDataFrame([(f"m{i}::f{i}", f"m{i + 1}::f{i + 1}") for i in range(12)], "src string, dst string")
    got = {(r.type, r.source, r.target, r.depth) for r in detect.cross_file_findings(nodes, e).collect()}
    assert ("Cross-File SQL Injection", "m0::f0", "m12::f12", 12) in got
    guarded = tree(spark, [(f"m{i}::f{i}", f"m{i}.py", {0: "authenticate(user)", 12: "delete_user(x)"}.get(i, "pass"), "") for i in range(13)])
    alone = {r.source for r in detect.unauthorised(guarded, e.limit(0)).collect()}
    assert alone and not {r.source for r in detect.unauthorised(guarded, e).collect()}


def test_audit_follows_imports(spark):
    """A pair without a path of calls, joined by an import; not so where an end is protected or a protected path joins it."""
    sink = "import web\nq = web.form()\n"
    nodes = tree(spark, [("web.py::form", "web.py", "request.args", ""), ("db.py::run", "db.py", "cursor.execute(x)", sink), ("safe.py::go", "safe.py", "cursor.execute(escape(x))", sink), ("mid.py::clean", "mid.py", "escape(x)", "")])
    sql = lambda e: {(r.source, r.target, r.depth) for r in detect.cross_file_findings(nodes, e).filter("type like '%SQL%'").collect()}
    edges = spark.createDataFrame([("web.py::form", "mid.py::clean"), ("mid.py::clean", "db.py::run")], "src string, dst string")
    assert sql(edges.limit(0)) == {("web.py::form", "db.py::run", None)}
    assert sql(edges) == set()
    auth = tree(spark, [("auth.py::check", "auth.py", "authenticate(user)", ""), ("a.py::f", "a.py", "delete(x)", "import auth\nauth.check(x)\n"), ("b.py::g", "b.py", "delete(x)", "")])
    assert {r.source for r in detect.unauthorised(auth, edges.limit(0)).collect()} == {"b.py::g"}


def test_nearest_of_every_fiftieth_vector(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    got = {}
    for r in analysis.cosine_topk(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.similarity)
    assert sorted(got) == [i for i in sorted(rows) if i % 50 == 0]
    for i, s in got.items():
        q = rows[i]
        every = sorted((float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)) for k, v in rows.items()), reverse=True)
        others = sorted((float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)) for k, v in rows.items() if k != i), reverse=True)
        assert s == pytest.approx((every if s[0] > 0.999999 else others)[: len(s)], abs=2e-6)
    far = {r.query_id: r.similarity for r in analysis.l2_topk(spark, sf).filter("rank = 5").collect()}
    assert far.keys() == got.keys()
    for i, s in far.items():
        near = sorted((max(0.0, 1 - float(((rows[i] - v) ** 2).sum()) / 100) for v in rows.values()), reverse=True)
        assert s == pytest.approx(near[4], abs=2e-6)


def test_validated_findings_add_up(spark, sf):
    """Every finding once; rules' false positives are rejected, and statuses keep to their bands."""
    from codeglint.operators import integration
    from codeglint.plans import texts

    f, v = texts._validation(spark, sf)
    rows = integration.validated(f, v).collect()
    assert len(rows) == f.count() == len({r.id for r in rows})
    assert all(r.status == "rejected" and r.confidence == 0 for r in rows if r.false_positive)
    assert all(r.confidence >= 0.8 for r in rows if r.status == "validated") and all(r.confidence >= 0.5 for r in rows if r.status == "needs_review")
    assert any(r.false_positive for r in rows) and any(r.status == "needs_review" for r in rows)


def test_links_of_all_findings(spark, monkeypatch):
    """Pairs of findings alike against the measure itself, over files, types, lines and severities."""
    import itertools
    import random

    from pyspark.sql import functions as F

    from codeglint.functions import scoring as S
    from codeglint.operators import findings as O

    r = random.Random(3)
    kinds = ("sql injection", "command injection", "xss", "database query")
    rows = [(f"i{i}", r.choice(kinds), r.choice(("a/x.py", "b/x.js", "a/y.py")), r.randrange(30), r.choice(("high", "low")), r.choice(("some text here", "", "other words")), r.choice(("exec select", "", "system()")), 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, type string, file_path string, start_line int, severity string, description string, snippet string, confidence double")
    pairs = [(*a[:7], *b[:7]) for a, b in itertools.combinations(rows, 2)]
    names = ("id", "type", "path", "line", "severity", "description", "snippet")
    p = spark.createDataFrame(pairs, [f"a_{n}" for n in names] + [f"b_{n}" for n in names])
    similarity = S.finding_similarity(*({n: F.col(f"{x}_{n}") for n in names if n != "id"} for x in "ab"))
    near = p.filter(F.round(similarity, 9) >= 0.8).select("a_id", "b_id").collect()
    want = dict.fromkeys([x[0] for x in rows], 0)
    for a, b in near:
        want[a] += 1
        want[b] += 1
    assert {x.id: x.n_links for x in O.finding_links(df, 0.8).collect()} == want and any(want.values())
    want = {x.id: x.cluster_id for x in O._greedy(df.withColumn("stem", F.lit(1)), ["stem"], 0.8).collect()}
    assert {x.id: x.cluster_id for x in O.greedy_clusters(df).collect()} == want
    # the same by rounds of few leaders, broadcast or not
    monkeypatch.setattr(O, "LEADERS", 7)
    monkeypatch.setattr(O, "BROADCAST_LEADERS", 3)
    assert {x.id: x.cluster_id for x in O.greedy_clusters(df).collect()} == want
    assert O.greedy_clusters(df.limit(0)).collect() == []


def test_places_by_ranges(spark):
    from codeglint.storage import numbered

    df = spark.range(1000).selectExpr("id", "id * 7919 % 1009 AS k")
    got = {x.id: x.place for x in numbered(df, ["k", "id"], "place").collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((i * 7919 % 1009, i) for i in range(1000)), 1)}


def test_names_that_hold_each_other(spark):
    from codeglint.operators.knowledge import fuzzy_targets

    units = [("u1", "load_user", "a"), ("u2", "load_users_all", "b"), ("u3", "get", "a"), ("u4", "load_user", "b")]
    refs = [(1, "load_user", "b"), (2, "load_users", "a"), (3, "getter", "a"), (4, "getter", "b"), (5, "al", "a"), (6, "sers_a", "c"), (7, "zzz", "a")]
    got = {r.ref_id: r.unit for r in fuzzy_targets(spark.createDataFrame(refs, "ref_id int, target string, path string"), spark.createDataFrame(units, "unit string, name string, path string")).collect()}
    assert got == {1: "u4", 2: "u1", 3: "u3", 6: "u2"}
