"""Mixing and quality rules against brute force."""

import math
import re
from collections import Counter, defaultdict
from hashlib import md5

import duckdb
import pytest

from codeglint.llm import mixing, quality
from codeglint.llm import registry as queries

SPACE = "[ \x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def targets(sizes):
    """By repeated resharing of the excess."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(order)}
    cap, left, open_, out = {s: 3.0 * sizes[s] for s in order}, float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= over
    return out


def weight_of(text):
    t = text or ""
    solid = sum(c not in " \t\n\x0b\f\r" for c in t)
    return max(0.5, 2.0 - 15.0 * (sum(c in quality.SYMBOLS for c in t) / solid if solid else 1.0))


def brute_mix(rows):
    by = defaultdict(list)
    for i, t, s in rows:
        u = (int(md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        by[s].append((-math.log(u) / weight_of(t), "" if i is None else str(i), len(words(t)), i))
    sizes = {s: sum(x[2] for x in xs) for s, xs in by.items()}
    goal, out = targets(sizes), []
    for s, xs in by.items():
        epochs = int(goal[s] // sizes[s]) if sizes[s] else 0
        rest, before = goal[s] - epochs * sizes[s], 0
        for _, _, n, i in sorted(xs, key=lambda x: x[:3]):
            out.append((i, n, sizes[s], goal[s], n * (epochs + (before < rest and before + n / 2 <= rest))))
            before += n
    return out


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[1], r[4])), sorted(want, key=lambda r: (str(r[0]), r[1], r[4]))):
        assert (*g[:3], g[4]) == (*w[:3], w[4]) and g[3] == pytest.approx(w[3])


def ties():
    """Sources of rows of one id, of none, of a few ids, and with empty texts."""
    rows = [(7, "one two three four five", "x")] * 200 + [(None, "a b c", "y")] * 150 + [(i % 3, "a b c d", "z") for i in range(90)]
    return rows + [(None, None, "z")] * 40 + [(5, f"w{i} w w", "v") for i in range(77)] + [(i, "own words of its own", None) for i in range(50)]


def test_ties_are_cut_inside(spark):
    df = spark.createDataFrame(ties(), "doc_id long, text string, source string").repartition(5)
    got = mixing.mixed(df).collect()
    same([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got], brute_mix(ties()))
    taken, goal = defaultdict(int), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 5 for s in goal)
    assert sorted(map(str, mixing.mixed(df).collect())) == sorted(map(str, got))
    copies = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_documents(df).collect())
    assert {s: sum(n * len(words(t)) for (_, t, x), n in copies.items() if x == s) for s in goal} == dict(taken)


def test_many_rows_of_no_id(spark):
    """A third of all rows share no id and one text, and the cut falls inside."""
    df = spark.range(100_000).selectExpr("cast(null as long) AS doc_id", "'a b c' AS text", "'x' AS source").union(spark.range(200_000).selectExpr("id", "'a b c d'", "'y'"))
    sums = {r.source: r for r in mixing.mixed(df).groupBy("source").agg({"taken": "sum", "target": "max", "taken": "sum"}).collect()}
    goals = {r.source: r.target for r in mixing.mixed(df).select("source", "target").distinct().collect()}
    assert all(abs(sums[s]["sum(taken)"] - goals[s]) <= 4 for s in goals)


def test_op7(spark, sf, docs):
    got = queries.op7_mixing(spark, sf).collect()
    same(got, brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()]))
    taken, goal, size = defaultdict(int), {}, defaultdict(int)
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
        size[source[r.doc_id]] = max(size[source[r.doc_id]], r.size)
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - goal[s]) <= size[s] for s in goal)
    assert sum(goal.values()) == pytest.approx(sum(r.size for r in got))


def test_mixing_odd_rows(odd, none):
    unique = odd.dropDuplicates(["doc_id", "text"])
    got = mixing.mixed(unique).select("doc_id", "size", "source_size", "target", "taken").collect()
    same(got, brute_mix([(r.doc_id, r.text, r.source) for r in unique.collect()]))
    assert mixing.mixed(odd).count() == odd.count()
    assert mixing.mixed(none).collect() == []


def test_mixed_documents_are_taken_as_often(spark, docs, odd):
    m = {r.doc_id: r.epochs + r.picked for r in mixing.mixed(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: n for i, n in m.items() if n})
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_many_bins(spark, docs, monkeypatch):
    """Small bins give the same picks as large ones."""
    want = sorted(map(tuple, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "BIN_ROWS", 2)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == want


def brute_quality(i, text):
    t, ws = text or "", words(text)
    grams = Counter(zip(ws, ws[1:], ws[2:]))
    repeated = {j + k for j, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return i, len(ws), sum(map(len, ws)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(repeated), len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)


def test_op8(spark, sf, docs):
    got = queries.op8_quality(spark, sf).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(brute_quality(r.doc_id, r.text) for r in docs.collect())
    assert not any(r.base_failed and r.kept for r in got) and sum(r.kept for r in got) > len(got) / 2


def test_quality_odd_rows(odd, none):
    got = quality.with_quality(odd).collect()
    assert [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got] == [brute_quality(r.doc_id, r.text) for r in odd.collect()]
    assert quality.with_quality(none).collect() == []
    assert quality.quality_filter(odd).columns == odd.columns


def test_sql_agrees(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        res = con.execute(sql)
        order = [[d[0] for d in res.description].index(c) for c in df.columns]
        want = sorted(tuple(r[k] for k in order) for r in res.fetchall())
        for g, w in zip(sorted(map(tuple, df.collect())), want, strict=True):
            assert g == pytest.approx(w)
