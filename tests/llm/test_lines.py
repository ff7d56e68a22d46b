"""Shared lines against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from codeglint.llm import line_dedup
from codeglint.llm import registry as queries

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs=10, min_chars=1):
    """(id, lines, dropped, digest) of rows (id, text)."""
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    shared = {k for k, n in seen.items() if n >= min_docs and len(k) >= max(1, min_chars)}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if key(x) not in shared]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def test_op13(spark, sf, docs):
    rows = got(queries.op13_line_dedup(spark, sf))
    assert rows == brute([(r.doc_id, r.text) for r in docs.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert rows == sorted(con.execute(queries.op13_sql()).fetchall(), key=str)


def made(draw, n):
    bits = ["Alpha", " alpha\t", "ALPHA", "", " ", "é É", "É é", "İ", "beta\r", "beta", "x", "x\x0b", "long " * 30, "\x1c", "c", "d"]
    rows = [(draw.choice((None, 1, 2, i, i, i)), "\n".join(draw.choices(bits, k=draw.randrange(0, 9)))) for i in range(n)]
    return rows + [(None, None), (5, ""), (5, "\n"), (9, "\n".join(["alpha"] * 500 + ["own"] + ["beta"] * 300))] + [(None, "alpha\nsame")] * 30 + [(3, "c\nsame\nc")] * 20


CLASH = ("_id", "_a", "_b", "_dropped", "n_lines", "kept_text", "_hash", "_pos", "dropped", "pos", "at")


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (1, 1), (3, 5), (60, 0)])
def test_odd_rows(spark, min_docs, min_chars):
    rows = made(random.Random(min_docs), 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH])
    assert got(line_dedup.line_digests(df, min_docs=min_docs, min_chars=min_chars)) == brute(rows, min_docs, min_chars)
    out = line_dedup.without_shared_lines(df, min_docs=min_docs)
    assert {c: n for c, n in Counter(out.columns).items() if n > 1} == {} and set(df.columns) <= set(out.columns)


def test_empty_table_and_odd_documents(spark, none, odd):
    assert got(line_dedup.line_digests(none)) == []
    assert got(line_dedup.line_digests(odd, min_docs=2)) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 2)


def test_first_occurrence_stays(spark):
    rows = [(i, f"head\nown {i}\nHead \nfoot") for i in range(12)] + [(None, "head")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept_text for r in line_dedup.without_shared_lines(df, keep_first=True).collect()}
    assert kept[0] == "head\nown 0\nfoot" and kept[None] == "" and all(kept[i] == f"own {i}" for i in range(1, 12))


def test_runs_of_a_bitmap(spark):
    df = spark.createDataFrame([([0],), ([2, 3, 4, 9],), ([0, 1, 5],)], "at array<int>")
    runs = [[tuple(r) for r in x[0]] for x in df.select(line_dedup.runs(df["at"])).collect()]
    assert runs == [[(0, 1)], [(2, 3), (9, 1)], [(0, 2), (5, 1)]]
