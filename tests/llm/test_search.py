"""Ranked search against scoring of every document."""

import math
import random
import re
from collections import Counter

import duckdb

from codeglint.llm import registry as queries
from codeglint.llm import wavelet_search as ws

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """docs: (id, text); items: (id, text). Rows (item, rank, doc, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total, df = len(counts), sum(x[2] for x in counts), Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in counts:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return out


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_op11(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(queries.op11_search(spark, sf))
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], items), key=str)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert got == sorted(con.execute(queries.op11_sql()).fetchall(), key=str)


def test_odd_rows_and_queries(spark, odd, none):
    items = [(1, "The cat THE cat dog zebra"), (1, "hund é 1 2 3"), (2, None), (3, ""), (None, "x d"), (4, "nothing-of_these"), (5, "the quick brown fox")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS doc_id", "3 AS item")
    want = brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], items, 3)
    assert rows(ws.search(ws.build_index(odd), asked, 3)) == sorted(want, key=str)
    assert rows(ws.search(ws.build_index(none), asked, 3)) == []
    assert rows(ws.search(ws.build_index(odd), asked.limit(0), 3)) == []


def test_long_text_in_pieces(monkeypatch):
    text = ("Ab,é9 \x00x_y\n" * 500 + "z" * 300).encode()
    want = [t.encode() for t in terms(text.decode())]
    monkeypatch.setattr(ws, "PIECE", 7)
    assert [t for part in ws.term_lists(text) for t in part] == want


def test_trees_of_any_size(monkeypatch):
    """Shards of 1 to 70 documents, many of them alike, nodes opened one to five at a time, against scores of all documents."""
    draw = random.Random(5)
    for size in (1, 2, 3, 8, 9, 33, 70):
        texts = [" ".join(draw.choices("abcdefghijkl", [30, 20, 10, 5, 5, 3, 3, 2, 1, 1, 1, 1], k=draw.randrange(0, 12))) for _ in range(size)]
        texts = [texts[draw.randrange(max(1, i // 3))] if i % 2 else t for i, t in enumerate(texts)]
        shard, ids = ws.Shard(), draw.sample(range(1000), size)
        for i, t in zip(ids, texts):
            shard.add(i, t.encode())
        counts = {i: Counter(terms(t)) for i, t in zip(ids, texts)}
        n, total = sum(map(bool, counts.values())), sum(sum(c.values()) for c in counts.values())
        tree = ws.Tree(row := shard.row(n, total))
        names = row["terms"].split()
        for batch in (1, 2, 5):
            monkeypatch.setattr(ws, "BATCH", batch)
            for k in (1, 3, 10):
                import numpy as np

                own = sorted(draw.sample(range(len(names)), min(len(names), 4)))
                if not own:
                    continue
                weights = [draw.randrange(1, 9) for _ in own]
                least = draw.choice((0, 0, 50_000))
                scores, found = tree.view(np.array(own)).best(np.arange(len(own)), np.array(weights), k, least)
                m = {i: 25 + 75 * sum(c.values()) * n // total for i, c in counts.items()}
                score = {i: sum(w * (10**9 * c[names[t].decode()] // (1000 * c[names[t].decode()] + 8 * m[i])) for t, w in zip(own, weights) if names[t].decode() in c) for i, c in counts.items()}
                want = sorted((-s, i) for i, s in score.items() if s >= max(1, least))[:k]
                assert [(-s, tree.ids[d]) for s, d in zip(scores.tolist(), found.tolist())] == want


def test_norms_beyond_64_bits():
    import numpy as np

    assert ws._norms(np.array([10**9, 3]), 10**10, 10**13).tolist() == [25 + 75 * 10**19 // 10**13, 25]
