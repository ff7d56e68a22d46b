"""Substring search by grams against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from codeglint.operators import postings as P

TEXTS = [(1, "The Quick fox"), (2, "quick"), (2, "slow"), (3, ""), (4, None), (None, "A quick null"), (5, "aaaa"), (6, "naïve 😀 Ünïcode"), (7, "x"), (7, "x")]
QUERIES = [("a", "QUICK"), ("b", "quick f"), ("c", ""), ("d", None), ("e", "aa"), ("f", "x"), ("g", "nothing"), ("h", "😀 ü"), ("i", "😀"), (None, "slow"), ("a", "slow")]


def compared(queries, texts):
    return {(q, t) for q, a in queries for t, b in texts if a and b and a.lower() in b.lower()}


def found(spark, queries, texts):
    got = [tuple(r) for r in P.containing(spark.createDataFrame([(*q, 1) for q in queries], "query_id string, query string, gram int"), spark.createDataFrame([(*t, 1) for t in texts], "text_id long, text string, _id int")).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("rows", [100_000, 0])
def test_equals_all_pairs(spark, monkeypatch, rows):
    """With few queries, and with more than may be broadcast."""
    monkeypatch.setattr(P, "RULE_ROWS", rows)
    assert found(spark, QUERIES, TEXTS) == compared(QUERIES, TEXTS)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abC ") for _ in range(n))
    texts, queries = [(i, word(rng.randrange(0, 60))) for i in range(150)], [(str(i), word(rng.randrange(0, 7))) for i in range(60)]
    assert found(spark, queries, texts) == compared(queries, texts)


def test_empty(spark):
    assert found(spark, [], TEXTS) == found(spark, QUERIES, []) == found(spark, [("a", "")], TEXTS) == set()


def test_a_long_text(spark):
    text = "ab" * 300_000 + "needle" + "ba" * 300_000
    assert found(spark, [("n", "needle"), ("m", "needles"), ("a", "abab")], [(1, text), (2, "abab")]) == {("n", 1), ("a", 1), ("a", 2)}


@pytest.mark.parametrize("rows", [100_000, 0])
def test_a_text_of_many_ids_is_searched_once(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "RULE_ROWS", rows)
    queries = spark.createDataFrame([(str(i), ("one", "TWO", "twelve")[i % 3]) for i in range(60)], "query_id string, query string")
    texts = spark.createDataFrame([(i, [f"CVE-{i}", ("a one", None, "two one", "tw")[i % 4]]) for i in range(40)], "text_id long, texts array<string>")
    asked = P._asked(queries)
    got = sorted(tuple(r) for r in P.holding(asked, texts).collect())
    assert got == sorted([("one", i) for i in range(40) if i % 4 in (0, 2)] + [("two", i) for i in range(40) if i % 4 == 2])
    sources = spark.createDataFrame([(i % 3 + 1, f"C{i}", ("a one", "two one")[i % 2], None) for i in range(90)], "source int, cve_id string, description string, published date")
    found = P.keyword_search(queries, sources).groupBy("query_id").agg(F.array_sort(F.collect_list("cve_id")).alias("ids")).collect()
    assert len(found) == 40 and len({(int(r.query_id) % 3, tuple(r.ids)) for r in found}) == 2 and all(len(r.ids) == 10 for r in found)
