"""Patterns learned from feedback: upserts, replays, restarts, expiry."""

import datetime

from pyspark.sql import functions as F

from codeglint.streaming import learning as L

FEEDBACK = "finding_id long, finding_type string, snippet string, is_false_positive boolean, confidence double, at timestamp, pattern string"
T0 = datetime.datetime(2024, 1, 1)


def rows(spark, *many):
    return spark.createDataFrame([(*r, "clash") for r in many], FEEDBACK)


def at(days):
    return T0 + datetime.timedelta(days=days)


def of(df):
    return {(r.finding_type, r.pattern): (r.confidence, r.created, r.last_finding, r.feedbacks) for r in df.collect()}


def test_upserts_and_replays(spark, tmp_path):
    table = L.PatternTable(spark, str(tmp_path / "t"))
    assert table.read().count() == 0
    table.upsert(rows(spark, (1, "XSS", "show(a, 1)", True, 0.7, at(0)), (2, "xss", "show(b, 22)", True, None, at(0)), (3, "xss", "other", False, 0.9, at(0))), 0)
    first = of(table.read())
    key = ("xss", r"\w+\(\w+, \d+\)")
    assert first == {key: (0.6, at(0), "2", 2)}
    second = rows(spark, (9, "xss", "show(q, 3)", True, 0.8, at(5)), (8, "sql", "", True, 0.5, at(5)), (7, None, "x", True, 0.5, at(5)), (6, "xss", None, True, 0.5, at(5)), (5, "xss", "x", True, 0.5, None))
    for _ in range(2):  # a batch that runs again changes nothing
        table.upsert(second, 1)
        assert of(table.read()) == {key: (0.8, at(5), "9", 3), ("sql", ""): (0.5, at(5), "8", 1)}
    table.upsert(rows(spark, (1, "xss", "show(q, 3)", True, 0.1, at(2))), 2)
    assert of(table.read())[key] == (0.8, at(5), "9", 4) and table.versions() == [1, 2]  # late feedback counts, but renews nothing
    table.upsert(rows(spark), 3)
    assert len(of(table.read())) == 2


def test_unfinished_versions_are_not_read(spark, tmp_path):
    table = L.PatternTable(spark, str(tmp_path / "t"))
    table.upsert(rows(spark, (1, "xss", "a", True, 0.7, at(0))), 0)
    (tmp_path / "t" / "v1").mkdir()
    assert table.versions() == [0] and table.read().count() == 1


def test_restarted_stream(spark, tmp_path):
    path, source, check = (str(tmp_path / n) for n in ("t", "in", "c"))
    for i in range(3):
        rows(spark, (i, "xss", f"show({i})", True, 0.5 + i / 10, at(i))).coalesce(1).write.mode("append").parquet(source)
        q = L.learning(spark.readStream.schema(FEEDBACK).parquet(source), path, check)
        q.awaitTermination(120)
        assert q.exception() is None
        assert of(L.PatternTable(spark, path).read()) == {("xss", r"\w+\(\d+\)"): (0.5 + i / 10, at(i), str(i), i + 1)}


def test_expiry(spark):
    p = L.learned(rows(spark, (1, "xss", "a", True, 0.7, at(0)), (2, "sql", "a", True, 0.7, at(1))))
    kept = lambda days, hours=0: {r.finding_type for r in L.unexpired(p, F.lit(at(days) + datetime.timedelta(hours=hours))).collect()}
    assert kept(90) == {"xss", "sql"} == kept(90, 23) and kept(91) == {"sql"} and kept(92) == set()
