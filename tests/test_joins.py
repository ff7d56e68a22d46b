from pyspark.sql import functions as F

from codeglint.operators import joins as J
from codeglint.operators import telemetry as T


def test_met_by_broadcast_and_by_blocks(spark):
    """Both ways give each pair once, repeated rows repeated."""
    left = spark.createDataFrame([(i % 37, "x" * (i % 3)) for i in range(90)], "a long, t string")
    right = spark.createDataFrame([(i % 23, None if i % 9 else "y") for i in range(60)], "b long, u string")
    near = F.abs(F.col("a") - F.col("b")) <= 2
    want = sorted((i % 37, j % 23) for i in range(90) for j in range(60) if abs(i % 37 - j % 23) <= 2)
    for rows in (1000, 7, 59, 1):
        got = J.met(left, right, near, rows)
        assert got.columns == ["a", "t", "b", "u"]
        assert sorted((r.a, r.b) for r in got.collect()) == want
    for empty in (J.met(left.limit(0), right, near, 7), J.met(left, right.limit(0), near, 7)):
        assert empty.count() == 0


def test_trend_of_a_key_over_many_ranges(spark):
    """A key's place in the whole order doesn't change its line."""
    rows = [(k, i, 0.1 * k + 0.003 * i) for k in range(4) for i in range(50)]
    got = {r.key: r for r in T.ordinary_trend(spark.createDataFrame(rows, "key long, ord long, score double"), "key").collect()}
    assert {k: (r.slope, r.intercept, r.current) for k, r in got.items()} == {k: (0.003, round(0.1 * k, 6), round(0.1 * k + 0.147, 6)) for k in range(4)}


def test_quantiles_by_ranks(spark):
    """Equal to those of the sorted values: repeated values, null keys and values, keys of few rows."""
    rows = [(k, float((i * 7919) % (5 if k == "b" else 400))) for k in ("a", "b", None) for i in range(300)] + [("few", 1.0)] * 3 + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "key string, value double")
    got = {r.key: r for r in T.ranked_quantiles(df, "key", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    each = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.collect_list("value").alias("v"))
    want = each.select("key", "n", *[F.round(T.exclusive_quantile(F.col("v"), p), 6).alias(q) for q, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]).collect()
    assert len(got) == len(want) == 5
    assert all(tuple(got[r.key]) == tuple(r) for r in want)
    assert T.ranked_quantiles(df.limit(0), "key", "value", {"p50": 0.5}).count() == 0
