"""Tasks, retrieval and validation beside the registered queries."""

from pyspark.sql import functions as F

from codeglint.operators import retrieval as R
from codeglint.operators import tasks as K
from codeglint.operators import validation as V


def test_schedules(spark):
    t = spark.createDataFrame([("a", 2, 1.0), ("b", 1, 2.0), ("c", 1, 3.0)], "task_id string, priority int, seconds double")
    d = spark.createDataFrame([("a", "b")], "src string, dst string")
    order = lambda s: [r.task_id for r in K.schedule(t, d, s).orderBy("position").collect()]
    assert order("priority") == ["b", "c", "a"] and order("dependency") == ["c", "a", "b"] and order("duration") == ["c", "b", "a"] and order("hybrid") == ["c", "a", "b"]
    done = spark.createDataFrame([("c",)], "task_id string")
    assert [r.task_id for r in K.ready_tasks(t, d, done).collect()] == ["a"]


def test_small_operators(spark):
    e = spark.createDataFrame([("x", 1, 9, 3, 5), ("y", 2, 4, 1, 1), ("z", 3, 5, 1, 99)], "entry string, created int, used int, hits int, ttl int")
    first = {p: K.eviction_order(e, p).filter("position = 1").first().entry for p in ("lru", "lfu", "ttl", "fifo")}
    assert first == {"lru": "y", "lfu": "y", "ttl": "y", "fifo": "x"}
    r = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "task string, agent string")
    g = spark.createDataFrame([("t", ["a", "b"]), ("u", ["a", "b"])], "task string, agents array<string>")
    assert [x.task for x in K.completed_tasks(r, g).collect()] == ["t"]
    s = K.execution_statistics(spark.createDataFrame([("done", 1, 2.0), ("failed", 1, 1.0), ("done", 2, 1.0)], "status string, worker int, seconds double")).first()
    assert (s.n, s.done, s.workers, s.balance) == (3, 2, 2, 0.8)


def test_nearest_in_blocks(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "vec_id long, embedding array<float>").repartition(3)
    q = v.filter("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    got = {(a.query_id, a.rank): a.vec_id for a in R.nearest(v, q, 4).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for i in range(7):
        assert [got[i, k] for k in range(1, 5)] == np.lexsort((np.arange(60), -np.round(unit @ unit[i], 9)))[:4].tolist()
    assert R.nearest(v, q.limit(0), 4).count() == 0
    one = v.join(q.select(F.col("embedding").alias("e")).limit(1)).select(R.cosine(F.col("embedding"), F.col("e")).alias("c"), R.squared_distance(F.col("embedding"), F.col("e")).alias("d"))
    assert all(-1.000001 <= a.c <= 1.000001 and a.d >= 0 for a in one.collect())


def test_structure_and_fan_in(spark):
    p = spark.createDataFrame([("f(a)", "g(b)"), ("x", "")], "a string, b string")
    assert [r.structure for r in R.with_structure_ratio(p, "a", "b").collect()] == [1.0, 0.0]
    f = spark.createDataFrame([("1", "xss"), ("2", "none")], "id string, type string")
    one = lambda c, v: spark.createDataFrame([("xss", v)], f"type string, {c} string")
    got = {r.id: r for r in R.knowledge_fan_in(f, one("cve_id", "c"), one("practice_id", "p"), one("case_id", "h")).collect()}
    assert got["1"].suggestions == ["p", "h"] and got["1"].cves_relevance == 0.9 and len(got["2"].suggestions) == 3 and got["2"].cves == []
    d = R.deduplicated(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n int"), "k", [F.desc("n")], spark.createDataFrame([("b",)], "k string"))
    assert [tuple(r) for r in d.collect()] == [("a", 2)]


def test_validation_factors(spark):
    x = lambda c: spark.range(1).select(c.alias("x")).first().x
    full = [F.lit(v) for v in (5, 2, 1, 1, 1, 2, 0.5, 3)]
    assert 0.8 < x(V.context_completeness(*full, F.lit(True), F.lit(1.0))) <= 1.0
    assert x(V.knowledge_relevance(*[F.lit(v) for v in (3, 3, 2, 2, 1, 0.5)])) == 0.85
    assert x(V.cross_validation(F.lit(True), F.lit(0), F.lit(0.9), F.lit(0.1))) == 0.5
    assert x(V.validation_status(F.lit(0.85), F.lit(True))) == "validated" and x(V.validation_status(F.lit(0.6), F.lit(False))) == "needs_review"
    assert abs(x(V.window_completeness(F.lit(10), F.lit(5), F.lit(0.5))) - 0.85) < 1e-9
