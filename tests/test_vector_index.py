"""The vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeglint.operators import retrieval as R
from codeglint.operators import vector_index as V
from codeglint.storage import new_path


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.similarity) for r in df.collect())


def test_recall_and_all_cells(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    path, exact = new_path(spark, "index"), R.nearest(v, q, 10)
    V.build(v, path)
    assert V.recall(V.search(spark, path, q, 10), exact) >= 0.9
    assert rows(V.search(spark, path, q, 10, V.MOST_CELLS)) == rows(exact)
    postings = sorted(spark.read.parquet(f"{path}/postings").collect(), key=lambda r: r.offset)
    ids = [np.frombuffer(r.ids, np.int64).tolist() for r in postings]
    assert [r.offset for r in postings] == [sum(map(len, ids[:i])) for i in range(len(ids))] and sorted(sum(ids, [])) == sorted(r.vec_id for r in v.select("vec_id").collect())
    assert {r.cell: r.n for r in spark.read.parquet(f"{path}/cells").collect() if r.n} == {c: sum(len(i) for i, r in zip(ids, postings) if r.cell == c) for c in {r.cell for r in postings}}


@pytest.mark.parametrize("posting,block", [(3, 2), (2048, 512)])
def test_odd_vectors(spark, monkeypatch, posting, block):
    """Blocks of any size; copies, zeros, nulls, other dimensions and no vectors at all."""
    monkeypatch.setattr(V, "POSTING", posting)
    monkeypatch.setattr(V, "QUERY_BLOCK", block)
    draw = np.random.default_rng(2)
    good = [(i, draw.normal(size=4).tolist()) for i in range(30)] + [(100 + i, [1.0, 2.0, 0.0, 0.5]) for i in range(25)] + [(200, [0.0] * 4), (7, [9.0, 1.0, 1.0, 1.0])]
    bad = [(300, None), (301, [1.0]), (302, [1.0, None, 2.0, 3.0]), (303, [float("nan")] * 4), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v) for i, v in good if i < 12] + [(100, [1.0, 2.0, 0.0, 0.5]), (500, [0.0] * 4)], "query_id long, embedding array<double>").dropDuplicates(["query_id"])
    path = new_path(spark, "index")
    V.build(df, path)
    want = R.nearest(spark.createDataFrame(good, "vec_id long, embedding array<double>"), q, 5)
    assert rows(V.search(spark, path, q, 5, 1000)) == rows(want)
    none = new_path(spark, "index")
    V.build(df.limit(0), none)
    assert V.search(spark, none, q, 5).collect() == []
