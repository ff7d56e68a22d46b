"""Centroid clusters against Python's integers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from codeglint.llm import kmeans
from codeglint.llm import registry as queries


def brute(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda j: (hashlib.sha256(f"3:{'null' if kept[j][0] is None else kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    centroids = [kept[j][1] for j in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds if centroids else 0):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if members := [v for (_, v), c in zip(kept, own) if c == j]:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [near(v) for _, v in kept]
    inertia = [sum(d for d, c in last if c == j) for j in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda n: n if n < 2**63 else None
    return sorted(((i, c, fit(d), fit(inertia[c]), fit(sum(inertia)), digests[c]) for (i, _), (d, c) in zip(kept, last)), key=str)


def rows(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_op12(spark, sf):
    got = rows(queries.op12_clusters(spark, sf))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.op12_sql()).fetchall(), key=str)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()])


KIND = "vec_id long, embedding array<double>, cluster int, distance int, id int, v int"


@pytest.mark.parametrize("scale", [1.0, 1e8, 1e13, 1e200])
def test_odd_vectors(spark, scale):
    draw = random.Random(int(math.log10(scale)))
    many = [(i, [draw.uniform(-1, 1) * scale for _ in range(3)]) for i in range(40)]
    odd = [(7, many[7][1]), (None, many[3][1]), (None, [0.0, -0.0, 1.0]), (50, None), (51, [1.0, 2.0]), (52, [1.0, 2.0, 3.0, 4.0]), (53, [1.0, None, 1.0]), (54, [1.0, math.nan, 1.0]), (55, [math.inf, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in many + odd + odd[:1] * 20], KIND)
    assert rows(kmeans.cluster_digests(df, dimensions=3)) == brute(many + odd + odd[:1] * 20, width=3)


def test_few_vectors_and_none(spark):
    three = [(i, [float(i), 1.0, 2.0]) for i in range(3)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in three], KIND)
    assert rows(kmeans.cluster_digests(df, dimensions=3)) == brute(three, width=3)
    assert rows(kmeans.cluster_digests(df.limit(0), dimensions=3)) == []
    assert rows(kmeans.cluster_digests(df, dimensions=4)) == []


def test_beyond_floats():
    """The same distances and sums by floats, by 64-bit integers, and by Python's."""
    x = np.array([[draw for draw in random.Random(i).choices(range(-900, 900), k=5)] for i in range(50)], np.int64)
    c = x[:4].tolist()
    want = [kmeans.nearest(x, c, *limits) for limits in ((2**53, 2**63), (0, 2**63), (0, 0))]
    assert all((w[0] == want[0][0]).all() and (w[1] == want[0][1]).all() for w in want)
    sums = [kmeans.members(x, want[0][0], 4, *limits) for limits in ((2**53, 2**63), (0, 2**63), (0, 0))]
    assert sums[0] == sums[1] == sums[2]
    big = np.array([[2**40, 3], [2**40 + 1, 5]], np.int64)
    own, d = kmeans.nearest(big, [[2**40, 5], [0, 0]])
    assert own.tolist() == [0, 0] and d.tolist() == [4, 1]
