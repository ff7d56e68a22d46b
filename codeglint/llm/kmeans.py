"""Clusters around centroids, in exact integers.

Vectors become integers and are stored once in blocks of rows.  Each round assigns a block's vectors by the expansion
|x|^2 - 2 x.c + |c|^2, whose middle is one matrix product in 64-bit floats.  That product and the sums of members, a product with
the matrix of assignments, are exact as long as no partial sum can reach 2^53, whatever the order in which BLAS adds; a block
looks at its largest magnitude and otherwise computes in 64-bit integers, or in Python's where those might overflow too.
treeAggregate adds counts and sums of members over the RDD of blocks, so the driver gets one small state a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of a block.
BLOCK_ROWS = 4096
#: Sums below this are exact in 64-bit floats; those below INT_LIMIT fit 64-bit integers.
FLOAT_LIMIT, INT_LIMIT = 2**53, 2**63
#: Depth of the tree in which states meet.
DEPTH = 3
_BLOCKS = "n int, width int, ids binary, no_id binary, data binary"


class Clusters(NamedTuple):
    """Final centroids, their members and the sums of their squared distances."""

    centroids: list[list[int]]
    counts: list[int]
    inertia: list[int]


def integer_vectors(batches, dimensions: int, scale: int) -> Iterator[dict]:
    """Blocks of the vectors with exactly so many components, none null or not finite, each turned into floor(scale * x)."""
    import numpy as np

    for b in slices(batches, BLOCK_ROWS):
        ids, vectors = b.column(0).to_pylist(), b.column(1)
        whole = np.flatnonzero(np.array([v.is_valid and len(v) == dimensions for v in vectors], bool))
        if not len(whole):
            continue
        kept = vectors.take(_indices(whole))
        x = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)  # null becomes nan
        fine = np.isfinite(x).all(1)
        x, ids = x[fine], [ids[i] for i, f in zip(whole.tolist(), fine.tolist(), strict=True) if f]
        if len(ids):
            yield _block(ids, _floors(x, scale))


def _indices(places):
    import pyarrow as pa

    return pa.array(places)


def _floors(x, scale: int):
    """floor(scale * x) in 64-bit integers, or Python's if one doesn't fit. The product is one in doubles, beyond their range exact."""
    import numpy as np

    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not len(y) or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([[int(v) if np.isfinite(v) else int(u) * scale for u, v in zip(us, vs, strict=True)] for us, vs in zip(x.tolist(), y.tolist(), strict=True)], object)


def _block(ids: list, x) -> dict:
    import numpy as np

    most = max(int(x.max()), -int(x.min()) - 1)
    kind = next((t for t in ("i2", "i4", "i8") if most < 1 << (8 * int(t[1]) - 1)), None)
    data = x.astype(kind).tobytes() if kind else "\n".join(" ".join(map(str, r)) for r in x.tolist()).encode()
    none = np.array([i is None for i in ids], bool)
    return {"n": len(ids), "width": int(kind[1]) if kind else 0, "ids": np.array([0 if i is None else i for i in ids], np.int64).tobytes(), "no_id": none.tobytes(), "data": data}


def block_vectors(width: int, data: bytes, n: int):
    """A block's vectors: 64-bit integers, or Python's where its data is text (width 0)."""
    import numpy as np

    if width:
        return np.frombuffer(data, f"i{width}").astype(np.int64).reshape(n, -1)
    return np.array([[int(v) for v in r.split()] for r in data.decode().split("\n")], object)


def nearest(x, centroids: list[list[int]], float_limit: int = FLOAT_LIMIT, int_limit: int = INT_LIMIT):
    """The nearest centroid of each row of x, the smaller number at ties, and the squared distance, all exact."""
    import numpy as np

    width = x.shape[1]
    most = lambda m: max((abs(int(m.max())), abs(int(m.min()))), default=0) if m.size else 0
    c = np.array(centroids, object)
    bound = width * (most(x) + most(c)) ** 2  # no term and no partial sum of the expansion is larger
    if bound < float_limit:
        x, c = x.astype(np.float64), c.astype(np.float64)
        d = np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)
    else:
        kind = np.int64 if bound < int_limit else object
        x, c = x.astype(kind), c.astype(kind)
        d = (x * x).sum(1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(1)
    own = np.argmin(d, 1)
    return own, d[np.arange(len(own)), own].astype(np.int64 if bound < int_limit else object)


def members(x, own, k: int, float_limit: int = FLOAT_LIMIT, int_limit: int = INT_LIMIT) -> tuple[list[int], list[list[int]]]:
    """How many rows each of k clusters has, and their sums, exact."""
    import numpy as np

    bound = len(x) * max(abs(int(x.max())), abs(int(x.min())))
    kind = np.float64 if bound < float_limit else np.int64 if bound < int_limit else object
    of = (own[None, :] == np.arange(k)[:, None]).astype(kind)
    return np.bincount(own, minlength=k).tolist(), [[int(v) for v in row] for row in of.dot(x.astype(kind))]


def first_centroids(vectors: DataFrame, k: int, seed: int, dimensions: int, scale: int) -> list[list[int]]:
    """The vectors of the k smallest sha256 of "<seed>:<id>" in that order; equal ids by their components, a null id counts as "null"."""
    import numpy as np

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    rows = vectors.select("v", F.sha2(name.cast("binary"), 256).alias("h")).orderBy("h", "v").limit(k).collect()
    return [[int(c) for c in _floors(np.array([r["v"]], np.float64), scale)[0]] for r in rows]


def moved(centroids: list[list[int]], counts: list[int], sums: list[list[int]]) -> list[list[int]]:
    """Each centroid with members becomes the floor of their mean; the others stay."""
    return [[s // n for s in total] if n else old for old, n, total in zip(centroids, counts, sums, strict=True)]


def _blocks_of(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    def pack(batches):
        import pyarrow as pa

        kinds = {"n": pa.int32(), "width": pa.int32(), "ids": pa.binary(), "no_id": pa.binary(), "data": pa.binary()}
        for block in integer_vectors(batches, dimensions, scale):
            yield pa.RecordBatch.from_pylist([block], pa.schema(kinds))

    return stored(vectors.select("id", "v").mapInArrow(pack, _BLOCKS), "kmeans-blocks")


def _totals(blocks: DataFrame, centroids: list[list[int]], of) -> list:
    """Per cluster what of(vectors, own, distances) gives for a block, lists of integers, added up over all blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def seen(state, row):
        x = block_vectors(row.width, row.data, row.n)
        return added(state, of(x, *nearest(x, sent.value)))

    def added(a, b):
        return b if a is None else a if b is None else [[u + v for u, v in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]

    return blocks.select("n", "width", "data").rdd.treeAggregate(None, seen, added, DEPTH)


def _with_counts(k: int):
    def of(x, own, distances):
        counts, sums = members(x, own, k)
        return [[n, *total] for n, total in zip(counts, sums, strict=True)]

    return of


def _with_inertia(k: int):
    def of(x, own, distances):
        out = [[0, 0] for _ in range(k)]
        for c, d in zip(own.tolist(), distances.tolist(), strict=True):
            out[c][0] += 1
            out[c][1] += d
        return out

    return of


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, Clusters]:
    """(vec_id, cluster, distance) of all vectors, and the clusters, after so many rounds and a last assignment.

    Vectors that are null, of another number of components, or with one null or not finite are left out; with fewer than k others
    there are as many clusters as these, with none no rows.  Rows of one id, or of none, are vectors of their own; other columns
    are left aside.  distance is null where the square doesn't fit a long.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    centroids = first_centroids(rows.filter((F.size("v") == dimensions) & fine), k, seed, dimensions, scale)
    blocks = _blocks_of(rows, dimensions, scale)
    if not centroids:
        return blocks.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), Clusters([], [], [])
    for _ in range(rounds):
        state = _totals(blocks, centroids, _with_counts(len(centroids)))
        centroids = moved(centroids, [s[0] for s in state], [s[1:] for s in state])
    last = _totals(blocks, centroids, _with_inertia(len(centroids)))
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for n, width, ids, no_id, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                own, distances = nearest(block_vectors(width, data, n), sent.value)
                whole = [d if d < INT_LIMIT else None for d in distances.tolist()]
                columns = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(no_id, bool)), pa.array(own.astype(np.int32)), pa.array(whole, pa.int64())
                yield pa.RecordBatch.from_arrays(list(columns), names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), Clusters(centroids, [s[0] for s in last], [s[1] for s in last])


def cluster_digests(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; settings and cases as for clustered(), and an inertia
    that doesn't fit a long is null."""
    rows, of = clustered(vectors, **settings)
    fitting = lambda n: n if n < INT_LIMIT else None
    table = [(i, fitting(s), fitting(sum(of.inertia)), centroid_digest(c)) for i, (c, s) in enumerate(zip(of.centroids, of.inertia, strict=True))]
    side = rows.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
