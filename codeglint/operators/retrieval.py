"""Retrieval: nearest vectors, rules and cases that fit code, fan-in of knowledge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from .joins import met, small

#: Queries and vectors of a block, and vectors that a task compares at once.
QUERY_BLOCK, VECTOR_BLOCK, TILE = 1024, 32_768, 2048


def _numbers(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(_numbers(x), _numbers(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_numbers(a), _numbers(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, by: str = "cosine") -> DataFrame:
    """(query_id, vec_id, similarity, rank): exact top k of vectors (vec_id, embedding) for each query (query_id, embedding).

    Blocks of QUERY_BLOCK queries meet blocks of VECTOR_BLOCK vectors, each pair of blocks in one task, which passes on k rows a
    query: nothing goes to the driver, and what a task holds doesn't grow with either table.
    by: cosine, or l2 for 1 - squared distance / 100, not below 0.
    """
    import numpy as np

    n_queries, n_vectors = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (vectors, VECTOR_BLOCK)))
    q = queries.select("query_id", F.col("embedding").alias("q"), F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).alias("qb"))
    q = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_vectors - 1)).cast("array<bigint>")))
    v = vectors.select("vec_id", F.col("embedding").alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(n_vectors)).alias("vb"))
    v = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)).cast("array<bigint>")))
    names = ["query_id", "vec_id", "similarity"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in names})
        right = right.sort_values("vec_id")  # so that ties go by place
        a, ids = np.array(left.q.tolist(), np.float64), right.vec_id.to_numpy()
        own, best = np.linalg.norm(a, axis=1), [np.empty((0, 2))] * len(left)
        for at in range(0, len(right), TILE):
            b = np.array(right.v.iloc[at : at + TILE].tolist(), np.float64)
            place = np.arange(at, at + len(b), dtype=np.float64)
            dot, length = a @ b.T, np.linalg.norm(b, axis=1)
            if by == "cosine":
                scale = own[:, None] * length[None, :]
                score = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
            else:
                score = np.maximum(0.0, 1 - (own[:, None] ** 2 + length[None, :] ** 2 - 2 * dot) / 100)
            score = np.round(score, 9)
            for i in range(len(left)):
                both = np.concatenate([best[i], np.stack([score[i], place], axis=1)])
                best[i] = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
        rows = np.concatenate([np.column_stack([np.full(len(x), i), x[:, 1], x[:, 0]]) for i, x in enumerate(best)])
        return pd.DataFrame({"query_id": left.query_id.to_numpy()[rows[:, 0].astype(int)], "vec_id": ids[rows[:, 1].astype(int)], "similarity": rows[:, 2]})

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(search, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def practice_matches(files: DataFrame, text_col: str = "content", language_col: str = "language") -> DataFrame:
    """Files with each practice rule of their language, or a general one, whose pattern their code matches.

    A projection over the rule table, compiled to expressions: long patterns and own-language rules count for more, up to 1.
    """
    found = []
    for name, language, kind, severity, confidence, pattern in rules.PRACTICE_RULES:
        meant = F.lit(True) if language == "general" else F.col(language_col) == language
        score = min(1.0, confidence * (1.1 if len(pattern) > 50 else 1.0) * (1.2 if language != "general" else 1.0))
        hit = F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(round(score, 6)).alias("score"))
        found.append(F.when(meant & F.regexp_like(F.col(text_col), F.lit("(?im)" + pattern)), hit))
    return files.withColumn("m", F.explode(F.array_compact(F.array(*found)))).select(*[c for c in files.columns if c != text_col], "m.*")


def similar_cases(snippets: DataFrame, cases: DataFrame, threshold: float = 0.3, k: int = 10, by: str = "code", language: str = "python") -> DataFrame:
    """(id, case_id, similarity, rank): cases of the snippet's type by code similarity (by: code) or token similarity, the best k.

    snippets: id, type, code; cases: case_id, type, code.  Types join by equality, and where a type has no case, by one type
    holding the other.  Equal snippets of a type are compared once, and types are matched before their rows are.
    """
    kinds = snippets.select("type", "code").distinct()
    own, known = kinds.select("type").distinct(), cases.select(F.col("type").alias("c_type")).distinct()
    exact = own.join(known, F.col("type") == F.col("c_type"))
    holds = F.contains(F.col("type"), F.col("c_type")) | F.contains(F.col("c_type"), F.col("type"))
    types = exact.unionByName(met(own.join(exact.select("type"), "type", "left_anti"), known, holds))
    c = cases.select("case_id", F.col("type").alias("c_type"), F.col("code").alias("c_code"))
    pairs = kinds.join(small(types), "type").join(small(c), "c_type")
    if by == "code":
        a, b = (X.normal_code(F.col(x), F.lit(language)) for x in ("code", "c_code"))
        pairs = with_structure_ratio(pairs.withColumns({"_a": a, "_b": b}), "_a", "_b")
        score = X.code_similarity(F.col("code"), F.col("c_code"), F.lit(language), F.col("structure"))
    else:
        score = X.token_similarity(F.col("code"), F.col("c_code"))
    near = pairs.withColumn("similarity", F.round(score, 6)).filter(F.col("similarity") >= threshold)
    rank = F.row_number().over(Window.partitionBy("type", "code").orderBy(F.desc("similarity"), "case_id"))
    near = near.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("type", "code", "case_id", "similarity", "rank")
    return snippets.join(near, ["type", "code"]).select("id", "case_id", "similarity", "rank")


def structure_ratio(a: str, b: str) -> float:
    """Ratio of matching blocks of two codes' shapes, words being X."""
    import difflib
    import re

    return difflib.SequenceMatcher(None, re.sub(r"\w+", "X", a), re.sub(r"\w+", "X", b)).ratio()


def with_structure_ratio(pairs: DataFrame, a: str, b: str, out: str = "structure") -> DataFrame:
    """pairs with the structure ratio of two columns; block matching has no expression, so it runs on Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([structure_ratio(p or "", q or "") for p, q in zip(x, y)])

    return pairs.withColumn(out, ratio(F.col(a), F.col(b)))


def knowledge_fan_in(findings: DataFrame, cves: DataFrame, practices: DataFrame, cases: DataFrame) -> DataFrame:
    """Findings with arrays of CVE ids, practice ids and case ids of their type, and the relevance of what they have.

    Each source is grouped by type before the join, so a finding isn't multiplied.
    """
    out = findings
    for name, table, column, relevance in (("cves", cves, "cve_id", 0.9), ("practices", practices, "practice_id", 0.8), ("cases", cases, "case_id", 0.7)):
        grouped = table.groupBy("type").agg(F.array_sort(F.collect_set(column)).alias(name))
        out = out.join(grouped, "type", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).withColumn(f"{name}_relevance", F.when(F.size(name) > 0, F.lit(relevance)).otherwise(F.lit(0.0)))
    suggestions = F.concat(F.slice("practices", 1, 3), F.slice("cases", 1, 2))
    default = F.array(F.lit("validate input"), F.lit("apply least privilege"), F.lit("review the code"))
    return out.withColumn("suggestions", F.when(F.size(suggestions) > 0, suggestions).otherwise(default))


def deduplicated(table: DataFrame, key: str, order: list[Column], existing: DataFrame | None = None) -> DataFrame:
    """The first row of each key in an order, without keys that exist already."""
    first = table.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")
    return first if existing is None else first.join(existing.select(key).distinct(), key, "left_anti")


def hash_embedding(text: str, dim: int = 64) -> list[float]:
    """A unit vector that the md5 of a text seeds: equal texts have equal vectors, unlike ones nothing in common."""
    import hashlib

    import numpy as np

    v = np.random.default_rng(int(hashlib.md5(text.encode()).hexdigest()[:8], 16)).normal(size=dim)
    return (v / np.linalg.norm(v)).astype(np.float32).tolist()


def indexed(units: DataFrame, index: DataFrame | None = None, dim: int = 64, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(chunk_id, unit, pos, embedding): chunks of the texts of units (unit, text) that an index doesn't have yet.

    A unit whose chunks are in the index is skipped; chunks are named by unit and place, so indexing again adds nothing.
    """
    new = units.select("unit", "text")
    if index is not None:
        new = new.join(index.select("unit").distinct(), "unit", "left_anti")
    chunks = new.select("unit", F.posexplode(X.char_chunks(F.col("text"), size, overlap)).alias("pos", "chunk"))

    @F.pandas_udf("array<float>")
    def embed(x: pd.Series) -> pd.Series:
        return x.map(lambda t: hash_embedding(t, dim))

    return chunks.select(F.concat_ws("#", F.col("unit").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "unit", "pos", F.length("chunk").alias("size"), embed("chunk").alias("embedding"))


def paired(findings: DataFrame, contexts: DataFrame, knowledge: DataFrame) -> DataFrame:
    """findings with their context and knowledge, joined by id; findings without one keep nulls."""
    return findings.join(contexts, "id", "left").join(knowledge, "id", "left")
