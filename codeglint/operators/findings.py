"""Operators over findings: detection by patterns, reports, similarity, clusters, consensus, integration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scoring as S
from ..storage import stored

REACHED = 0.6
#: Findings of a block, the first in order, among which representatives are elected in a round.
LEADERS = 256
#: Representatives of a round that are broadcast at most.
BROADCAST_LEADERS = 100_000


def pattern_findings(files: DataFrame, lexicon: Mapping[str, str], text_col: str = "content") -> DataFrame:
    """Files exploded to one row for each type whose pattern matches: a projection, no join."""
    hits = F.array_compact(F.array(*[F.when(F.regexp_like(F.col(text_col), F.lit(f"(?i){p}")), F.lit(t)) for t, p in lexicon.items()]))
    return files.withColumn("type", F.explode(hits)).drop(text_col)


def counts_by_each(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by each column alone, in one pass of grouping sets; the others are null."""
    sets = [[F.col(c)] for c in columns]
    return df.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"))


def severity_heatmap(findings: DataFrame, limit: int) -> DataFrame:
    """Files by severity counts, the hottest first."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITY_RANK]
    heat = F.sum(S.lookup(F.col("severity"), rules.HEAT_WEIGHTS, 1)).cast("long").alias("heat")
    return findings.groupBy("file_path").agg(*counts, heat).orderBy(F.desc("heat"), "file_path").limit(limit)


def top_with_other(df: DataFrame, column: str, k: int, other: str = "other") -> DataFrame:
    """Counts of the k most frequent values; the rest together.  The k rows are found by partial top k and broadcast."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), column).limit(k).select(F.col(column).alias("_top"), F.lit(True).alias("_in"))
    labelled = counts.join(F.broadcast(top), F.col(column).eqNullSafe(F.col("_top")), "left")
    return labelled.groupBy(F.when(F.col("_in"), F.col(column)).otherwise(F.lit(other)).alias("label")).agg(F.sum("n").alias("n"))


def risk_by(findings: DataFrame, column: str) -> DataFrame:
    """Twice the weighted severities, at most 100."""
    total = F.sum(S.lookup(F.col("severity"), rules.RISK_WEIGHTS, 0.1))
    return findings.groupBy(column).agg(F.round(F.least(F.lit(100.0), 2 * total), 6).alias("risk_score"), F.count(F.lit(1)).alias("n"))


def similar_pairs(findings: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    """Pairs of a block (a shared key) whose similarity reaches the threshold; each pair once, by id.

    Word and token sets are made once a finding, before the join.
    """
    names = {"type": "type", "path": "file_path", "line": "start_line", "words": "words", "tokens": "tokens", "severity": "severity"}
    findings = findings.withColumns({"words": S.word_set(F.col("description")), "tokens": S.code_tokens(F.col("snippet"))})
    a = findings.select(*block, *[F.col(c).alias(f"a_{c}") for c in ["id", *names.values()]])
    b = findings.select(*block, *[F.col(c).alias(f"b_{c}") for c in ["id", *names.values()]])
    pairs = a.join(b, list(block)).filter("a_id < b_id")
    similarity = S.finding_similarity({k: F.col(f"a_{c}") for k, c in names.items()}, {k: F.col(f"b_{c}") for k, c in names.items()})
    return pairs.withColumn("similarity", F.round(similarity, 9)).filter(F.col("similarity") >= threshold).withColumnRenamed("a_type", "type")


#: What two findings of one class have in common.
CLASS = ("type", "file_path", "start_line", "severity", "description", "snippet")


def file_stem(path: Column) -> Column:
    """Name of a file up to its first dot.  Findings of files of different stems reach a similarity of 0.75 at most."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)


def with_class(findings: DataFrame, threshold: float) -> DataFrame:
    """findings with class: equal for findings that agree in all that similarity sees, if it finds them alike."""
    w = rules.SIMILARITY_WEIGHTS
    own = w["type"] + w["location"] + w["severity"] + F.when(F.size(S.word_set(F.col("description"))) > 0, w["description"]).otherwise(0.0)
    own = own + F.when(F.size(S.code_tokens(F.col("snippet"))) > 0, w["code_pattern"]).otherwise(0.0)
    return findings.withColumn("class", F.when(F.round(own, 9) >= threshold, F.md5(F.to_json(F.struct(*CLASS)))).otherwise(F.col("id")))


def class_heads(findings: DataFrame) -> DataFrame:
    """A row for each class: CLASS, the id of its most confident finding (then the least id), confidence, n."""
    head = F.min_by("id", F.struct(-F.col("confidence"), F.col("id"))).alias("id")
    return findings.groupBy("class", *CLASS).agg(head, F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


def similar_classes(findings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, n_a, n_b, type, similarity) of classes alike (type: the first of their types), each pair once and each class with itself if it has several findings.

    Findings meet by the stem of their file, which alike ones share from a threshold over 0.75 on.  What depends on texts is
    compared once for each pair of profiles (type, file, description, snippet); classes of profiles that can reach the
    threshold are then compared by line and severity alone.  Findings are grouped before any pair is made.
    """
    if threshold <= 0.75:
        raise ValueError("below 0.75 findings of unlike files may be similar")
    w = rules.SIMILARITY_WEIGHTS
    heads = class_heads(with_class(findings, threshold)).withColumn("profile", F.md5(F.to_json(F.struct("type", "file_path", "description", "snippet"))))
    p = heads.select("profile", "type", "file_path", F.col("description"), F.col("snippet")).distinct()
    p = p.select("profile", "type", "file_path", file_stem(F.col("file_path")).alias("stem"), S.word_set(F.col("description")).alias("words"), S.code_tokens(F.col("snippet")).alias("tokens"))
    both = p.select("stem", *[F.col(c).alias(f"a_{c}") for c in p.columns if c != "stem"]).join(p.select("stem", *[F.col(c).alias(f"b_{c}") for c in p.columns if c != "stem"]), "stem")
    texts = (
        S.type_similarity(F.col("a_type"), F.col("b_type")) * w["type"] + S.jaccard(F.col("a_words"), F.col("b_words")) * w["description"]
        + S.jaccard(F.col("a_tokens"), F.col("b_tokens")) * w["code_pattern"]
    )
    both = both.withColumn("texts", texts).filter(F.round(F.col("texts") + w["location"] + w["severity"], 9) >= threshold)
    # of two files the lines don't count
    files = (F.col("a_file_path"), F.col("b_file_path"))
    apart = F.when(files[0] != files[1], S.location_similarity(files[0], F.lit(0), files[1], F.lit(0)))
    both = both.select("a_profile", "b_profile", apart.alias("apart"), "texts", F.least("a_type", "b_type").alias("type"))
    heads = heads.select("profile", "class", "start_line", S.severity_rank(F.col("severity")).alias("rank"), "n")
    side = lambda x: heads.select(*[F.col(c).alias(f"{x}_{c}") for c in heads.columns])
    pairs = both.join(side("a"), "a_profile").join(side("b"), "b_profile").filter((F.col("a_class") < F.col("b_class")) | ((F.col("a_class") == F.col("b_class")) & (F.col("a_n") > 1)))
    place = F.coalesce("apart", S.line_similarity(F.col("a_start_line"), F.col("b_start_line")))
    severity = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("a_rank") - F.col("b_rank")) * 0.25)
    score = S.clamp(F.col("texts") + place * w["location"] + severity * w["severity"])
    pairs = pairs.withColumn("similarity", F.round(score, 9)).filter(F.col("similarity") >= threshold)
    return pairs.select(F.col("a_class").alias("a"), F.col("b_class").alias("b"), F.col("a_n").alias("n_a"), F.col("b_n").alias("n_b"), "type", "similarity")


def finding_links(findings: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, class, n_links): one row a finding, with how many others are similar to it."""
    pairs = similar_classes(findings, threshold)
    same = F.col("a") == F.col("b")
    ends = pairs.select(F.col("a").alias("class"), F.when(same, F.col("n_b") - 1).otherwise(F.col("n_b")).alias("n")).union(pairs.filter(~same).select("b", "n_a"))
    links = ends.groupBy("class").agg(F.sum("n").alias("n_links"))
    return with_class(findings, threshold).select("id", "class").join(links, "class", "left").select("id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def greedy_clusters(findings: DataFrame, block: Sequence[str] = (), threshold: float = 0.8) -> DataFrame:
    """id and cluster_id: a finding joins the first representative it is similar to, else becomes one.

    Representatives are taken by falling confidence, then id, within a block: that of the file's stem unless named.  Findings of
    a class join the same representative, so only a class's most confident one is placed; see elected().
    """
    classed = with_class(findings, threshold)
    if not block:
        block, classed = ["_stem"], classed.withColumn("_stem", file_stem(F.col("file_path")))
    classed = stored(classed.select("id", *block, "class", "confidence", *[c for c in CLASS if c not in block]), "classed")
    head = F.min_by(F.struct("id", "confidence"), F.struct(-F.col("confidence"), F.col("id"))).alias("h")
    heads = classed.groupBy(*dict.fromkeys((*block, "class", *CLASS))).agg(head)
    heads = stored(heads.select(*[c for c in heads.columns if c != "h"], "h.id", "h.confidence"), "class-heads")
    folded = elected(heads, block, threshold).select(F.col("id").alias("head"), "cluster_id")
    named = heads.select(*block, "class", F.col("id").alias("head")).join(folded, "head").select(*block, "class", "cluster_id")
    return classed.select("id", *block, "class").join(named, [*block, "class"]).select("id", "cluster_id")


def elected(findings: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    """id and cluster_id of greedy clusters within blocks, by rounds, whatever the size of a block.

    A round folds the first LEADERS findings of each block that have no cluster; no finding left can come before those, so their
    representatives are final.  Then all others that are similar to one join the first such, by a join, and are done.
    """
    order = [-F.col("confidence"), F.col("id")]
    names = {"type": "type", "path": "file_path", "line": "start_line", "words": "words", "tokens": "tokens", "severity": "severity"}
    sets = {"words": S.word_set(F.col("description")), "tokens": S.code_tokens(F.col("snippet"))}
    left, out = stored(findings, "unplaced"), None
    while not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy(*block).orderBy(*order))
        first = left.withColumn("_rank", rank).filter(F.col("_rank") <= LEADERS).drop("_rank")
        folded = stored(_greedy(first, block, threshold), "folded")
        leaders = left.join(folded.filter("id = cluster_id").select("id"), "id", "left_semi").withColumns(sets)
        leaders = stored(leaders.select(*block, *[F.col(c).alias(f"a_{c}") for c in ["id", "confidence", *names.values()]]), "leaders")
        others = left.join(folded.select("id"), "id", "left_anti").withColumns(sets).select(*block, *[F.col(c).alias(f"b_{c}") for c in ["id", *names.values()]])
        pairs = others.join(F.broadcast(leaders) if leaders.count() <= BROADCAST_LEADERS else leaders, list(block))
        similarity = S.finding_similarity({k: F.col(f"a_{c}") for k, c in names.items()}, {k: F.col(f"b_{c}") for k, c in names.items()})
        pairs = pairs.filter(F.round(similarity, 9) >= threshold)
        joined = pairs.groupBy(F.col("b_id").alias("id")).agg(F.min_by("a_id", F.struct(-F.col("a_confidence"), F.col("a_id"))).alias("cluster_id"))
        placed = stored(folded.unionByName(joined), "placed")
        out = placed if out is None else out.unionByName(placed)
        left = stored(left.join(placed.select("id"), "id", "left_anti"), "unplaced")
    return findings.select("id", F.col("id").alias("cluster_id")).limit(0) if out is None else out


def _greedy(findings: DataFrame, block: Sequence[str], threshold: float) -> DataFrame:
    import pandas as pd

    weights, related = rules.SIMILARITY_WEIGHTS, rules.RELATED_TYPES

    def type_score(x: str, y: str) -> float:
        if x == y:
            return 1.0
        x, y = x.lower(), y.lower()
        return 0.7 if any((k in x and any(w in y for w in ws)) or (k in y and any(w in x for w in ws)) for k, ws in related.items()) else 0.0

    def jaccard(x: frozenset, y: frozenset) -> float:
        return len(x & y) / len(x | y) if x and y else 0.0

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True])
        texts: dict[tuple, float] = {}
        heads, out = [], []

        def said(a: tuple, b: tuple) -> float:
            """What two profiles (type, words, tokens) have in common; there are few of them."""
            if (a, b) not in texts:
                texts[a, b] = weights["type"] * type_score(a[0], b[0]) + weights["description"] * jaccard(a[1], b[1]) + weights["code_pattern"] * jaccard(a[2], b[2])
            return texts[a, b]

        def place(a: tuple, b: tuple) -> float:
            if a[2] == b[2]:
                gap = abs(a[3] - b[3])
                return 1.0 if gap == 0 else 0.8 if gap <= 5 else 0.6 if gap <= 20 else 0.4
            x, y = a[2].split("/")[-1], b[2].split("/")[-1]
            return 0.3 if x == y else 0.2 if x.split(".")[0] == y.split(".")[0] else 0.0

        def similarity(a: tuple, b: tuple) -> float:
            return said(a[1], b[1]) + weights["location"] * place(a, b) + weights["severity"] * max(0.0, 1 - 0.25 * abs(a[4] - b[4]))

        for r in pdf.itertuples(index=False):
            snippet = r.snippet.lower()
            profile = (r.type, frozenset(r.description.lower().split()), frozenset(t for t in rules.CODE_TOKENS if t in snippet))
            row = (r.id, profile, r.file_path, r.start_line, rules.SEVERITY_RANK.get(r.severity.lower(), 3))
            home = next((h for h in heads if round(similarity(h, row), 9) >= threshold), None)
            if home is None:
                heads.append(home := row)
            out.append((r.id, home[0]))
        return pd.DataFrame(out, columns=["id", "cluster_id"])

    return findings.groupBy(*block).applyInPandas(fold, "id string, cluster_id string")


def resolved_clusters(findings: DataFrame, cluster: str) -> DataFrame:
    """A row for each cluster with the outcome of every way to resolve it."""
    best = F.min_by("id", F.struct(-F.col("confidence"), F.col("id")))
    by_type = findings.groupBy(cluster, "type").agg(F.count(F.lit(1)).alias("votes"), F.min("id").alias("first_id"))
    majority = by_type.groupBy(cluster).agg(F.min_by("type", F.struct(-F.col("votes"), F.col("first_id"))).alias("majority_type"))
    # millionths are added up as integers and rounded once, halves up, so the mean depends on no order
    millionths, n = F.sum(F.round(F.col("confidence") * 1_000_000).cast("long")), F.count(F.lit(1))
    c = findings.groupBy(cluster).agg(
        n.alias("n"), best.alias("best_id"), F.max("confidence").alias("highest"), (F.floor((2 * millionths + n) / (2 * n)) / 1_000_000).alias("average"),
        F.round(F.countDistinct("task_id") / F.count(F.lit(1)), 6).alias("strength"),
    )
    adjusted = F.when(F.col("strength") >= REACHED, F.col("highest")).otherwise(F.col("highest") * F.col("strength"))
    return c.join(majority, cluster).select(cluster, "n", "best_id", "majority_type", "highest", "average", "strength", F.round(adjusted, 6).alias("consensus_confidence"))


def integration_metrics(findings: DataFrame, cluster: str) -> DataFrame:
    """One row: how far clustering condensed the findings, and the confidence of the results."""
    c = findings.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct("task_id") / F.count(F.lit(1))).alias("strength"), F.max("confidence").alias("confidence"))
    return c.agg(
        F.sum("n").alias("n_findings"), F.count(F.lit(1)).alias("n_clusters"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("dedup_rate"),
        F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("largest"), F.count_if(F.col("n") > 1).alias("multi"), F.round(F.avg("strength"), 6).alias("mean_strength"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)), 6).alias("stdev_confidence"),
        F.min("confidence").alias("low"), F.max("confidence").alias("high"),
    )


def security_events(events: DataFrame, threshold: float) -> DataFrame:
    """Violations, logins, logouts and whatever is risky, the latest first."""
    return events.filter(F.col("event_type").isin("security_violation", "user_login", "user_logout") | (F.col("risk") >= threshold)).orderBy(F.desc("ts"), "event_id")


# Consensus of several models on a finding -------------------------------------------------------------------------


def _row(valid: Column, score: Column, confidence: Column) -> list[Column]:
    score = F.round(score, 6)
    return [valid.alias("valid"), score.alias("score"), (score >= REACHED).alias("reached"), F.round(confidence, 6).alias("confidence")]


def _majority(v: DataFrame) -> DataFrame:
    n, yes = F.count(F.lit(1)), F.count_if("is_valid")
    return v.groupBy("finding_id").agg(*_row(yes > n / 2, F.abs(2 * yes - n) / n, F.avg("confidence")))


def _weighted(v: DataFrame) -> DataFrame:
    """The spread of votes about the weighted vote, in one aggregation: mean of (x - p)^2 for x in 0, 1."""
    share, total = F.avg(F.col("is_valid").cast("double")), F.sum("weight")
    validity = F.sum(F.when(F.col("is_valid"), F.col("weight")).otherwise(0.0)) / total
    spread = share * (1 - validity) * (1 - validity) + (1 - share) * validity * validity
    return v.groupBy("finding_id").agg(*_row(validity > 0.5, 1 - F.least(F.lit(1.0), spread), F.sum(F.col("confidence") * F.col("weight")) / total))


def _confidence(v: DataFrame) -> DataFrame:
    signed = F.when(F.col("is_valid"), F.col("confidence")).otherwise(-F.col("confidence"))
    total, yes = F.sum("confidence"), F.sum(F.when(F.col("is_valid"), F.col("confidence")).otherwise(0.0))
    score = F.greatest(F.lit(0.0), F.when(F.count(F.lit(1)) > 1, 1 - F.stddev_samp(signed) / 2).otherwise(F.lit(1.0)))
    some = total > 0
    valid = F.when(some, F.round(yes / total, 9) > 0.5).otherwise(F.lit(False))
    return v.groupBy("finding_id").agg(*_row(valid, F.when(some, score).otherwise(0.0), F.when(some, F.sum(F.col("confidence") * F.col("confidence")) / total).otherwise(0.0)))


def _unanimous(v: DataFrame) -> DataFrame:
    agreed = F.bool_and("is_valid") | ~F.bool_or("is_valid")
    return v.groupBy("finding_id").agg(*_row(F.bool_and("is_valid"), agreed.cast("double"), F.avg("confidence")))


def _threshold(v: DataFrame) -> DataFrame:
    sure = F.col("confidence") >= REACHED
    n, yes = F.count_if(sure), F.count_if(sure & F.col("is_valid"))
    ratio = F.when(n > 0, yes / n)
    score = F.coalesce(F.abs(ratio - 0.5) * 2, F.lit(0.0))
    return v.groupBy("finding_id").agg(*_row(F.coalesce(ratio > 0.5, F.lit(False)), score, F.coalesce(F.avg(F.when(sure, F.col("confidence"))), F.lit(0.0))))


CONSENSUS = {"majority": _majority, "weighted": _weighted, "confidence": _confidence, "unanimous": _unanimous, "threshold": _threshold}


def consensus(verdicts: DataFrame, strategy: str = "confidence") -> DataFrame:
    """finding_id, valid, score, reached, confidence from verdicts (finding_id, confidence, is_valid, weight)."""
    return CONSENSUS[strategy](verdicts)


def disagreement(verdicts: DataFrame) -> DataFrame:
    """finding_id, confidence_stdev and level: none for a single verdict, low, medium or high."""
    d = verdicts.groupBy("finding_id").agg(F.avg(F.col("is_valid").cast("double")).alias("agreement"), F.round(F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)), 9).alias("confidence_stdev"), F.count(F.lit(1)).alias("n"))
    off = F.round(F.abs(F.col("agreement") - 0.5), 9)
    level = S.first_match(((F.col("n") < 2, "none"), ((off > 0.3) & (F.col("confidence_stdev") < 0.2), "low"), ((off <= 0.3) | (F.col("confidence_stdev") >= 0.3), "high")), "medium")
    return d.withColumn("level", level)
