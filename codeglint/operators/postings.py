"""Substring search by postings: queries and texts meet by the gram of the query that fewest texts hold, then are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .joins import RULE_ROWS, small

#: Characters of a gram, and parts that the texts of a gram are dealt to where queries are too many to broadcast.
GRAM, PARTS = 3, 16
#: Characters of a piece of a long text.
PIECE = 256


def _grams(text: Column, k: int) -> Column:
    """Distinct runs of k characters.  Characters are split once, as the variable of an outer function, so work is linear in the text."""
    runs = lambda chars: F.transform(F.sequence(F.lit(0), F.size(chars) - k), lambda i: F.concat(*[F.get(chars, i + j) for j in range(k)]))
    distinct = F.flatten(F.transform(F.array(F.split(text, "")), lambda chars: F.array_distinct(runs(chars))))
    return F.when(F.length(text) >= k, distinct).otherwise(F.array().cast("array<string>"))


def _places(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """texts with a row for every gram at every place `_at` of the texts written one after the other (`_text`).

    They are cut into pieces first: a place is found by counting characters from the start of its piece.
    """
    piece = lambda i: F.struct(i.alias("from"), F.substr(F.col("_text"), i + 1, F.lit(PIECE + GRAM - 1)).alias("text"))
    t = texts.withColumn("_text", F.array_join("texts", "\n"))
    t = t.withColumn("_piece", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.length("_text") - 1, F.lit(0)), F.lit(PIECE)), piece)))
    t = t.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.length("_piece.text"), F.lit(PIECE)))))
    t = t.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in sizes]))) if len(sizes) > 1 else t.withColumn("_k", F.lit(sizes[0]))
    t = t.withColumn("gram", F.substr(F.col("_piece.text"), F.col("_i"), F.col("_k"))).withColumn("_at", F.col("_piece.from") + F.col("_i"))
    return t.filter(F.length("gram") == F.col("_k")).drop("_piece", "_i", "_k")


def containing(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (query_id, text_id) of texts (text_id, text) that hold a query (query_id, query), in any case.

    Null and empty queries find nothing, null texts are found by none.  Rows of one id are texts, or queries, under one name.
    Queries of one or two characters meet by grams of that length.  Other columns are left out.
    """
    q = _asked(queries)
    held = holding(q, texts.select("text_id", F.array("text").alias("texts"))).distinct()
    return held.join(q, "query").select("query_id", "text_id").distinct()


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lower("query").alias("query")).filter("query <> ''").distinct()


def holding(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, text_id) of the queries (query, in lower case, repeated or not) and rows of texts (text_id, texts: an array) of which one holds it.

    A query meets a row once, by one gram.  Few queries are broadcast and compared where the texts are, without a shuffle of texts.
    """
    q = queries.select("query").distinct()
    t = texts.select("text_id", F.filter(F.transform("texts", F.lower), lambda x: x != "").alias("texts")).filter(F.size("texts") > 0)
    sizes = sorted(r[0] for r in q.select(F.least(F.length("query"), F.lit(GRAM))).distinct().collect())  # three numbers at most
    if not sizes:
        return q.join(t.select("text_id"), F.lit(False))
    own = F.coalesce(*[F.when(F.least(F.length("query"), F.lit(GRAM)) == k, _grams(F.col("query"), k)) for k in sizes])
    asked = q.withColumn("gram", F.explode(own))
    there = _places(t, sizes)
    # only grams of queries that have more than one are counted; one that no text holds counts nothing and ends its query
    choices = small(asked.filter(F.length("query") > GRAM).select("gram").distinct())
    counts = there.select("gram").join(choices, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("query").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    rarest = stored(rarest, "rarest")
    hold = F.exists("texts", lambda x: F.contains(x, F.col("query")))
    if rarest.limit(RULE_ROWS + 1).count() <= RULE_ROWS:
        return there.join(F.broadcast(rarest), "gram").filter(F.expr("_at = locate(gram, _text)")).filter(hold).select("query", "text_id")
    # a gram may be in most texts, so the texts of one are dealt to parts; texts stay where they are until ids have met
    dealt = there.select("text_id", "gram").withColumn("_part", F.pmod(F.xxhash64("text_id"), F.lit(PARTS)).cast("int"))
    wide = rarest.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = dealt.join(wide, ["gram", "_part"]).select("query", F.col("text_id").alias("_id")).distinct()
    return met.join(t, F.col("text_id").eqNullSafe(F.col("_id"))).filter(hold).select("query", "text_id")


def keyword_search(queries: DataFrame, sources: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, rank, cve_id, source, published: up to `limit` CVEs of three sources for each keyword, the newest first.

    sources: source (1, 2, 3), cve_id, description, published.  Half of the limit comes from source 1, the rest from source 2 (one at
    least), what is still missing from source 3, each by date, newest first, then id; a null date is the oldest.  A CVE of two
    sources counts for both, but is given once, as the first has it; of rows of one source and id the newest is taken.
    """
    newest = Window.partitionBy("source", "cve_id").orderBy(F.desc_nulls_last("published"), "description")
    s = sources.filter("cve_id is not null and source in (1, 2, 3)").withColumn("_r", F.row_number().over(newest)).filter("_r = 1")
    s = s.select(F.struct("source", "cve_id", "published").alias("text_id"), F.array("cve_id", "description").alias("texts"))
    q = _asked(queries)
    first = lambda *by: F.row_number().over(Window.partitionBy(*by, "source").orderBy(F.desc_nulls_last("published"), "cve_id"))
    # a text of queries is searched once, however many ids ask it, and only its first rows of each source are given to its ids
    found = holding(q, stored(s, "cves")).select("query", "text_id.*").withColumn("_n", first("query")).filter(F.col("_n") <= limit)
    found = found.join(q, "query").select("query_id", "source", "cve_id", "published").distinct()
    # no source gives more than the limit, so what is left of a query is small
    f = found.withColumn("_n", first("query_id")).filter(F.col("_n") <= limit)
    count = lambda k: F.count_if(F.col("source") == k).over(Window.partitionBy("query_id"))
    n1 = F.least(count(1), F.lit(limit // 2))
    f = f.withColumn("_n1", n1).withColumn("_n2", F.least(count(2), F.greatest(F.lit(1), F.lit(limit) - n1)))
    quota = F.when(F.col("source") == 1, F.col("_n1")).when(F.col("source") == 2, F.col("_n2")).otherwise(F.lit(limit) - F.col("_n1") - F.col("_n2"))
    f = f.filter(F.col("_n") <= quota)
    once = f.groupBy("query_id", "cve_id").agg(F.min_by("published", "source").alias("published"), F.min("source").alias("source"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("published"), "cve_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "rank", "cve_id", "source", "published")
