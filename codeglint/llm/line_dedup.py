"""Lines that many documents share, found and dropped, in DataFrame operations only.

A line's key is stripped of ASCII white space and lower-cased in A-Z; its md5 stands for it.  Hashes are dealt to ranges of
(hash, document) and meet there by document and position: a group of one document's equal lines lies in one range, and the
first occurrence of each group counts the document.  A hash that a third of all documents share covers many ranges, so it is
never in one task: counts are made by range and added up, and what is decided about a hash goes back to the ranges that hold it.

The result is a keep bitmap a document, compressed to the lengths of its runs, instead of text; documents that lose nothing have
none.  A bitmap belongs to an id and a text, known by two hashes, so rows that agree in both share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE_ROWS, new_name, stored

#: Keys of at least MIN_CHARS code points that MIN_DOCS documents or more have are shared.
MIN_DOCS, MIN_CHARS = 10, 1
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOC = ("_id", "_a", "_b")


def lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _document(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """What a bitmap is known by: the id, and two hashes of the text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return {"_id": F.col(f"`{id_col}`"), "_a": F.xxhash64(text), "_b": F.xxhash64(F.lit(1), text)}


def _ranges(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (10 * FILE_ROWS)))


def line_groups(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each document and each of its keys: hash, the document, copies (rows alike in id and text), the key's positions in
    order, and the range of hashes and documents in which it was met."""
    spark = docs.sparkSession
    rows = docs.select(*[c.alias(n) for n, c in _document(docs, id_col, text_col).items()], F.posexplode(lines(F.col(f"`{text_col}`"))).alias("_pos", "_line"))
    keyed = rows.select(*_DOC, "_pos", line_key(F.col("_line")).alias("_key")).filter(F.length("_key") >= max(1, min_chars))
    hashed = keyed.select(*_DOC, "_pos", F.unhex(F.md5(F.col("_key").cast("binary"))).alias("_hash"))
    # equal rows become one before they are dealt
    once = stored(hashed.groupBy("_hash", *_DOC, "_pos").agg(F.count(F.lit(1)).alias("_copies")), "line-hashes")
    dealt = once.repartitionByRange(_ranges(spark, once.count()), "_hash", *_DOC)
    met = dealt.groupBy("_hash", *_DOC).agg(F.sort_array(F.collect_list("_pos")).alias("_at"), F.max("_copies").alias("_copies"))
    return stored(met.withColumn("_range", F.spark_partition_id()), "line-groups")


def shared_lines(groups: DataFrame, min_docs: int) -> DataFrame:
    """(_range, _hash, first document and position) of the hashes that min_docs documents have, a row for each range that holds one."""
    first = F.struct(F.col("_id").isNull().alias("none"), *[F.col(c) for c in _DOC], F.element_at("_at", 1).alias("at"))
    in_range = groups.groupBy("_range", "_hash").agg(F.sum("_copies").alias("_docs"), F.min(first).alias("_first"))
    in_range = stored(in_range, "line-counts")
    whole = in_range.groupBy("_hash").agg(F.sum("_docs").alias("_docs"), F.min("_first").alias("_first")).filter(F.col("_docs") >= min_docs)
    return in_range.select("_range", "_hash").join(whole.select("_hash", "_first"), "_hash")


def runs(dropped: Column) -> Column:
    """A keep bitmap's compressed form from the sorted positions dropped: (first, length) of each run of them."""
    at = lambda i: F.get(dropped, i)
    numbers = F.sequence(F.lit(0), F.size(dropped) - 1)
    starts = F.filter(numbers, lambda i: (i == 0) | (at(i) != at(i - 1) + 1))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(dropped)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(at(a).alias("first"), (b - a).alias("length")))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """(_id, _a, _b, dropped) of the documents that lose lines: what a document is known by, and its bitmap of lines.

    dropped: the runs of lines that go, (first, length) from 0 in order; all others stay.  A line goes if its key has min_chars code
    points and min_docs documents have it; with keep_first the first such line of all stays, by id (null last), then position.
    Rows are documents of their own, also those of one id, of none, or alike in all.  Empty lines never go.
    """
    groups = line_groups(docs, id_col, text_col, min_chars)
    marked = groups.join(shared_lines(groups, min_docs), ["_range", "_hash"])
    if keep_first:
        own = F.struct(F.col("_id").isNull().alias("none"), *[F.col(c) for c in _DOC], F.element_at("_at", 1).alias("at"))
        rest = F.when(own == F.col("_first"), F.slice("_at", F.lit(2), F.size("_at"))).otherwise(F.col("_at"))
        marked = marked.withColumn("_at", rest).filter(F.size("_at") > 0)
    by_doc = marked.groupBy(*_DOC).agg(F.sort_array(F.flatten(F.collect_list("_at"))).alias("_at"))
    return by_doc.select(*_DOC, runs(F.col("_at")).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines of a text that a bitmap keeps, joined by \\n; a null bitmap keeps all."""
    every = lines(text)
    ends = F.transform(dropped, lambda r: r["first"] + r["length"])
    starts = F.concat(F.array(F.lit(0)), ends)
    stops = F.concat(F.transform(dropped, lambda r: r["first"]), F.array(F.size(every)))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(every, a + 1, F.greatest(b - a, F.lit(0)))))
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """docs with three columns more: n_lines and n_dropped (long), and kept_text; columns of docs of these names are replaced.

    Nulls, repeats and empty lines as in line_bitmaps(); a null or empty text has one line.  An empty table gives an empty result.
    """
    bitmaps = line_bitmaps(docs, id_col, text_col, min_docs, min_chars, keep_first)
    key = {n: new_name(docs, n) for n in _DOC}
    mask = new_name(docs, "_dropped")
    known = docs.select("*", *[c.alias(key[n]) for n, c in _document(docs, id_col, text_col).items()])
    side = bitmaps.select(*[F.col(n).alias(f"_of{n}") for n in _DOC], F.col("dropped").alias(mask))
    same = F.col(f"`{key['_id']}`").eqNullSafe(F.col("_of_id")) & (F.col(f"`{key['_a']}`") == F.col("_of_a")) & (F.col(f"`{key['_b']}`") == F.col("_of_b"))
    met, text, m = known.join(side, same, "left"), F.col(f"`{text_col}`"), F.col(f"`{mask}`")
    gone = F.coalesce(F.aggregate(m, F.lit(0).cast("long"), lambda n, r: n + r["length"]), F.lit(0)).cast("long")
    new = {"n_lines": F.size(lines(text)).cast("long"), "n_dropped": gone, "kept_text": kept_text(text, m)}
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return met.select(*own, *[c.alias(n) for n, c in new.items()])


def line_digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of without_shared_lines()."""
    out = without_shared_lines(docs, **settings)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
