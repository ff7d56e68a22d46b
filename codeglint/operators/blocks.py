"""Units of code in languages without a parser: names by line patterns, ends by indent and brackets, in DataFrame operations.

Depths are sums over the lines of a file; the first return to a level is one running minimum over the lines that could end a
block, so work grows with lines, not with blocks times lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import GENERIC_UNITS

_FILE = ["path", "_digest"]


def block_units(files: DataFrame) -> DataFrame:
    r"""path, type, name, start_line, end_line of files (path, content): the file, and what lines begin by GENERIC_UNITS.

    A line gives one unit a pattern at most; lines are counted from 1 and end at \n, \r\n or \r.  A block ends before the first later line
    that isn't blank and is indented no deeper than its own, or at the first line from its own on that has a semicolon and
    leaves round and curly brackets as they were before the block, whichever is first; else at the end of the file.

    Null content counts as empty: a file of no lines, from 1 to 0.  A null path is a file without a name.  Rows alike in path and
    content are one file; rows of one path with other contents are files of their own.  Other columns are left out.
    """
    f = files.select(F.col("path"), F.coalesce("content", F.lit("")).alias("_content"))
    # files are placed once, by both keys of the windows below, so their lines aren't shuffled
    f = f.withColumn("_digest", F.md5(F.col("_content").cast("binary"))).dropDuplicates(_FILE)
    f = f.withColumn("_lines", F.split(F.regexp_replace("_content", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n"))
    f = f.withColumn("_size", F.when(F.col("_content") == "", F.lit(0)).otherwise(F.size("_lines")))
    l = f.select(*_FILE, "_size", F.posexplode("_lines").alias("_at", "_line")).withColumn("_at", F.col("_at") + 1)
    found = F.array_compact(F.array(*[F.when(F.regexp_like("_line", F.lit(p)), F.struct(F.lit(k).alias("type"), F.regexp_extract("_line", p, 1).alias("name"))) for p, k in GENERIC_UNITS]))
    l = l.withColumn("_found", found).withColumn("_indent", F.length(F.regexp_extract("_line", r"^(\s*)", 1)))
    l = _with_depths(l)
    head = F.size("_found") > 0
    levels = F.collect_set(F.when(head, F.col("_indent"))).over(Window.partitionBy(*_FILE))
    l = l.withColumn("_levels", F.when(F.regexp_like("_line", F.lit(r"\S")), levels).otherwise(F.array().cast("array<int>")))
    ends = _first_stops(l, head)
    end = F.least("_size", F.col("_closed"), F.col("_outdented") - 1)
    units = ends.select("path", F.explode("_found").alias("u"), F.col("_at").alias("start_line"), end.alias("end_line"))
    whole = f.select("path", F.lit("file").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(1).alias("start_line"), F.col("_size").alias("end_line"))
    return whole.unionByName(units.select("path", "u.type", "u.name", "start_line", "end_line"))


def _with_depths(lines: DataFrame) -> DataFrame:
    """lines with round and curly brackets left open before and behind each."""
    count = lambda c: F.length("_line") - F.length(F.replace("_line", F.lit(c)))
    before = Window.partitionBy(*_FILE).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = lines
    for name, (opening, closing) in {"round": "()", "curly": "{}"}.items():
        own = count(opening) - count(closing)
        out = out.withColumn(f"_{name}", F.sum(own).over(before)).withColumn(f"_{name}_before", F.col(f"_{name}") - own)
    return out


def _first_stops(lines: DataFrame, head: Column) -> DataFrame:
    """Lines that begin units, with _closed and _outdented: the line where brackets are even again, the next one not deeper.

    Each line is marked as an end for whom it may be one, each head as asking; a mark's key is bracket depths or an indent.
    Read backwards, the nearest end of a key is the least seen.  A level of indent is there only for its heads, and a file
    with k of them has k * k / 2 blanks, so a line has few marks.
    """

    def mark(kind: int, a: Column, b: Column, at: Column, asks: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"), at.alias("at"), F.lit(asks).alias("asks"))

    c, none = F.col, F.lit(0)
    closes = F.when(F.contains("_line", F.lit(";")), mark(0, c("_round"), c("_curly"), c("_at"), False))
    asks = F.when(head, F.array(mark(0, c("_round_before"), c("_curly_before"), c("_at"), True), mark(1, c("_indent"), none, c("_at") + 1, True)))
    outdents = F.transform(F.filter("_levels", lambda v: v >= c("_indent")), lambda v: mark(1, v, none, c("_at"), False))
    marks = F.concat(F.array_compact(F.array(closes)), F.coalesce(asks, F.array().cast(_MARKS)), outdents)
    m = lines.select(*_FILE, "_size", "_at", F.when(head, c("_found")).alias("_found"), F.explode(marks).alias("m")).select("*", "m.*").drop("m")
    # only asking marks need what was found
    m = m.withColumn("_found", F.when(c("asks"), c("_found")))
    backwards = Window.partitionBy(*_FILE, "kind", "a", "b").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_stop", F.min(F.when(~c("asks"), c("at"))).over(backwards)).filter("asks")
    stop = lambda k: F.max(F.when(c("kind") == k, c("_stop")))
    return m.groupBy(*_FILE, "_at").agg(F.first("_size").alias("_size"), F.first("_found").alias("_found"), stop(0).alias("_closed"), stop(1).alias("_outdented"))


_MARKS = "array<struct<kind:int,a:bigint,b:bigint,at:int,asks:boolean>>"
