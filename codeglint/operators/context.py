"""Context of findings: windows of lines that their variables, control flow, data and keywords point to.

Findings meet their file once, as an array beside its content; its lines are split and read once, and only windows leave the
file, so no pair of a finding and a line is shuffled.  Lines count from 1.  findings: id, path, start_line, snippet, an id is one
finding; files: path, content.  With findings None, files have them in the array `found` (in_files()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

AROUND, NEAR = 3, 10
CONTROL = r"\s*(if|elif|else|for|while|try|except|finally|with)\b|\s*return\b|\s*break\b|\s*continue\b"


def _words(a: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(a, F.lit(X.IDENTIFIER), F.lit(0)))


def in_files(findings: DataFrame | None, files: DataFrame) -> DataFrame:
    """Files that have findings, with those as `found`, an array of (id, start_line, snippet)."""
    if findings is None:
        return files
    found = findings.groupBy("path").agg(F.collect_list(F.struct("id", "start_line", "snippet")).alias("found"))
    return files.join(found, "path")


def _with(value: Column, use) -> Column:
    """use(value), with value computed once: the variable of an outer function."""
    return F.get(F.transform(F.array(value), use), 0)


def _hits(findings: DataFrame | None, files: DataFrame, limit: int, read, asked, hit) -> DataFrame:
    """The first `limit` windows of each finding: id, line, start_line, end_line, relevance, reason.

    read: what is known of a text of a line, once a file; asked: the same of a snippet; hit: of a line (line, known), a finding
    (id, start_line, asked) the windows as an array of structs that begin with what orders them.
    """
    def one(lines, f):
        every = F.flatten(F.transform(F.filter(lines, lambda x: x["line"] != f["start_line"]), lambda x: hit(x, f)))
        return F.transform(F.slice(F.array_sort(every), 1, limit), lambda w: F.struct(f["id"].alias("id"), w.alias("w")))

    split = X.lines(F.col("content"))
    lines = F.transform(split, lambda t, i: F.struct((i + 1).alias("line"), read(t).alias("known")))
    found = F.transform("found", lambda f: F.struct(f["id"].alias("id"), f["start_line"].alias("start_line"), asked(f["snippet"]).alias("asked")))
    hits = _with(lines, lambda lines: F.flatten(F.transform(found, lambda f: one(lines, f))))
    w = in_files(findings, files).select(F.size(split).alias("n_lines"), F.explode(hits).alias("h")).select("n_lines", "h.id", "h.w.*")
    start, end = F.greatest(F.col("line") - AROUND, F.lit(1)), F.least(F.col("line") + AROUND, F.col("n_lines"))
    return w.select("id", "line", start.alias("start_line"), end.alias("end_line"), "relevance", "reason")


def _window(line: Column, reason: Column, relevance: Column) -> Column:
    return F.struct(line.alias("line"), reason.alias("reason"), relevance.alias("relevance"))


def variable_windows(findings: DataFrame | None, files: DataFrame, limit: int = 5) -> DataFrame:
    """Windows around other lines that use a variable of the snippet, by line, then variable."""
    hit = lambda x, f: F.transform(F.array_intersect(f["asked"], x["known"]), lambda w: _window(x["line"], F.concat(F.lit("variable_tracking_"), w), F.lit(0.7)))
    return _hits(findings, files, limit, _words, X.snippet_variables, hit)


def _controls(x: Column, f: Column) -> Column:
    return F.when(x["known"] & (F.abs(x["line"] - f["start_line"]) <= NEAR), F.array(_window(x["line"], F.lit("control_flow"), F.lit(0.6)))).otherwise(F.array())


def control_windows(findings: DataFrame | None, files: DataFrame, limit: int = 3) -> DataFrame:
    """Windows around control flow within ten lines, by line."""
    return _hits(findings, files, limit, lambda t: F.regexp_like(t, F.lit(CONTROL)), lambda s: F.lit(True), _controls)


def dependency_windows(findings: DataFrame | None, files: DataFrame, limit: int = 4) -> DataFrame:
    """Windows around other lines that assign a variable of the snippet or pass it to a call, by line, assignments first."""
    # a line without the sign has no match, and a word that one fails on is not tried again from its middle
    empty = F.array().cast("array<string>")
    assigned = lambda t: F.when(F.contains(t, F.lit("=")), F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(\w++)\s*+="), F.lit(1)))).otherwise(empty)
    calls = lambda t: F.regexp_extract_all(t, F.lit(r"(?<!\w)\w++\(([^)]*+)\)"), F.lit(1))
    passed = lambda t: F.when(F.contains(t, F.lit("(")), F.array_distinct(F.flatten(F.transform(calls(t), _words)))).otherwise(empty)
    read = lambda t: F.struct(assigned(t).alias("assignment"), passed(t).alias("call"))

    def hit(x, f):
        either = [F.when(F.arrays_overlap(f["asked"], x["known"][k]), _window(x["line"], F.lit(f"data_dependency_{k}"), F.lit(r))) for k, r in (("assignment", 0.8), ("call", 0.7))]
        return F.array_compact(F.array(*either))

    return _hits(findings, files, limit, read, X.snippet_variables, hit)


def similar_lines(findings: DataFrame | None, files: DataFrame, least: float = 0.2, limit: int = 5) -> DataFrame:
    """Windows around the other lines whose keywords are most like the snippet's; similar lines share a keyword."""
    def hit(x, f):
        relevance = F.round(X.keyword_similarity(f["asked"], x["known"]), 6)
        window = lambda r: F.struct((-r).alias("_first"), *[c.alias(n) for n, c in (("line", x["line"]), ("reason", F.lit("semantic_similarity")), ("relevance", r))])
        scored = _with(relevance, lambda r: F.when(r >= least, window(r)))
        return F.array_compact(F.array(F.when(F.arrays_overlap(f["asked"], x["known"]), scored)))

    return _hits(findings, files, limit, X.snippet_keywords, X.snippet_keywords, hit)


def function_windows(findings: DataFrame | None, files: DataFrame, units: DataFrame | None) -> DataFrame:
    """The innermost function around each finding, or ten lines either way; with units None, files have them in the array `units`."""
    if units is not None:
        every = units.groupBy("path").agg(F.collect_list(F.struct("type", "start_line", "end_line")).alias("units"))
        files = files.join(every, "path", "left")
    split, line = X.lines(F.col("content")), F.col("f.start_line")
    w = in_files(findings, files).select(F.size(split).alias("n_lines"), _innermost().alias("f")).select("n_lines", F.explode("f").alias("f"))
    found = F.col("f.w").isNotNull()
    start = F.coalesce(F.col("f.w.a"), F.greatest(line - NEAR, F.lit(1)))
    end = F.coalesce(-F.col("f.w.b"), F.least(line + NEAR, F.col("n_lines")))
    return w.select("f.id", start.alias("start_line"), end.alias("end_line"), F.when(found, 0.9).otherwise(0.8).alias("relevance"), F.lit("function_boundary").alias("reason"))


def _innermost() -> Column:
    """found with the innermost of units around each as w, its first line and its last one's negative."""
    functions = F.filter("units", lambda u: u["type"].isin("function", "method"))
    around = lambda us, line: F.filter(us, lambda u: line.between(u["start_line"], u["end_line"]))
    best = lambda us, line: F.array_max(F.transform(around(us, line), lambda u: F.struct(u["start_line"].alias("a"), (-u["end_line"]).alias("b"))))
    return _with(functions, lambda us: F.transform("found", lambda f: F.struct(f["id"].alias("id"), f["start_line"].alias("start_line"), best(us, f["start_line"]).alias("w"))))


def control_contexts(findings: DataFrame | None, files: DataFrame, limit: int = 3) -> DataFrame:
    """semantic_context() of the control windows of each finding, made where its file is."""
    split = X.lines(F.col("content"))
    lines = F.transform(split, lambda t, i: F.struct((i + 1).alias("line"), F.regexp_like(t, F.lit(CONTROL)).alias("known"), t.alias("text")))

    def windows(lines, f):
        near = F.slice(F.filter(lines, lambda x: x["known"] & (x["line"] != f["start_line"]) & (F.abs(x["line"] - f["start_line"]) <= NEAR)), 1, limit)
        first = lambda x: F.greatest(x["line"] - AROUND, F.lit(1))
        block = lambda x: F.array_join(F.transform(F.slice(lines, first(x), x["line"] + AROUND - first(x) + 1), lambda y: y["text"]), "\n")
        return F.transform(near, lambda x: F.struct(x["line"].alias("line"), block(x).alias("block"), F.lit(0.6).alias("relevance")))

    each = _with(lines, lambda lines: F.transform("found", lambda f: F.struct(f["id"].alias("id"), windows(lines, f).alias("w"))))
    g = in_files(findings, files).select(F.explode(each).alias("c")).select("c.*").filter(F.size("w") > 0)
    return g.select("id", *_context())


def semantic_context(windows: DataFrame, files: DataFrame) -> DataFrame:
    """(id, blocks, similarities): the contents of a finding's windows in order, and their relevance by centre.

    windows: id, path, line, start_line, end_line, relevance; a finding has few.
    """
    lines = X.lines(F.col("content"))
    w = windows.join(files.select("path", "content"), "path")
    w = w.withColumn("block", F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"))
    return w.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line", "block", "relevance"))).alias("w")).select("id", *_context())


def _context() -> list[Column]:
    scores = F.transform("w", lambda x: F.concat(F.lit("window_"), x["line"].cast("string"), F.lit(":"), x["relevance"].cast("string")))
    return [F.transform("w", lambda x: x["block"]).alias("blocks"), F.array_distinct(scores).alias("similarities")]
