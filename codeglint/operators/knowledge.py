"""Knowledge and context of findings: look-ups, targets, remediation, relations, chunks, model replies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..storage import stored
from .joins import met, small
from .postings import containing

#: Remediation by the pattern of a type, in order; the last fits all (fixed values).
REMEDIATIONS = (
    (r"sql\s*injection", "use parameterised queries"), (r"xss|cross.site.scripting", "encode output"), (r"command\s*injection", "pass arguments as a list"),
    (r"path\s*traversal", "resolve and check paths"), (r"auth", "check permission at the entry"), (r".*", "validate input and apply least privilege"),
)
#: Targets of so many characters meet the parts of names as a whole, longer ones by their beginning.
WHOLE = 64
RELATIONS = {"call": r"(\w+)\s*\(", "assignment": r"(\w+)\s*=[^=]", "import": r"(?:import|from)\s+(\w+)", "attribute": r"(\w+)\.\w+"}


def lookup(queries: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(query_id, item): knowledge (item, name, description) whose name or description has the query's text."""
    k = knowledge.withColumnRenamed("item", "text_id")
    texts = k.select("text_id", F.col("name").alias("text")).unionByName(k.select("text_id", F.col("description").alias("text")))
    return containing(queries, texts).select("query_id", F.col("text_id").alias("item"))


def fuzzy_targets(references: DataFrame, units: DataFrame) -> DataFrame:
    """(ref_id, unit): the unit a name refers to.  references: ref_id, target, path; units: unit, name, path.

    An equal name wins, in the same file first.  Otherwise 5 points for a unit's name that holds the target, 3 for a target
    that holds the name, 2 for the same file; 5 points at least.  Targets and names under three characters need an equal name.
    Names of the same file are compared there.  Of other files only the smallest unit of a name can win, so targets that found
    nothing better meet names by equality, then the names' parts of the targets' own lengths; a target with a run of three
    characters that no name has meets none.
    """
    r, u = references.select("ref_id", "target", "path"), units.select("unit", "name", "path")
    names = stored(u.groupBy("name").agg(F.min("unit").alias("unit")), "names")
    compared = (F.length("target") >= 3) & (F.length("name") >= 3)
    best = lambda condition: F.min(F.when(condition, F.col("unit")))
    own = r.join(u, "path", "left").groupBy("path", "ref_id", "target").agg(
        best(F.col("target") == F.col("name")).alias("equal"), best(compared & F.contains("name", F.col("target"))).alias("holds"), best(compared & F.contains("target", F.col("name"))).alias("held")
    )
    own = stored(own.select("ref_id", "target", "equal", "holds", "held"), "own")
    ranked = lambda df, rank, unit: df.select("ref_id", F.struct(F.lit(rank).alias("rank"), unit.alias("unit")).alias("found"))
    here = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("rank"), F.col(c).alias("unit"))) for k, c in ((0, "equal"), (2, "holds"), (3, "held"))])
    found = [own.select("ref_id", here.alias("found")).filter("found is not null")]

    grams = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substr(F.col(c), i, F.lit(3))))
    runs = names.filter(F.length("name") >= 3).select(grams("name").alias("gram")).distinct()
    left = own.filter("equal is null").groupBy("target").agg(F.bool_or(F.col("holds").isNull()).alias("open"))
    missed = left.filter(F.length("target") >= 3).select("target", grams("target").alias("gram")).join(small(runs), "gram", "left_anti").select("target").distinct()
    left = stored(left.join(missed, "target", "left_anti"), "targets")
    rest = own.filter("equal is null").select("ref_id", "target")
    equal = left.join(names, F.col("target") == F.col("name")).select("target", "unit")
    found.append(ranked(rest.join(equal, "target"), 1, F.col("unit")))
    # a target that its own file holds has more points than any other file gives
    wanted = stored(left.filter("open").filter(F.length("target") >= 3).select("target").join(names.select(F.col("name").alias("target")), "target", "left_anti"), "wanted")
    sizes = sorted(x[0] for x in wanted.select(F.least(F.length("target"), F.lit(WHOLE)).alias("n")).distinct().collect())  # WHOLE numbers at most
    if sizes:
        part = lambda n: F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substr(F.col("name"), i, F.lit(n)))
        none = F.array().cast("array<string>")
        parts = names.withColumn("key", F.explode(F.array_distinct(F.concat(*[F.when(F.length("name") >= n, part(n)).otherwise(none) for n in sizes]))))
        short = parts.groupBy(F.col("key").alias("target")).agg(F.min("unit").alias("unit")).join(wanted, "target")
        long = wanted.filter(F.length("target") > WHOLE).withColumn("key", F.left("target", F.lit(WHOLE))).join(parts, "key").filter(F.contains("name", F.col("target")))
        other = short.filter(F.length("target") <= WHOLE).select("target", "unit").unionByName(long.groupBy("target").agg(F.min("unit").alias("unit")))
        found.append(ranked(rest.join(other, "target"), 3, F.col("unit")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("ref_id").agg(F.min("found").alias("found")).select("ref_id", "found.unit")


def remediation(finding_type: Column) -> Column:
    return S.first_match((F.regexp_like(finding_type, F.lit("(?i)" + p)), t) for p, t in REMEDIATIONS)


def unit_context(units: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """(unit, siblings, successors): up to n other units of the file, by line, and n callees, by name."""
    pairs = units.select("unit", "path").join(units.select(F.col("unit").alias("other"), "path", "start_line"), "path").filter("unit <> other")
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy("start_line", "other"))).filter(F.col("r") <= n)
    siblings = near.groupBy("unit").agg(F.array_sort(F.collect_list("other")).alias("siblings"))
    after = edges.select(F.col("src").alias("unit"), "dst").distinct().withColumn("r", F.row_number().over(Window.partitionBy("unit").orderBy("dst"))).filter(F.col("r") <= n)
    successors = after.groupBy("unit").agg(F.array_sort(F.collect_list("dst")).alias("successors"))
    none = F.array().cast("array<string>")
    return units.select("unit").join(siblings, "unit", "left").join(successors, "unit", "left").select("unit", F.coalesce("siblings", none).alias("siblings"), F.coalesce("successors", none).alias("successors"))


def relations(windows: DataFrame, text_col: str = "text", limit: int = 20) -> DataFrame:
    """(id, kind, target): distinct relations that patterns find in a window's text, at most `limit` by order of place."""
    found = F.flatten(F.array(*[_found(text_col, k, p) for k, p in RELATIONS.items()]))
    r = windows.select("id", F.explode(found).alias("r")).groupBy("id", "r.kind", "r.target").agg(F.min("r.at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("at", "kind", "target"))
    return r.withColumn("n", rank).filter(F.col("n") <= limit).select("id", "kind", "target")


def _found(text_col: str, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)), lambda x, i: F.struct(i.alias("at"), F.lit(kind).alias("kind"), x.alias("target")))


def stitched(windows: Column) -> Column:
    """Contents of windows (array of start_line, end_line, content) in order, those within one already taken left out."""
    none = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        fresh = w["end_line"] > acc["end"]
        return F.struct(F.greatest(acc["end"], w["end_line"]).alias("end"), F.when(fresh, F.concat(acc["out"], F.array(w["content"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(windows), none, step, lambda a: F.array_join(a["out"], "\n...\n"))


def packed_paragraphs(text: str, limit: int, overlap: int = 0) -> list[str]:
    """Paragraphs packed to chunks of at most `limit` estimated tokens; whole paragraphs of up to `overlap` tokens repeat.

    A paragraph over the limit is cut at the ends of sentences; a sentence over it stays whole.
    """
    import re

    def size(s: str) -> int:
        return int(len(re.findall(r"\w+", s)) * 1.3)

    parts: list[str] = []
    for p in text.split("\n\n"):
        parts += [p] if size(p) <= limit else [s for s in re.split(r"(?<=[.!?。])\s+", p) if s]
    out: list[str] = []
    now: list[str] = []
    for p in parts:
        if now and size("\n\n".join([*now, p])) > limit:
            out.append("\n\n".join(now))
            kept: list[str] = []
            while now and overlap and size("\n\n".join([now[-1], *kept])) <= overlap:
                kept.insert(0, now.pop())
            now = kept if size("\n\n".join([*kept, p])) <= limit else []
        now.append(p)
    return [*out, "\n\n".join(now)] if any(now) else out


def paragraph_chunks(docs: DataFrame, id_col: str, text_col: str, limit: int = 500, overlap: int = 0) -> DataFrame:
    """(id, pos, chunk) of packed_paragraphs; packing is a fold in order, so it runs on Arrow batches."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, c) for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for n, c in enumerate(packed_paragraphs(t or "", limit, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "chunk"])

    d = docs.select(id_col, text_col)
    return d.mapInPandas(work, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, pos long, chunk string")


def model_verdict(reply: Column) -> Column:
    """struct<valid, confidence> of a model's reply: its JSON, else words and the first number; numbers over 1 are percent."""
    j = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "is_valid boolean, confidence double")
    low = F.lower(reply)
    words = S.contains_any(low, ("valid", "true", "confirmed", "vulnerable")) & ~S.contains_any(low, ("invalid", "false positive", "not vulnerable"))
    number = F.regexp_extract(reply, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    raw = F.coalesce(j["confidence"], number, F.lit(0.5))
    return F.struct(F.coalesce(j["is_valid"], words).alias("valid"), F.least(F.lit(1.0), F.when(raw > 1, raw / 100).otherwise(raw)).alias("confidence"))


def reply_issues(replies: DataFrame) -> DataFrame:
    """(id, n, severity, text): issues of a model's free text, one a numbered line with the lines behind it; severity by its words."""
    l = replies.select("id", F.posexplode(F.split("reply", "\n")).alias("pos", "line"))
    order = Window.partitionBy("id").orderBy("pos")
    head = F.regexp_like("line", F.lit(r"^\s*(?:\d+[.)]|[-*])\s+\S"))
    l = l.withColumn("n", F.sum(head.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("n > 0")
    g = l.groupBy("id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), " ").alias("text"))
    t = F.lower("text")
    severity = S.first_match(((F.contains(t, F.lit(w)), w) for w in ("critical", "high", "medium", "low")), "medium")
    return g.select("id", "n", severity.alias("severity"), F.substring("text", 1, 100).alias("text"))


def path_risk(n_nodes: Column, kinds: Column, n_sanitized: Column, severity: Column | None = None) -> tuple[Column, Column]:
    """(risk, level) of a path of variables: its length, the kinds of its steps, sanitised steps, the finding's severity."""
    add = F.aggregate(kinds, F.lit(0.0), lambda acc, k: acc + F.when(k == "direct", 0.1).when(k == "parameter", 0.15).when(k == "return", 0.12).otherwise(0.0))
    base = (0.5 + F.least(F.lit(1.0), n_nodes / 10.0) * 0.2 + add) * F.when(n_sanitized > 0, 1.0 - n_sanitized * 0.2).otherwise(1.0)
    if severity is not None:
        base = base + F.when(severity.isin("high", "critical"), 0.2).when(severity == "medium", 0.1).otherwise(0.0)
    level = F.when(base >= 0.8, "dangerous").when(base >= 0.6, "tainted").when(n_sanitized > 0, "sanitized").otherwise("safe")
    return F.least(F.lit(1.0), base), level


def delivered(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """(message_id, agent): a message to one receiver, or without one to every other agent."""
    direct = messages.filter("receiver is not null").select("message_id", F.col("receiver").alias("agent"))
    rest = met(messages.filter("receiver is null").select("message_id", "sender"), agents.select("agent"), F.col("agent") != F.col("sender"))
    return direct.unionByName(rest.select("message_id", "agent"))


def history_of(messages: DataFrame, agent: str, limit: int) -> DataFrame:
    """An agent's latest messages, sent or received."""
    return messages.filter((F.col("sender") == agent) | (F.col("receiver") == agent)).orderBy(F.desc("ts"), F.desc("message_id")).limit(limit)


#: Words that begin an issue in a model's free text (fixed values).
ISSUE_WORDS = "vulnerability|issue|problem|error"


def keyword_issues(replies: DataFrame) -> DataFrame:
    """(id, n, text): issues of free text, each a line with one of ISSUE_WORDS and the lines behind it, joined by spaces."""
    l = replies.select("id", F.posexplode(F.split("reply", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    head = F.regexp_like(F.lower("line"), F.lit(ISSUE_WORDS)).cast("int")
    l = l.withColumn("n", F.sum(head).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).filter("n > 0")
    g = l.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return g.select("id", "n", F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("text"))


def reply_dependencies(replies: DataFrame) -> DataFrame:
    """(id, target, kind, line): distinct dependencies that a model's text lists, an entry of "- " a dependency.

    replies: id, reply.  An entry names its target ("target: x"), and may its type and location; others are left out.
    """
    from ..functions.text import text_property

    items = F.filter(F.split("reply", r"(?m)^- "), lambda x: F.contains(F.lower(x), F.lit("target")))
    e = replies.select("id", F.explode(items).alias("item"))
    e = e.select("id", text_property(F.col("item"), "target").alias("target"), F.coalesce(text_property(F.col("item"), "type"), F.lit("unknown")).alias("kind"), F.regexp_extract(text_property(F.col("item"), "location"), r"(\d+)", 1).try_cast("int").alias("line"))
    return e.filter("target is not null").groupBy("id", "target", "kind").agg(F.min("line").alias("line"))
