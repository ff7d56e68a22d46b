"""Personal data by weak-supervision aggregation, in DataFrame operations only.

Regular expressions find base spans and further candidates.  Five labelers (format, gazetteer, context, variety, length) vote
+, - or 0 on each candidate.  The corpus is summed up as counts of vote patterns by kind, a table of at most
kinds * 3^5 rows; on these counts expectation-maximisation estimates each labeler's reliability without labels, and the
posteriors train a logistic span classifier.  Its weights become a column expression that decides on every candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret",)
LABELERS = ("format", "gazetteer", "context", "variety", "length")
VOTES = "+-0"

# Each pattern matches as the plain one beside it does, leftmost and not overlapping, but in linear time on long runs: a match
# begins where a run begins or the last match ended, and runs aren't given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates that no base pattern covers, and their kinds.
MORE_PATTERNS = {
    "local_phone": ("phone", r"(?<![0-9+().-])(?<![0-9+.)-][\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "masked_email": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z]{2,24}"),
    "secret": ("secret", r"(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY)[\"']?[\x20]{0,3}[=:][\x20]{0,3}[\"']?)[A-Za-z0-9/+_-]{16,}"),
}
#: What a text must have for a pattern to be tried.
GATES = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]", "local_phone": "[0-9][\\x20.-][0-9]", "masked_email": "[(\\[]at[)\\]]", "secret": "[=:]"}

# Gazetteers and context words (fixed values).
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "eu", "uk", "de", "fr", "es", "it", "nl", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br", "example", "test")
CALLING_CODES = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6)"
RESERVED = r"^0*(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
CONTEXT = {
    "email": "mail|contact|write|e-mail|schreib|correo|courriel",
    "ip": "\\bip\\b|host|server|address|login|adresse",
    "card": "card|visa|master|credit|karte|carte|tarjeta|payment",
    "phone": "tel|phone|call|fax|mobile|anruf|appel|llam",
    "secret": "token|secret|passw|key",
}
AGAINST = "version|section|isbn|page|chapter|article|§|license"


#: Prefixes are taken within groups of so many elements, groups of groups, and so on for LEVELS levels; code points of a piece of text.
GROUP, LEVELS, PIECE = 32, 4, 1024


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _prefixes(values: Column, zero: Column, both, level: int = 0) -> Column:
    """What both() makes of all elements before each; values isn't empty.

    No accumulator grows: an element meets those before it in its group, and the groups before as one element each.  The work is
    GROUP / 2 steps an element and level, up to GROUP^LEVELS elements.
    """

    def within(x: Column, start: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.aggregate(F.slice(x, F.lit(1), i), start, both))

    def spread(groups: Column) -> Column:
        before = _prefixes(F.transform(groups, lambda g: F.aggregate(g, zero, both)), zero, both, level + 1)
        return F.flatten(F.zip_with(groups, before, within))

    def whole(x: Column) -> Column:
        if level == LEVELS:
            return within(x, zero)
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / GROUP).cast("int")), lambda g: F.slice(x, g * GROUP + 1, F.lit(GROUP)))
        # a single group needs no level above it
        return F.when(F.size(x) <= GROUP, within(x, zero)).otherwise(_bound(groups, spread))

    return _bound(values, whole)


def _sums(values: Column) -> Column:
    return _prefixes(values, F.lit(0), lambda a, x: a + x)


def _maxima(values: Column) -> Column:
    """The largest element before each, -1 for the first; elements aren't negative."""
    return _prefixes(values, F.lit(-1), lambda a, x: F.greatest(a, x))


def _pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points, so that a part of it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """The code points of a text from start to end (exclusive, both within it), by its pieces."""
    a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    head = F.coalesce(F.get(pieces, a), F.lit(""))
    one = F.substr(head, start - a * PIECE + 1, end - start)
    inside = F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    many = F.concat(F.substr(head, start - a * PIECE + 1, F.lit(PIECE)), inside, F.substr(F.coalesce(F.get(pieces, b), F.lit("")), F.lit(1), end - b * PIECE))
    return F.when(a == b, one).otherwise(many)


def _spans(text: Column, name: str, pattern: str, kind: str) -> Column:
    """array<struct<kind, start, end, s, name>> of all matches; positions count code points, the end is exclusive."""
    cell = "struct<kind:string,start:int,end:int,s:string,name:string>"

    def placed(x: Column) -> Column:
        found, lengths = x["found"], F.transform(F.sequence(F.lit(0), F.size(x["found"]) - 1), lambda i: F.length(F.get(x["gaps"], i)) + F.length(F.get(x["found"], i)))

        def one(i: Column, before: Column) -> Column:
            a = before + F.length(F.get(x["gaps"], i))
            return F.struct(F.lit(kind).alias("kind"), a.alias("start"), (a + F.length(F.get(found, i))).alias("end"), F.get(found, i).alias("s"), F.lit(name).alias("name"))

        return F.when(F.size(found) > 0, F.zip_with(F.sequence(F.lit(0), F.size(found) - 1), _bound(lengths, _sums), one).cast(f"array<{cell}>"))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    out = _bound(both, placed)
    return F.coalesce(F.when(F.regexp_like(text, F.lit(GATES[name])), out), F.array().cast(f"array<{cell}>"))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))

    total = F.aggregate(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), step, lambda a: a["sum"])
    return total % 10 == 0


def _valid(x: Column) -> Column:
    """Whether a match of a base pattern is personal data by the base rules."""
    s, n = x["s"], F.length(_digits(x["s"]))
    parts = F.forall(F.split(s, "\\."), lambda p: F.regexp_like(p, F.lit("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$")))
    return (
        F.when(x["name"] == "email", F.lit(True))
        .when(x["name"] == "ip", parts)
        .when(x["name"] == "card", F.when(n.between(13, 19), _luhn(_digits(s))).otherwise(F.lit(False)))
        .when(x["name"] == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )


def _votes(x: Column, pieces: Column) -> Column:
    """One character of VOTES for each labeler."""
    s, name, digits = x["s"], x["name"], _digits(x["s"])
    before = F.lower(_part(pieces, F.greatest(x["start"] - 32, F.lit(0)), x["start"]))

    def vote(yes: Column, no: Column | None = None) -> Column:
        return F.when(yes, F.lit("+")).when(F.lit(True) if no is None else no, F.lit("-")).otherwise(F.lit("0"))

    based = name.isin(*KINDS)
    gazetteer = (
        F.when(x["kind"] == "email", F.lower(F.regexp_extract(s, "[A-Za-z]+$", 0)).isin(*TOP_DOMAINS))
        .when(name == "ip", ~F.regexp_like(s, F.lit(RESERVED)))
        .when(name == "card", F.regexp_like(digits, F.lit(ISSUERS)))
        .when(name == "phone", F.regexp_like(s, F.lit(CALLING_CODES)))
        .when(name == "local_phone", F.regexp_like(digits, F.lit("^[2-9]")))
        .otherwise(F.regexp_like(s, F.lit("[0-9]")) & F.regexp_like(s, F.lit("[A-Za-z]")))
    )
    context = F.lit(False)
    for kind, words in CONTEXT.items():
        context = F.when(x["kind"] == kind, F.regexp_like(before, F.lit(words))).otherwise(context)
    variety = F.size(F.array_distinct(F.split(F.when(x["kind"].isin("email", "secret"), s).otherwise(digits), "")))
    length = (
        F.when(x["kind"] == "email", F.length(s).between(6, 64))
        .when(name == "ip", F.length(s).between(7, 15))
        .when(name == "card", F.length(digits).between(14, 16))
        .when(x["kind"] == "phone", F.length(digits).between(10, 13))
        .otherwise(F.length(s).between(20, 128))
    )
    return F.concat(
        vote(x["ok"], based), vote(gazetteer), F.when(context, F.lit("+")).when(F.regexp_like(before, F.lit(AGAINST)), F.lit("-")).otherwise(F.lit("0")), vote(variety >= 4), vote(length)
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `_found`: array<struct<kind, start, end, ok, votes>>, base matches of KINDS first, each kind by start.

    ok marks the base spans.  A null text counts as empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    parts = [_spans(text, k, p, k) for k, p in PATTERNS.items()] + [_spans(text, n, p, k) for n, (k, p) in MORE_PATTERNS.items()]
    placed = docs.withColumn("_placed", F.concat(*parts))
    judged = F.transform("_placed", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), x["name"].alias("name"), _valid(x).alias("ok")))
    placed = placed.withColumn("_judged", judged)

    def voted(pieces: Column) -> Column:
        return F.transform("_judged", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["ok"].alias("ok"), _votes(x, pieces).alias("votes")))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,ok:boolean,votes:string>>")
    return placed.withColumn("_found", F.when(F.size("_judged") > 0, _bound(_pieces(text), voted)).otherwise(none)).drop("_placed", "_judged")


# Aggregation of votes: small arithmetic on the driver over pattern counts ---------------------------------------------


def reliabilities(patterns: dict[tuple[str, str], int], rounds: int = 50) -> tuple[dict[str, float], dict[str, list[dict[str, list[float]]]], dict[tuple[str, str], float]]:
    """EM over counts of (kind, votes): prior of each kind, P(vote | class) of each labeler by kind, posterior of each pattern.

    Starts from the share of + among the votes cast; smoothing keeps kinds with few candidates near the labelers' meaning.
    """
    post = {}
    for kind, votes in patterns:
        cast = sum(v != "0" for v in votes)
        post[kind, votes] = (votes.count("+") + 0.5) / (cast + 1.0)
    prior: dict[str, float] = {}
    table: dict[str, list[dict[str, list[float]]]] = {}
    for _ in range(rounds):
        for kind in {k for k, _ in patterns}:
            rows = [(v, n, post[k, v]) for (k, v), n in patterns.items() if k == kind]
            total = sum(n for _, n, _ in rows)
            prior[kind] = (sum(n * p for _, n, p in rows) + 2.0) / (total + 4.0)
            table[kind] = []
            for i in range(len(LABELERS)):
                # pseudo-counts: + speaks for, - against, each twice as likely as not
                weight = {"+": [1.0, 2.0], "-": [2.0, 1.0], "0": [1.5, 1.5]}
                for v, n, p in rows:
                    weight[v[i]][1] += n * p
                    weight[v[i]][0] += n * (1 - p)
                sums = [sum(weight[v][c] for v in VOTES) for c in (0, 1)]
                table[kind].append({v: [weight[v][c] / sums[c] for c in (0, 1)] for v in VOTES})
        for kind, votes in patterns:
            logit = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(table[kind][i][v][1] / table[kind][i][v][0]) for i, v in enumerate(votes))
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    return prior, table, post


def span_classifier(patterns: dict[tuple[str, str], int], post: dict[tuple[str, str], float], rounds: int = 400, rate: float = 1.0) -> dict[tuple[str, str], float]:
    """Logistic regression on kinds and votes, fitted to the posteriors: weights by (feature, value)."""
    kinds = sorted({k for k, _ in patterns})
    w = {("kind", k): 0.0 for k in kinds} | {(name, v): 0.0 for name in LABELERS for v in VOTES}
    rows = [([("kind", k), *zip(LABELERS, v)], n, post[k, v]) for (k, v), n in sorted(patterns.items())]
    total = sum(n for _, n, _ in rows) or 1
    for _ in range(rounds):
        grad = {f: 1e-4 * x for f, x in w.items()}
        for features, n, p in rows:
            guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in features)))))
            for f in features:
                grad[f] += n / total * (guess - p)
        for f in w:
            w[f] -= rate * grad[f]
    return w


def decision(x: Column, w: dict[tuple[str, str], float]) -> Column:
    """The classifier's log-odds of a candidate."""

    def weigh(name: str, value: Column) -> Column:
        out = F.lit(0.0)
        for (f, v), weight in w.items():
            if f == name:
                out = F.when(value == v, F.lit(weight)).otherwise(out)
        return out

    total = weigh("kind", x["kind"])
    for i, name in enumerate(LABELERS):
        total = total + weigh(name, F.substring(x["votes"], i + 1, 1))
    return total


def _clear(base: Column, more: Column) -> Column:
    """Of more, in order of their ends, what overlaps no span of base.

    Ends of more and starts of base in one order: x overlaps if some base span that starts before x's end ends behind x's start.
    """

    def kept(both: Column) -> Column:
        starts = F.transform(both["base"], lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("kind"), b["end"].alias("end"), F.lit(None).cast("int").alias("i")))
        ends = F.transform(both["more"], lambda x, i: F.struct(x["end"].alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("end"), i.alias("i")))

        def judged(events: Column) -> Column:
            return F.zip_with(events, _maxima(F.transform(events, lambda e: e["end"])), lambda e, m: F.struct(F.get(both["more"], e["i"]).alias("x"), m.alias("last")))

        fine = F.filter(_bound(F.array_sort(F.concat(starts, ends)), judged), lambda j: j["x"].isNotNull() & (j["last"] <= j["x"]["start"]))
        return F.when((F.size(both["more"]) > 0) & (F.size(both["base"]) > 0), F.transform(fine, lambda j: j["x"])).otherwise(both["more"])

    return _bound(F.struct(base.alias("base"), more.alias("more")), kept)


def _spanned(rows: DataFrame) -> DataFrame:
    """_row, base and spans of rows (_row, _text); _row may hold anything."""
    found = stored(candidates(rows, "_text").select("_row", "_found"), "pii-candidates")
    counted = found.select(F.explode("_found").alias("c")).groupBy("c.kind", "c.votes").count()
    patterns = {(r.kind, r.votes): r["count"] for r in counted.collect()}  # at most kinds * 3^5 rows
    cell = "array<struct<kind:string,start:int,end:int>>"
    base = F.filter("_found", lambda x: x["ok"])
    more = F.array().cast("array<struct<kind:string,start:int,end:int,ok:boolean,votes:string>>")
    if patterns:
        w = span_classifier(patterns, reliabilities(patterns)[2])
        clear = F.filter("_found", lambda x: ~x["ok"] & (decision(x, w) > 0))
        more = _clear(F.col("_base"), clear)
    found = found.withColumn("_base", base)

    def plain(a: Column) -> Column:
        return F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).cast(cell)

    spans = F.concat(plain(F.col("_base")), plain(more))
    order = F.array(*[F.lit(k) for k in (*KINDS, *EXTRA_KINDS)])
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return found.select("_row", plain(F.col("_base")).alias("base"), plain(ranked).alias("spans"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and spans: array<struct<kind, start, end>>, one row per row of docs; other columns are not read.

    base: the base spans by kind, then start.  spans: these and the candidates that the classifier takes and that overlap no
    base span.  A null text counts as empty and has no span; without candidates there is no classifier.  An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return _spanned(rows).select(F.col("_row").alias(id_col), "base", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every whole text.

    One row per row of docs, also of a null or repeated id; a null or empty text has no span, other columns are not read, and an
    empty table gives an empty result.
    """
    d = with_spans(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first stands for all."""

    def groups(x: Column) -> Column:
        """The first span of each run of overlapping ones, with the end of what is masked before it."""
        past = F.zip_with(x, _maxima(F.transform(x, lambda s: s["end"])), lambda s, m: F.struct(s.alias("s"), F.greatest(m, F.lit(0)).alias("past")))
        return F.filter(past, lambda p: p["s"]["start"] >= p["past"])

    def replaced(x: Column) -> Column:
        by_start = F.array_sort(F.transform(x["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        marks = F.transform(_bound(by_start, groups), lambda p: F.concat(_part(x["pieces"], p["past"], p["s"]["start"]), F.lit("["), F.upper(p["s"]["kind"]), F.lit("]")))
        rest = _bound(F.array_max(F.transform(x["spans"], lambda s: s["end"])), lambda last: _part(x["pieces"], last, x["size"]))
        return F.concat(F.array_join(marks, ""), rest)

    parts = F.struct(spans.alias("spans"), _pieces(text).alias("pieces"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, _bound(parts, replaced)).otherwise(text)


def masked_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The rows of docs with all spans of their texts masked, in the columns of docs, whatever those are named.

    size_col, if docs has it, follows the text; it stays as it is where the text is null.  A null text stays null.  An empty
    table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = _spanned(docs.select(row.alias("_row"), F.col(f"`{text_col}`").alias("_text")))
    old = F.col("_row").getField(text_col)
    found = found.withColumn("_new", F.when(F.size("spans") > 0, masked(old, F.col("spans"))).otherwise(old))

    def column(c: str) -> Column:
        value = F.col("_row").getField(c)
        if c == text_col:
            value = F.col("_new")
        elif c == size_col:
            value = F.coalesce(F.length("_new").cast(docs.schema[c].dataType), value)
        return value.alias(c)

    return found.select(*[column(c) for c in docs.columns])
