"""Personal data against brute force, the aggregation of votes, masking."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeglint.llm import pii, registry as queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_op6(spark, sf, docs):
    got = {r.doc_id: r for r in queries.op6_pii(spark, sf).collect()}
    for r in docs.collect():
        want, g = base(r.text), got[r.doc_id]
        assert g.base_sha256 == digest(want)
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == x[0] for x in want) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(g.spans.split(","))


ALPHABET = "a.@0128+- ()_%é\U0001f600"
TEXTS: list[str] = []


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=40))
def test_collect_texts(text):
    TEXTS.append(text)


def test_spans_of_random_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + ["a@b.c_x@d.e", "a@b@c.d", "x@y..z@q.w", "1.2.3.4.5.6.7.8", "999.1.1.1", "0010.1.1.1", "4111 1111 1111 1111", "+1 (017) 555-7713", "9" * 30_000, "1 " * 30_000, "a" * 100_000])]
    got = {r.doc_id: r.b for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()}
    for i, t in rows:
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in base(t)), t[:80]


def test_odd_rows(odd, none):
    got = pii.with_spans(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all([tuple(x) for x in r.base] == base(texts[r.doc_id]) for r in got)
    assert pii.with_spans(none).collect() == []


def test_votes_are_aggregated():
    """Two agreeing labelers outweigh one that votes at random."""
    patterns = {("card", "+++++"): 60, ("card", "-----"): 300, ("card", "++0++"): 80, ("card", "--0--"): 500, ("card", "++0-+"): 30, ("card", "--0+-"): 40}
    _, table, post = pii.reliabilities(patterns)
    assert post["card", "++0++"] > 0.95 and post["card", "--0--"] < 0.05
    assert table["card"][0]["+"][1] > 0.8 and table["card"][0]["+"][0] < 0.2
    w = pii.span_classifier(patterns, post)
    odds = {v: sum(w[f] for f in [("kind", "card"), *zip(pii.LABELERS, v)]) for _, v in patterns}
    assert odds["++0++"] > 0 > odds["--0--"]


def test_more_spans_are_added(spark):
    rows = [(i, f'call tel 415-555-{1000 + i} or token = "abcdef0123456789abcdef{i:02d}" now') for i in range(30)] + [(99, "plain words only")]
    got = {r.doc_id: r.spans for r in pii.span_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].startswith("phone:9:21,secret:") and got[99] == ""


def test_masking(spark):
    row = [(1, "mail é.x@y.org and x@y.org, 10.20.30.40!")]
    assert pii.masked_documents(spark.createDataFrame(row, "doc_id long, text string")).first().text == "mail é[EMAIL] and [EMAIL], [IP]!"


def test_masking_keeps_all_columns(spark, none):
    """Columns named like the operator's own, none for the size, null and repeated rows."""
    rows = [(1, "a@b.org", "x", "y"), (1, "a@b.org", "x", "y"), (None, None, None, None), (3, "", "z", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base string")
    for extra in ("_text", "_found", "_row", "_base", "_new", "_placed", "text.size"):
        df = df.withColumn(extra, F.lit(extra))
    got = pii.masked_documents(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("a@b.org", "[EMAIL]") for r in df.collect())
    sized = spark.createDataFrame([(1, "a@b.org", 7), (2, None, 5)], "doc_id long, text string, n_chars int")
    assert sorted((r.doc_id, r.n_chars) for r in pii.masked_documents(sized).collect()) == [(1, 7), (2, 5)]
    assert pii.masked_documents(none).collect() == []


def test_thousands_of_matches(spark):
    """Ten thousand addresses, numbers and more in one text: spans, other candidates and masks as in small texts, in seconds."""
    import time

    draw = random.Random(4)
    part = lambda i: draw.choice([f"é mail u{i}@h{i}.org", f"{i % 256}.2.3.4", f"+49 30 {1000000 + i}", f"tel 415-555-{1000 + i % 9000}", "\U0001f600 words", f'token = "abcdef0123456789{i:06d}"'])
    text = " ".join(part(i) for i in range(15_000))
    df = spark.createDataFrame([(1, text), (2, "a@b.org " * 10_000)], "doc_id long, text string")
    pii.masked_documents(df.limit(0)).collect()
    began = time.time()
    got = {r.doc_id: r for r in pii.with_spans(df).collect()}
    plain = base(text)
    assert [tuple(x) for x in got[1].base] == plain and len(got[2].base) == 10_000
    known = set(plain)
    more = [x for x in got[1].spans if tuple(x) not in known] if len(got[1].spans) > len(plain) else []
    assert more and not any(a < y.end and y.start < b for _, a, b in plain[:300] for y in more)
    masks = {r.doc_id: r.text for r in pii.masked_documents(df).collect()}
    assert masks[2] == "[EMAIL] " * 10_000 and masks[1] == mask(text, got[1].spans)
    assert time.time() - began < 60


def mask(text, spans):
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, s.end, s.kind)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_prefixes_parts_and_masks(spark):
    """Prefixes over several levels, parts across pieces, masks of overlapping spans, candidates that touch base spans."""
    draw = random.Random(9)
    values = [[draw.randrange(50) for _ in range(n)] for n in (1, 15, 16, 17, 256, 257, 5000)]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>")
    for r in df.select("v", pii._sums(F.col("v")).alias("s"), pii._maxima(F.col("v")).alias("m")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))] and r.m == [max([-1, *r.v[:i]]) for i in range(len(r.v))]
    text = "".join(draw.choices("aé\U0001f600\n ", k=5000))
    cuts = [(a, b) for a, b in (sorted(draw.choices(range(5001), k=2)) for _ in range(60))] + [(0, 0), (5000, 5000), (0, 5000), (1024, 2048), (1023, 1025)]
    parts = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a int, b int").select(pii._part(pii._pieces(F.col("t")), F.col("a"), F.col("b")).alias("p"), "a", "b")
    assert all(r.p == text[r.a : r.b] for r in parts.collect())
    kind = "array<struct<kind:string,start:int,end:int>>"
    sets = [[(k, a, min(5000, a + draw.randrange(1, 90))) for k in draw.choices(("email", "ip"), k=n) for a in [draw.randrange(4900)]] for n in (1, 3, 40, 300)]
    for r in spark.createDataFrame([(text, s) for s in sets], f"t string, s {kind}").select("s", pii.masked(F.col("t"), F.col("s")).alias("m")).collect():
        assert r.m == mask(text, r.s)
    pairs = [(sets[1], sets[2]), (sets[2], sets[3]), ([], sets[1]), (sets[1], [])]
    for r in spark.createDataFrame(pairs, f"b {kind}, m {kind}").select("b", "m", pii._clear(F.col("b"), F.col("m")).alias("k")).collect():
        assert sorted(map(tuple, r.k)) == sorted(tuple(x) for x in r.m if not any(b.start < x.end and x.start < b.end for b in r.b))
