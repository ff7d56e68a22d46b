"""Near duplicates against brute force."""

import random
from collections import defaultdict

import pytest

from codeglint.llm import near_dup as N
from codeglint.llm import registry as queries


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, of):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= of * len(a | b):
                u, v = sorted((root(i), root(j)))
                parent[v] = u
    return {(i, len(s), root(i), root(i) == i) for i, s in sets if i is not None}


def test_op5(spark, sf, docs):
    assert set(map(tuple, queries.op5_near_dup(spark, sf).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 85)


def variants(n, seed, edits, length=120):
    r = random.Random(seed)
    words = [f"w{r.randrange(50_000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        copy = words[:]
        for _ in range(r.randrange(edits)):
            copy[r.randrange(length)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("s", [N.Settings(words=3, of=85), N.Settings()])
def test_large_groups(spark, s):
    """Groups far larger than a small bucket, near and beyond the threshold, with copies."""
    texts = variants(70, 1, 8) + variants(60, 2, 5) + variants(12, 3, 3) + ["same words here again and once more"] * 30
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {tuple(r) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()}
    want = brute(rows, s.words, s.of)
    assert got == want
    sizes = defaultdict(int)
    for _, _, c, _ in want:
        sizes[c] += 1
    assert max(sizes.values()) > N.SMALL


def test_odd_rows(odd, none):
    got = [tuple(r) for r in N.near_duplicates(odd, N.Settings(words=3, of=85)).collect()]
    assert len(got) == odd.count()
    assert {r for r in got if r[0] is not None} == brute([(r.doc_id, r.text) for r in odd.collect()], 3, 85)
    assert [r[3] for r in got if r[0] is None] == [False]
    assert N.near_duplicates(none).collect() == []
    kept = N.without_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8]


def test_repeats_of_null_and_equal_ids(spark):
    """Of exact repeats one row stays, with an id if one has; other rows of one id stay."""
    same, other = "one two three four five six seven", "all other words in here that are not the same"
    rows = [(1, same, "x"), (None, same, "x"), (1, same, "x"), (2, other, "y"), (2, "and a third text of quite different words", "y"), (None, "null one two three alone here", "z"), (None, "null one two three alone here", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("_row", N.F.lit(1))
    got = N.without_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text[:3]) for r in got.collect()) == [(0, "nul"), (1, "one"), (2, "all"), (2, "and")]


def test_hubs_and_shuffled_joins(spark, monkeypatch):
    """Links beyond what is broadcast: hubs by broadcast, the rest by a shuffle."""
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    monkeypatch.setattr(N, "HUB", 5)
    links = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(100, 130)] + [(39, 130), (500, 501)]
    got = {r.id: r.component for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(40), *range(100, 131)]} | {500: 500, 501: 500}
    docs = spark.createDataFrame(list(enumerate(variants(30, 1, 4))), "doc_id long, text string")
    assert N.without_near_duplicates(docs).count() == sum(k for *_, k in brute([tuple(r) for r in docs.collect()], 5, 80))


def test_pruning_bounds():
    s = N.Settings(words=3, of=85)
    assert 1 - (1 - 0.85**5) ** s.bands >= 1 - s.miss
    least = s.least_matches()
    assert least[-1][0] == s.hashes and all(0 < m < n for n, m in least)
    # a pair at the threshold is lost by pruning about as rarely as was chosen
    import numpy as np

    r = np.random.default_rng(0)
    a = np.zeros((20_000, s.hashes), np.uint32)
    b = (r.random((20_000, s.hashes)) >= 0.85).astype(np.uint32)
    assert len(N.survivors(a, b, s)) >= 19_990
    far = (r.random((20_000, s.hashes)) >= 0.4).astype(np.uint32)
    assert len(N.survivors(a, far, s)) == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
