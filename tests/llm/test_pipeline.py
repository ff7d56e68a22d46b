"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline as P
from codeglint.llm import mixing, pii, quality
from test_near_dup import brute
from test_pii import base


def test_stages(spark, sf, docs):
    columns, now = docs.columns, docs
    kept = P.quality_rules(spark, now, sf)
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.with_quality(docs).collect() if r.kept}
    first = P.near_duplicates(spark, kept, sf)
    assert first.columns == columns
    assert {r.doc_id for r in first.collect()} == {i for i, _, _, k in brute([(r.doc_id, r.text) for r in kept.collect()], 5, 80) if k}
    masked = P.personal_data(spark, first, sf)
    assert masked.columns == columns and masked.count() == first.count()
    before = {r.doc_id: r.text for r in first.collect()}
    for r in masked.collect():
        assert r.n_chars == len(r.text) and not base(r.text)
        assert r.text == before[r.doc_id] or base(before[r.doc_id]) or "[" in r.text
    mix = P.target_mix(spark, masked, sf)
    assert mix.columns == columns
    times = {r.doc_id: r.epochs + r.picked for r in mixing.mixed(masked).collect()}
    assert Counter(r.doc_id for r in mix.collect()) == Counter({i: n for i, n in times.items() if n})
    assert P.tokens(spark, mix, sf).count() == mix.count()
    assert P.run(spark, sf).count() == mix.count()


def test_empty(spark, sf, none):
    now = none
    for _, stage in P.STAGES:
        now = stage(spark, now, sf)
    assert now.collect() == []


def test_nulls(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the of and to in is that for it on " * 20, "en", "a", 3), (4, " ".join(f"the word{i} of" for i in range(60)), None, None, None)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        now = stage(spark, now, sf)
    assert {r.doc_id for r in now.collect()} == {4}
    assert pii.KINDS
