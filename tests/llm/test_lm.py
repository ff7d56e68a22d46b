"""Language-model scores: base by brute force, normalisation, training."""

import math
from collections import Counter

import numpy as np
import pytest

from codeglint.llm import lm, registry as queries
from codeglint.llm.common import fold_of


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def base(rows):
    c = Counter(w for i, t in rows if fold_of(i, 7) != 2 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, fold_of(i, 7) == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def check(got, rows):
    got, want = sorted(map(tuple, got), key=lambda r: (str(r[0]), r[2], r[5])), sorted(base(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] < 0


def test_op10(spark, sf, docs):
    check(queries.op10_lm(spark, sf).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_small_head_uses_the_join(docs, odd, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.scored(docs, head=50, classes=40).collect()
    check(got, rows)
    whole = {r.doc_id: r.score for r in lm.scored(docs, classes=40).collect()}
    assert all(r.score == pytest.approx(whole[r.doc_id]) for r in got)
    check(lm.scored(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert lm.scored(none).collect() == []


def test_the_end_is_always_known(spark):
    """A head smaller than the ties of its first bin."""
    one = spark.createDataFrame([(0, "a b c d")], "doc_id long, text string")
    assert fold_of(0, 7) != 2
    for head in (1, 2, 3, 5, 9):
        got = lm.scored(one, head=head).first()
        assert got.n_known == 5 and got.base_score == pytest.approx(5 * math.log10(2 / 11))
    counts = spark.createDataFrame([(w, c) for w, c in zip([b"", b"d", b"c", b"b", b"a"], [1, 1, 1, 1, 2])], "word binary, c long")
    assert [bytes(r.word) for r in lm.most_frequent(counts, 4)] == [b"a", b"", b"b", b"c"]


def naive_score(scorer, counts, total, text):
    """Token by token: the class's normalised probability, and the word's share of the rest."""
    words = {w: (2 + i if i < scorer.known else lm.REST) for i, w in enumerate(w for w in scorer.words if w != b"")} | {b"": lm.END}
    first, second, _ = scorer.tables
    members = {w for w, c in words.items() if c != lm.REST}
    inside = sum(counts.get(w, 0) for w in members)
    known = len([w for w in members if w in counts])
    out, last, before = 0.0, lm.END, lm.END
    for w in tokens(text):
        c = words.get(w, lm.REST)
        s = first[last].astype(float) + second[before].astype(float)
        out += (s[c] - math.log(np.exp(s).sum())) / math.log(10)
        if c == lm.REST:
            out += math.log10((counts.get(w, 0) + 1) / (total - inside + len(counts) - known + 1))
        last, before = c, last
    return out


def test_score_equals_a_naive_scorer(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stored = lm.stored(lm.word_counts(docs, "doc_id", "text", 7, 2), "test-counts")
    scorer, total = lm.trained_scorer(docs, stored, "doc_id", "text", 7, 2, head=400, classes=40)
    counts = {bytes(r.word): r.c for r in stored.collect()}
    got = {r.doc_id: r.score for r in lm.scored(docs, head=400, classes=40).collect()}
    for i, t in rows[:60]:
        assert got[i] == pytest.approx(naive_score(scorer, counts, total, t), rel=1e-5)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    m = lm.LogBilinear(r.random(30) + 0.1)
    seq = r.integers(0, 30, 3000)
    m.train(np.stack([seq[1:-1], seq[:-2]], axis=1), seq[2:], epochs=1)
    first, second, log_z = m.tables()
    p = np.exp(first[:, None, :] + second[None, :, :] - log_z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)


def test_all_words_sum_to_one(docs):
    """Over every known word and one unseen, in any context."""
    counts = lm.stored(lm.word_counts(docs, "doc_id", "text", 7, 2), "test-counts")
    scorer, total = lm.trained_scorer(docs, counts, "doc_id", "text", 7, 2, classes=64)
    scorer.ready()
    words = [bytes(r.word) for r in counts.collect()]
    texts = [b"the " + w for w in words if w] + [b"the zzzzunseen"]
    before = scorer.group([b"the"])[3][0]
    ends = {t: scorer.group([t])[3][0] for t in texts[:200]}
    cls = scorer.classes
    first, second, log_z = scorer.tables
    the = cls[scorer.index[b"the"]]
    p_class = np.exp(first[the] + second[lm.END] - log_z[the, lm.END])
    rest = [w for w in words if cls[scorer.index.get(w, len(scorer.words))] == lm.REST]
    share = sum((scorer.counts[scorer.index[w]] + 1) / 10**scorer.log_rest for w in rest) + 1 / 10**scorer.log_rest
    assert p_class.sum() == pytest.approx(1, abs=1e-4) and share == pytest.approx(1, abs=1e-6)
    assert all(math.isfinite(x) for x in [before, *ends.values()])


def test_training_learns():
    """A model of an alternating language beats its unigram."""
    seq = np.tile([2, 3, 4], 2000)
    m = lm.LogBilinear(np.bincount(seq, minlength=6) + 1.0)
    m.train(np.stack([seq[1:-1], seq[:-2]], axis=1), seq[2:], epochs=6)
    first, second, log_z = m.tables()
    assert np.exp(first[3, 4] + second[2, 4] - log_z[3, 2]) > 0.8


def test_model_beats_unigram_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = [r for r in queries.op10_lm(spark, sf).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_training_reads_every_token(docs, odd):
    """Each word of each training document is trained on once, at any size, long texts and null ids too."""
    for df in (docs, odd):
        counts = lm.stored(lm.word_counts(df, "doc_id", "text", 7, 2), "test-counts")
        words = lm.most_frequent(counts, 100)
        total = counts.agg(lm.F.sum("c")).first()[0]
        empty = lm.Scorer([bytes(r.word) for r in words], np.array([r.c for r in words], np.int64), total, counts.count(), None, 40)
        assert lm.trained_model(df, "doc_id", "text", 7, 2, empty, np.ones(40), total)[1] == total


def test_vocabulary_grows():
    assert lm.classes_for(0) == lm.CLASSES < lm.classes_for(40_000_000) < lm.classes_for(10**12) == lm.MOST_CLASSES


def test_mean_of_states_is_weighted():
    rows = [(1, 3, np.full(4, 2, np.float32).tobytes()), (0, 1, np.full(4, 6, np.float32).tobytes()), (2, 0, np.zeros(4, np.float32).tobytes())]
    n, mean = lm.mean_state(rows)
    assert n == 4 and mean.tolist() == [3] * 4 and lm.mean_state([])[1] is None


def test_mean_of_many_partitions_takes_levels(spark, monkeypatch):
    monkeypatch.setattr(lm, "MEANS", 3)
    monkeypatch.setattr(lm, "LAST_MEANS", 2)
    rows = [(i, i % 4, bytearray(np.full(5, i, np.float32).tobytes())) for i in range(40)]
    df = spark.createDataFrame(rows, "part int, n long, state binary").repartition(40)
    n, mean = lm.averaged(df, 40)
    assert n == sum(r[1] for r in rows)
    assert mean.tolist() == pytest.approx([sum(r[0] * r[1] for r in rows) / n] * 5, rel=1e-5)
    assert lm.averaged(df.limit(0), 40) == (0, None)
