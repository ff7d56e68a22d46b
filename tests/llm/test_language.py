"""Language identification: gradients, held-out accuracy, odd rows."""

import numpy as np
import pytest

from codeglint.llm import language_id as L
from codeglint.llm import registry as queries
from codeglint.llm.common import fold_of


def test_gradients():
    m = L.BiGRU(["x", "y"], hidden=3)
    r = np.random.default_rng(0)
    x, y, mask = r.integers(0, 256, (5, 4)), np.array([0, 1, 1, 0]), np.ones((5, 4))
    mask[3:, 1] = 0
    _, grads = m.loss(x, y, mask)
    for name, a in m.p.items():
        spots = [np.unravel_index(i, a.shape) for i in r.integers(0, a.size, 6)] if name[0] != "x" else [(k, x[t, 0]) for k in range(3) for t in (0, 4)]
        for at in spots:
            old = a[at]
            a[at] = old + 1e-5
            up, _ = m.loss(x, y, mask)
            a[at] = old - 1e-5
            down, _ = m.loss(x, y, mask)
            a[at] = old
            assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_frozen_equals_training_pass():
    m = L.BiGRU(["x", "y", "z"], hidden=4)
    x = np.random.default_rng(1).integers(0, 256, (9, 7))
    s = np.concatenate([m.run(x, "f")[0], m.run(x, "b")[0]], axis=1)
    logits = m.p["w"] @ s + m.p["o"]
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.abs(m.frozen().positions(x) - p).max() < 1e-5


def test_windows_cover_the_text():
    f = L.BiGRU(["x", "y"]).frozen()
    texts = [b"a" * 200, b"", b"b", b"c" * 64]
    got = f.documents(texts, wide=2)
    for t, p in zip(texts, got):
        rows = [f.positions(np.frombuffer(t[i : i + 64].ljust(64, b"\0"), np.uint8)[:, None].astype(np.intp))[: len(t[i : i + 64]), :, 0] for i in range(0, len(t), 64)]
        assert np.allclose(p, np.concatenate(rows).mean(axis=0) if rows else 0, atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(truth) and all(r.held_out == (fold_of(r.doc_id, 5) == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_sampling_from_any_number_of_rows(spark, monkeypatch):
    """A share of 3000 in 1e11 rows is drawn at its rate, not rounded to none; a draw without rows is an error."""
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert 1 <= L.MODULUS * 3000 // 10**11 and 80 < L.sampled(ids, 200_000, 200, "doc_id").count() < 400
    plan = L.sampled(ids, 10**11, 3000, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert str(L.MODULUS * 3000 // 10**11) in plan
    few = spark.createDataFrame([(i, "ein Wort", "de") for i in range(5)], "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "sampled", lambda d, *_: d.limit(0))
    with pytest.raises(RuntimeError):
        L.train_language_model(few)


def test_whole_texts_are_trained_on(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L.BiGRU, "train", lambda self, windows, lengths, y, steps: seen.append((windows.copy(), lengths, y)))
    texts = ["a" * 1000, "b" * 64, "c" * 65]
    L.train_language_model(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string"))
    windows, lengths, _ = seen[0]
    assert sorted(b"".join(bytes(w[:n]) for w, n in zip(windows, lengths))) == sorted("".join(texts).encode())


def naive_label(model, text):
    """Position by position over windows of the text, averaged."""
    data, rows = text.encode(), []
    for a in range(0, len(data), L.WINDOW):
        part = np.frombuffer(data[a : a + L.WINDOW].ljust(L.WINDOW, b"\0"), np.uint8)[:, None].astype(np.intp)
        rows.append(model.positions(part)[: len(data[a : a + L.WINDOW]), :, 0])
    return model.langs[int(np.concatenate(rows).mean(axis=0).argmax())]


def test_predictions_equal_a_naive_scorer(docs):
    model = L.train_language_model(docs, steps=40)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.predicted(docs, model).collect():
        t = texts[r.doc_id]
        assert r.lang_pred == (naive_label(model, t) if t and any(map(str.isalpha, t)) else "und")


def test_odd_rows(odd, none):
    got = L.predicted(odd, L.train_language_model(odd, steps=5)).collect()
    texts = {r.text for r in odd.collect()}
    assert len(got) == odd.count() and len(texts) > 1
    by = {r.doc_id: r.lang_pred for r in got}
    assert [by[i] for i in (2, 3, 4)] == ["und"] * 3 and by[1] in {"en", "de", "fr"}
    assert L.held_out_languages(none).collect() == []
    assert {r.lang_pred for r in L.predicted(odd, None).collect()} == {"und"}
