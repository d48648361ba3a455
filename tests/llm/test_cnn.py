"""The byte CNN against plain loops, its gradient against differences, and its sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlake.llm import quality_cnn as q

TEXTS = [b"", b"a", b"the quick brown fox " * 3, bytes(range(256)) * 2, b"x" * 1000, b"ab" * 63, b"y" * q.CELL]


def plain(w, text):
    """One text's logit, window by window."""
    raw = text + bytes(q.WIDTH + -(len(text) + q.WIDTH) % q.CELL)
    cells = len(raw) // q.CELL
    raw += bytes(q.WIDTH)  # what the last windows of a text see in a text of its own
    top = np.full((cells, q.FILTERS), -np.inf)
    for c in range(cells):
        for s in range(c * q.CELL, (c + 1) * q.CELL, q.STRIDE):
            window = np.concatenate([w["embed"][b] for b in raw[s : s + q.WIDTH]]).astype(float)
            top[c] = np.maximum(top[c], window @ w["conv"])
    top += w["conv_b"]
    hidden = []
    for c in range(cells):
        chunk = np.maximum(np.maximum(top[c], top[min(c + 1, cells - 1)]), 0)
        hidden.append(chunk @ w["hidden"] + w["hidden_b"])
    return float(np.maximum(np.max(hidden, axis=0), 0) @ w["out"] + w["out_b"][0])


def test_scores_are_those_of_a_plain_loop():
    cnn = q.ByteCnn()
    for text in TEXTS:
        assert cnn.score([text])[0] == pytest.approx(1 / (1 + np.exp(-plain(cnn.w, text))), rel=1e-4)


def test_gradient_is_that_of_differences():
    cnn, y = q.ByteCnn(), np.array([1, 0, 1, 0, 1, 0, 1], np.float32)
    cnn.w = {k: v.astype(np.float32) for k, v in cnn.w.items()}

    def loss():
        z = cnn._forward(TEXTS).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g, rng = cnn._gradient(TEXTS, y), np.random.default_rng(1)
    for name, grad in g.items():
        flat, steep = cnn.w[name].reshape(-1), grad.reshape(-1)
        picked = np.argsort(-np.abs(steep))[:6].tolist() + rng.integers(0, len(flat), 3).tolist()
        good = 0
        for i in picked:
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            good += abs((up - down) / (2 * step) - steep[i]) < 2e-3 + 0.05 * abs(steep[i])
        assert good >= len(picked) - 1, name  # a maximum may change hands within a step


def test_sample_takes_long_texts_and_stops_at_its_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "z" * (50_000 if i % 3 == 0 else 10)) for i in range(60)] + [(7, "z" * 10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(q.ByteCnn, "fit", lambda self, texts, y, **_: seen.update(texts=texts, y=y) or self)
    q.fit_quality(docs, labels)
    held = {r.doc_id for r in docs.where(q.fold(F.col("doc_id")) == 0).collect()}
    want = sorted([50_000 if i % 3 == 0 else 10 for i in range(60) if i not in held] + ([10] if 7 not in held else []))
    assert sorted(map(len, seen["texts"])) == want and len(seen["y"]) == len(want) and max(want) == 50_000
    q.fit_quality(docs, labels, most_bytes=120_000)
    assert 120_000 <= sum(map(len, seen["texts"])) < 170_000
    q.fit_quality(docs, labels, rows=5)
    assert len(seen["texts"]) == 5
    q.fit_quality(docs, labels.where("quality is null"))
    assert seen["texts"] == []
