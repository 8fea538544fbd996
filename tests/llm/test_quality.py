"""The views' exchange on the given tables, and the models against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from siftwell.llm.quality import META_SIZE, TEXT_SIZE, CoTrained, Logistic, features, fit_quality, pseudo_sums, score_quality, sure_from


def test_views_mark_for_each_other_on_the_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model, alone = fit_quality(docs, labels), fit_quality(docs, labels, rounds=0)
    assert len(model.exchanged) == 2 and all(set(e) == {"meta 0", "meta 1", "text 0", "text 1"} for e in model.exchanged)
    assert all(min(e.values()) >= 50 for e in model.exchanged) and model.exchanged[0] != model.exchanged[1]
    for view in ("text", "meta"):
        assert not np.allclose(getattr(model, view).weight, getattr(alone, view).weight, atol=1e-3)


def test_fit_against_descent():
    """Newton's steps end where plain gradient descent on the same penalised likelihood does."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 2, -1]
    y = (x @ [1.0, -0.3, 2.0] + rng.normal(size=300) > -2).astype(float)
    found = Logistic.fit(x, y, penalty=2.0)
    z = [[(v - x[:, j].mean()) / x[:, j].std() for j, v in enumerate(row)] + [1.0] for row in x]
    w = [0.0] * 4
    for _ in range(1500):
        grad = [2.0 * w[0], 2.0 * w[1], 2.0 * w[2], 1e-6 * w[3]]
        for row, label in zip(z, y, strict=True):
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(row, w, strict=True))))
            for j in range(4):
                grad[j] += (p - label) * row[j]
        w = [a - 0.01 * g for a, g in zip(w, grad, strict=True)]
    assert np.allclose(found.weight, w, atol=5e-3)


def test_sure_from_every_bound():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 30)
        conf = np.array([rng.choice([0.2, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]) for _ in range(n)])
        right = np.array([rng.random() < c for c in conf], bool)
        good = [b for b in sorted(set(conf)) if b >= 0.5 and (conf >= b).sum() >= 3 and right[conf >= b].mean() >= 0.9]
        assert sure_from(conf, right, 0.9, 3) == (good[0] if good else None)


def test_views_that_disagree_mark_for_neither():
    one = Logistic(np.zeros(1), np.ones(1), np.array([1.0, 0.0]))
    x = {"text": np.array([[3.0], [3.0], [-3.0], [0.1]]), "meta": np.array([[3.0], [-3.0], [-3.0], [-3.0]])}
    marks = pseudo_sums({"text": one, "meta": one}, {(v, k): 0.9 for v in x for k in (0, 1)}, x)
    assert {k: n for k, (n, _) in marks.items()} == {("meta", 1): 1, ("text", 1): 1, ("meta", 0): 1, ("text", 0): 2}


def test_scores_of_a_plain_loop():
    rng = np.random.default_rng(5)

    def model(d):
        return Logistic(rng.normal(size=d), rng.uniform(0.5, 2, d), rng.normal(size=d + 1))

    m = CoTrained(model(4), model(3), model(1), model(1), model(2))
    text, meta = rng.normal(size=(20, 4)), rng.normal(size=(20, 3))

    def logit(model, row):
        z = sum((v - a) / s * w for v, a, s, w in zip(row, model.mean, model.scale, model.weight[:-1], strict=True)) + model.weight[-1]
        return min(20.0, max(-20.0, z))

    for i, found in enumerate(zip(*m.score(text, meta), strict=True)):
        a, b = logit(m.text_map, [logit(m.text, text[i])]), logit(m.meta_map, [logit(m.meta, meta[i])])
        assert found == pytest.approx([1 / (1 + math.exp(-z)) for z in (a, b, logit(m.both, [a, b]))])


def test_odd_texts(spark):
    """Very long, blank, one-word and null texts have finite features and scores."""
    rng = random.Random(1)
    long = " ".join(rng.choice(["alpha", "beta", "gamma\n", "été"]) for _ in range(400_000))
    texts = [long, "x" * 1_000_000, "", " \n\t\n", "a", "\n" * 1000]
    text, meta = features([t.encode() for t in texts], [None] * 6, [None] * 6)
    assert text.shape == (6, TEXT_SIZE) and meta.shape == (6, META_SIZE) and np.isfinite(text).all() and np.isfinite(meta).all()
    rows = [(i, t, "en", "s") for i, t in enumerate([*texts, None])] + [(100 + i, ("good words here " if i % 2 else "### $$$ ") * (5 + i), "en", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in score_quality(docs, known).collect()}
    assert len(found) == 207 and all(0 <= r.score <= 1 for r in found.values())
    assert found[2].score == found[6].score
