from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import queries, toxicity
from siftwell.llm.toxicity import Voters, choose_voters, fit_classifier, fit_labels, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_documents_of_the_query(spark):
    """Toxic documents of readable quality are found, clean ones are left alone."""
    scored = queries.QUERIES["op11_toxicity"](spark, SF)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert scored.count() == docs.count() and dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = scored.join(labels, "doc_id").filter("held_out AND (quality = 1 OR toxic = 0)").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic, clean = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    assert len(toxic) >= 8 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.02


def test_label_model_finds_accuracies_and_repeats(spark):
    """Voters with known rates, two of them copies of each other: estimates without a single known label."""
    rng = np.random.default_rng(1)
    n = 20_000
    y = rng.random(n) < 0.2
    speaks = np.array([[0.02, 0.05, 0.01, 0.6], [0.6, 0.5, 0.4, 0.03]])
    own = rng.random((n, 4)) < np.where(y[:, None], speaks[1], speaks[0])
    votes = np.column_stack([own[:, :3], own[:, 0], own[:, 3]]).astype(np.uint8)
    patterns = Counter(v.tobytes() for v in votes)
    df = spark.createDataFrame([(bytearray(v), None, c) for v, c in patterns.items()], "votes binary, gold int, times long")
    model = fit_labels(df, np.array([False] * 4 + [True]), np.array([False] * 5), rounds=30)
    assert abs(model.prior - 0.2) < 0.05
    assert np.abs(model.speaks[:, :5] - speaks[:, [0, 1, 2, 0, 3]]).max() < 0.08
    assert model.correlation[0, 3] > 0.9 and abs(model.correlation[0, 1]) < 0.3
    assert model.weights()[0][0] < 0.7 * np.log(model.speaks[1, 0] / model.speaks[0, 0])
    q = model.posterior(votes.astype(float))
    assert np.mean((q > 0.5) == y) > 0.93
    gold = spark.createDataFrame([(bytearray(v), int(c % 2), c) for v, c in patterns.items()], "votes binary, gold int, times long")
    assert fit_labels(gold, np.array([False] * 4 + [True]), np.array([False] * 5), rounds=2).speaks.shape == (2, 7)


def test_classifier_against_plain_descent(spark):
    """The distributed Newton steps end where plain gradient descent on one array ends."""
    rng = np.random.default_rng(2)
    voters = Voters([("=bad", 0)])
    texts = [" ".join(["bad"] * int(k) + ["fine"] * int(m)) for k, m in rng.integers(0, 6, (300, 2))]
    x = np.array([voters.look(t) for t in texts])
    model = toxicity.LabelModel.start(voters.clean, voters.exclusive)
    df = spark.createDataFrame([(bytearray(r.astype("<f4").tobytes()),) for r in x], "x binary").repartition(5)
    fitted = fit_classifier(df, voters, model, penalty=5.0, steps=30)
    z, y = fitted.rows(voters.features(x)), model.posterior(voters.votes(x).astype(float))
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(z.shape[1] - 1, 5.0), 1e-6)
    rate = 1 / (np.linalg.norm(z, 2) ** 2 / 4 + 5)
    for _ in range(20_000):
        w -= rate * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + ridge * w)
    assert np.abs(1 / (1 + np.exp(-z @ w)) - fitted.score(voters.features(x))).max() < 1e-3


def test_votes_of_a_text():
    voters = Voters([("=grim", 0), ("<blor", 2)])

    def said(text):
        return {n for n, v in zip(voters.names, voters.votes(voters.look(text)[None])[0], strict=True) if v}

    assert said("") == {"nothing"} and said("nothing here") == {"nothing"}
    assert said("a grim day") == {"=grim 0", "single"}
    assert said("blorax and blorish") == {"<blor 2", "dense"} and said("blor alone") == {"nothing"}
    assert said("grimly " + "word " * 400 + "bloraxx") == {"sparse"} and "several" in said("grim " * 2 + "word " * 400)
    assert {"stock en", "dense", "address"} <= said("You are an IDIOT, you stupid clown") and "address" not in said("the idiot")
    assert "masked" in said("what a f**k and s#!t b**") and "shouting" in said("THIS IS ALL VERY LOUD INDEED MY FRIEND") and "exclaims" in said("a! b! c! d! e f g h i")
    assert np.isfinite(voters.look("\ud800 é" * 5)).all()


def test_voters_are_chosen_without_repeats():
    counts = [("=grim", 0, 50, 0), ("<gri", 0, 50, 0), ("=grim", 2, 30, 0), ("<blor", 0, 40, 30), ("<blor", 2, 38, 1), ("<blora", 2, 20, 1), ("=rare", 0, 5, 4), ("=luck", 0, 8, 0), ("=luck", 1, 8, 1)]
    assert choose_voters(counts) == [("<blor", 2), ("=grim", 0), ("=luck", 0)]
    assert choose_voters([]) == [] and len(choose_voters([(f"=w{i}x", 0, 10, 0) for i in range(90)])) == 64


def test_odd_rows(spark, documents, nothing):
    rng = random.Random(3)
    fill = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)) for _ in range(60)]
    rows = [(i, f"{t} vexil vexor" if i % 4 == 0 else t, None, None, i) for i, t in enumerate(fill)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = documents.unionByName(more.withColumn("doc_id", more.doc_id + 100), allowMissingColumns=True).selectExpr("*", "'s' AS score", "'i' AS id", "1 AS x", "2 AS votes", "3 AS y")
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0), "k") for i in range(40)] + [(None, 1, "k"), (5, None, "k"), (999, 1, "k"), (101, 0, "k")], "doc_id long, toxic int, text string")
    got = score_toxicity(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert len({r.score for r in got if r.doc_id == 9}) == 1 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert [by[100 + i] for i in range(40, 60)] == [int(i % 4 == 0) for i in range(40, 60)]
    assert score_toxicity(nothing, labels).count() == 0
    for few in (labels.limit(0), labels.filter("toxic = 0"), labels.filter("toxic = 1")):
        assert score_toxicity(docs, few).count() == docs.count()
    stock = score_toxicity(docs.unionByName(spark.createDataFrame([(500, "you stupid pathetic idiot")], "doc_id long, text string"), allowMissingColumns=True), labels.limit(0)).collect()
    assert max(stock, key=lambda r: r.score).doc_id == 500


def test_a_very_long_text_is_read_to_its_end(spark):
    rows = [(i, "calm words " * 20 + ("vexil" if i % 2 else "")) for i in range(40)] + [(50, "calm words " * 300_000 + "vexil " * 20_000), (51, "calm words " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = fit_toxicity(df, spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int"))
    assert ("=vexil", 0) in fitted.voters.mined
    hits = {r["id"]: np.frombuffer(r["x"], "<f4")[fitted.voters.place["=vexil"]] for r in fitted.seen.collect()}
    assert hits[50] == 20_000 and hits[51] == 0 and hits[1] == 1


@pytest.mark.parametrize("text", ["", "idiot", "one two", "Ünïcode wörds here"])
def test_features_are_finite(text):
    voters = Voters([])
    f = voters.features(voters.look(text)[None])
    assert np.isfinite(f).all() and f.max() <= 3
