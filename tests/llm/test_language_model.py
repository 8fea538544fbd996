from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwell.llm.language_model import Trie, adaptive_score, lm_scores, n_grams


def trained(texts, order):
    """The trie as a dictionary of counters, from plain loops."""
    model = defaultdict(Counter)
    for t in texts:
        s = [0] * order + [b + 1 for b in t.lower()] + [257]
        for i in range(order, len(s)):
            for d in range(order + 1):
                model[tuple(s[i - d : i])][s[i]] += 1
    return model


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "Of", "then", "ée", "no."]) + rng.choice(["", "a", "ing"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 3, 5])
def test_trie_against_counters(order):
    learn, test = [t.encode() for t in texts(40)], [*(t.encode() for t in texts(20, 2)), b"", b"zzz qq\xc3", b"the", b"\x00\xff"]
    keys = np.sort(n_grams(learn, order)[0])
    grams, counts = np.unique(keys, return_counts=True)
    model = trained(learn, order)
    want = [adaptive_score(t, order, model, learn=False) for t in test]
    assert Trie(grams, counts, order).scores(test) == pytest.approx(want)
    assert Trie(grams[:0], counts[:0], order).scores([b"ab"]) == pytest.approx([-3 * math.log10(257)])


def test_probabilities_sum_to_one():
    learn = [t.encode() for t in texts(5)]
    model = trained(learn, 2)
    from siftwell.llm.language_model import END

    grams, counts = np.unique(n_grams(learn, 2)[0], return_counts=True)
    trie = Trie(grams, counts, 2)
    for context in ((0, 0), (117, 105), (250, 251), (102, 250)):
        key = (context[0] << 18) | (context[1] << 9)
        p = 10 ** trie.bits(np.array([key | s for s in range(1, END + 1)], np.uint64))
        assert p.sum() == pytest.approx(1.0), context
    assert model


@pytest.mark.parametrize("options", [{}, {"frequent": 3, "max_grams": 50}, {"adaptive": True}])
def test_scores(spark, documents, nothing, options):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts(40, 5))], "doc_id long, text string")
    docs = documents.unionByName(extra, allowMissingColumns=True)
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            counts.update([*t.lower().split(), "end"])
    total, distinct = sum(counts.values()), len(counts)
    model = trained([t for (_, t), h in zip(rows, held, strict=True) if not h], 4)
    want = []
    for (i, t), h in zip(rows, held, strict=True):
        tokens = [*t.lower().split(), "end"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        score = adaptive_score(t, 4) if options.get("adaptive") else adaptive_score(t, 4, model, learn=False)
        want.append((str(i), h, len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6), round(score, 6)))
    found = lm_scores(docs, order=4, **options).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found) == sorted(want)
    assert lm_scores(nothing, **options).count() == 0
