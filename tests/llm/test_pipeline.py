from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm.common import materialize
from siftwell.llm.exact_dedup import keep_distinct
from siftwell.llm.mixing import mix, mixed
from siftwell.llm.ngram_join import keep_unlike
from siftwell.llm.quality import Logistic, co_train, features, fit_quality, keep_quality, pseudo_sums, score_quality
from siftwell.llm.shingles import shingle_set


def corpus(n=260):
    """Prose, junk, exact copies and near copies; labels for most of them."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeioudnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 120))]
        good = i % 5 != 0
        kind = i % 20
        if rows and kind == 7:
            text = rows[-1][1]
            good = rows[-1][5]
        elif rows and kind == 8:
            w = rows[-1][1].split(" ")
            w[0] = f"x{i}"
            text, good = " ".join(w), rows[-1][5]
        else:
            text = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "***", "$$$"]) for w in words)
        rows.append((i, text, "en", f"s{rng.choice([0, 0, 0, 1, 2])}", len(text), good))
        if i % 7:
            labels.append((i, int(good), 0))
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    good = {r[0]: r[1] for r in rows if r[5]}
    assert {r.doc_id for r in kept[0]} == set(good)
    last = {t: i for i, t in sorted(good.items())}
    assert {r.doc_id for r in kept[1]} == set(last.values())
    sets = {r.doc_id: shingle_set(r.text.encode(), 5) for r in kept[1]}
    gone = {j for i in sets for j in sets if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert gone and {r.doc_id for r in kept[2]} == set(sets) - gone
    times = {r.doc_id: r.times for r in mix(spark.createDataFrame(kept[2], docs_schema(schema))).collect()}
    assert Counter(r.doc_id for r in kept[3]) == Counter({i: n for i, n in times.items() if n})
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fill = defaultdict(int)
    for r in kept[4]:
        fill[r.sequence_id] += r.length
    assert sum(fill.values()) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in kept[3])
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length", "ids_crc32").collect())) == sorted(str(r) for r in docs.select("doc_id", "length", "ids_crc32").collect())


def docs_schema(schema):
    return schema


def test_quality_scores(spark, documents, nothing):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, good boolean")
    known = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    found = score_quality(docs, known).collect()
    truth = {r[0]: r[5] for r in rows}
    unseen = [r for r in found if r.doc_id % 7 == 0]
    assert sum(r.kept == truth[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    assert sorted(map(str, found)) == sorted(map(str, score_quality(docs, known).collect()))
    none = known.limit(0)
    assert all(r.kept for r in score_quality(documents, none).collect()) and score_quality(nothing, known).count() == 0
    assert keep_quality(documents, none).count() == documents.count() and keep_quality(documents, known).columns == documents.columns


def test_views_teach_each_other():
    """The sums over pseudo-labelled rows do what a plain fit on these rows does, and both views gain."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    x = {v: (y[:, None] * 3 + rng.normal(size=(4000, 2))).astype(np.float32) for v in ("text", "meta")}
    few = np.arange(4000) < 90
    rest = {v: x[v][~few] for v in x}
    model = co_train({v: x[v][few] for v in x}, y[few].astype(float), np.arange(90) % 3, lambda models, bounds: pseudo_sums(models, bounds, rest))
    assert len(model.exchanged) == 2 and all(min(e.values()) > 50 for e in model.exchanged)
    one, two, both = (((p >= 0.5) == y).mean() for p in model.score(x["text"], x["meta"]))
    assert both > max(one, two) - 0.002 and both > 0.97
    start = Logistic.fit(x["text"][few], y[few].astype(float))
    near = Logistic(start.mean, start.scale, Logistic.fit(x["text"], y.astype(float), start=start).weight * 1.01)
    other = near.sums(x["text"][~few], y[~few].astype(float))
    assert np.allclose(Logistic.fit(x["text"][few], y[few].astype(float), start=near, learned=other).weight, Logistic.fit(x["text"], y.astype(float), start=near).weight, atol=0.05)


def test_fit_is_that_of_one_process(spark):
    """The distributed pass over all other documents gives the sums of a plain loop over them."""
    rows, labels = corpus(300)
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], "n/a") for r in rows], "doc_id long, text string, lang string, source string, n_chars string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = fit_quality(docs.repartition(5), known)
    y_of = {i: float(q) for i, q, _ in labels}
    by = sorted((r for r in rows if r[0] in y_of), key=lambda r: str(r[0]))
    x, rest = (dict(zip(("text", "meta"), features([r[1].encode() for r in part], [r[2] for r in part], [r[3] for r in part]), strict=True)) for part in (by, [r for r in rows if r[0] not in y_of]))
    fold = np.array([{0: 1, 4: 2}.get(zlib.crc32(str(r[0]).encode()) % 8, 0) for r in by])
    plain = co_train(x, np.array([y_of[r[0]] for r in by]), fold, lambda models, bounds: pseudo_sums(models, bounds, rest))
    assert plain.exchanged and found.exchanged == plain.exchanged
    assert np.allclose(found.text.weight, plain.text.weight, atol=1e-6) and np.allclose(found.meta.weight, plain.meta.weight, atol=1e-6)
    assert found.threshold == pytest.approx(plain.threshold)


def test_stages_on_odd_rows(spark, documents, nothing, tmp_path):
    """Nulls, empty texts, repeated rows, ids with several texts, clashing names, empty tables."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    clash = ["__id", "__key", "__rows", "row", "gone", "times", "id", "sha", "n", "last", "c0", "top"]
    for table in (documents, nothing):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = table.select("*", *(F.lit(k).alias(c) for c in clash if c not in table.columns))
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert k == 4 or out.columns == docs.columns
            assert rows if table is documents else not rows
    x, y = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, x), (5, x + " end"), (5, y), (None, x), (None, "nobody else has these words"), (None, None), (7, ""), (8, y), (8, y)]
    kept = keep_unlike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(str(Row(doc_id=rows[i][0], text=rows[i][1])) for i in (0, 2, 4, 5, 6))


def test_distinct_rows_of_any_names(spark):
    rows = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 7, 8), (2, "a", 9, 9), (None, None, 1, 1), (4, "", 2, 2)], "doc_id long, text string, __key int, __bucket int")
    assert sorted((r.doc_id, r.text) for r in keep_distinct(rows).collect()) == [(2, "a"), (4, "")]


def test_mixed_rows_are_those_of_mix(spark, documents):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(2000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, key int, last int")
    for buckets in (4, 4096):
        times = Counter({r.doc_id: r.times for r in mix(df, buckets=buckets).collect() if r.times})
        assert Counter(r.doc_id for r in mixed(df, buckets=buckets).collect()) == times
    same = [(1, "w w w w", "a")] * 6 + [(2, "w", "b")] * 40 + [(3, "w w", None)] * 11
    ties = spark.createDataFrame(same, "doc_id long, text string, source string")
    assert sum(r.size * r.times for r in mix(ties).collect()) == sum(len(r.text.split()) for r in mixed(ties).collect())
    assert Counter(r.doc_id for r in mixed(ties).collect()) == sum((Counter({r.doc_id: r.times}) for r in mix(ties).collect()), Counter())
    assert mixed(documents).columns == documents.columns and mixed(documents.limit(0)).count() == 0
