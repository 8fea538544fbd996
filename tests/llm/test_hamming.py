from __future__ import annotations

import random

import numpy as np
import pytest

from siftwell.llm.hamming import MultiIndex, top_k


@pytest.mark.parametrize(("n", "size"), [(1, 8), (5, 1), (300, 4), (2000, 8)])
def test_index_against_all_distances(n, size):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 256, (n, size), np.uint8)
    index = MultiIndex(codes)
    for k in (1, 3, 10):
        for q in [codes[0], *rng.integers(0, 256, (5, size), np.uint8)]:
            d = np.bitwise_count(codes ^ q).sum(axis=1)
            kth = np.sort(d)[min(k, n) - 1]
            rows, dist, covered = index.nearest(q, k)
            assert sorted(rows) == np.flatnonzero(d <= kth).tolist() and (dist == d[rows]).all()
            assert covered >= 0


def test_lengths_of_the_same_bytes_stay_apart(spark):
    rows = [(1, [1.0] * 9), (2, [1.0] * 9 + [-1.0]), (3, [1.0] * 9 + [-1.0] * 2), (4, [1.0] * 8 + [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.neighbor_id, r.distance) for r in top_k(df, df).collect()) == [(1, 1, 0), (1, 4, 1), (2, 2, 0), (3, 3, 0), (4, 1, 1), (4, 4, 0)]


@pytest.mark.parametrize("options", [{}, {"part_codes": 7, "block": 3}])
def test_top_k(spark, options):
    rng = random.Random(2)
    hot = [rng.uniform(-1, 1) for _ in range(12)]
    rows = [(i, hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(12)]) for i in range(90)]
    rows += [(90, None), (91, [1.0, None] + hot[2:]), (92, [0.5] * 4), (93, []), (None, hot), (5, rows[5][1]), (100, hot), (200, rows[1][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, code string")
    found = top_k(df, df.filter("vec_id % 50 = 0"), k=40, **options).collect()
    code = {j: tuple(x > 0 for x in v) for j, (_, v) in enumerate(rows) if v and None not in v}
    want = set()
    for j, (i, _) in enumerate(rows):
        if i is not None and i % 50 == 0 and j in code:
            near = sorted((sum(a != b for a, b in zip(code[j], c, strict=True)), rows[r][0] is None, rows[r][0] or 0) for r, c in code.items() if len(c) == len(code[j]))
            want |= {(i, n + 1, None if none else x, d) for n, (d, none, x) in enumerate(near[:40])}
    assert {(r.query_id, r["rank"], r.neighbor_id, r.distance) for r in found} == want
    assert top_k(df.limit(0), df.limit(0)).count() == 0 and top_k(df, df.limit(0)).count() == 0
