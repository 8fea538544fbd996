from __future__ import annotations

import math
import random

import pytest

from siftwell.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, x string, tag string, score string, team string"


def brute(rows: list[tuple], anchors, k: int = 5, m: int = 3, low: int = 50, high: int = 95) -> list[tuple]:
    kept = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []

    def first(row, pool, n):
        ranked = [(-sum(a * b for a, b in zip(row[2], r[2], strict=True)), r[0] is None, r[0] or 0, r) for r in pool if len(r[2]) == len(row[2])]
        return sorted(ranked, key=lambda x: x[:3])[:n]

    for a in kept:
        if a[0] is not None and anchors(a[0]):
            for s, _, _, p in first(a, [r for r in kept if r[1] == a[1] and r != a], k):
                others = [(n, *rest) for n, *rest in first(a, [r for r in kept if r[1] != a[1]], len(kept)) if low * -s <= 100 * -n <= high * -s]
                out += [(a[0], p[0], i, r[0], -s, -n) for i, (n, _, _, r) in enumerate(others[:m], 1)]
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    out = [(i, [c + rng.gauss(0, 0.4) for c in centres[rng.randrange(5)]], rng.randrange(4)) for i in range(400)]
    hot = [0.5] * 6
    out += [(i, hot, i % 3) for i in range(400, 520)]  # one vector that many rows share: ties everywhere
    out += [(600, None, 1), (601, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (602, [math.nan] * 6, 1), (603, [math.inf] * 6, 1), (604, hot, None), (None, hot, 1), (605, hot, 9), (600, [1.0] * 3, 1), (650, [0.9] * 3, 1), (651, [0.7] * 3, 2)]
    return out + out[:20] + [(700, [], 1), (750, [], 1), (751, [], 2), (752, [0.0] * 6, 1), (800, [0.0] * 6, 1)]


@pytest.mark.parametrize("options", [{}, {"pivots": 7, "team_size": 9, "block": 50}, {"pivots": 1, "block": 7}])
def test_against_all_pairs(spark, rows, options):
    df = spark.createDataFrame([(*r, "x", "t", "s", "u") for r in rows], SCHEMA)
    assert found(hard_negatives(df, "id % 25 = 0", **options)) == brute(rows, lambda i: i % 25 == 0)


def test_windows_and_few_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", "t", "s", "u") for r in rows[:60]], SCHEMA)
    for low, high, k, m in ((0, 100, 2, 1), (90, 90, 5, 9), (-100, 50, 3, 2)):
        assert found(hard_negatives(df, "id % 10 = 0", k, m, low, high)) == brute(rows[:60], lambda i: i % 10 == 0, k, m, low, high)


def test_large_components_stay_exact_or_fail(spark):
    rows = [(0, [2.0**22, 1.0], 1), (1, [2.0**22, 2.0], 1), (2, [2.0**22 - 300000, 3.0], 2), (3, [2.0**21, 0.5], 2)]
    df = spark.createDataFrame([(*r, "x", "t", "s", "u") for r in rows], SCHEMA)
    assert found(hard_negatives(df, "id = 0")) == brute(rows, lambda i: i == 0)
    df = spark.createDataFrame([(0, [1e30], 1, "", "", "", "")], SCHEMA)
    with pytest.raises(Exception, match="exact"):
        hard_negatives(df, "id = 0").collect()


def test_empty_and_no_anchors(spark, rows):
    df = spark.createDataFrame([(*r, "x", "t", "s", "u") for r in rows], SCHEMA)
    assert hard_negatives(df.limit(0), "id = 0").count() == 0
    assert hard_negatives(df, "id = -1").count() == 0
