from __future__ import annotations

import random

import pyarrow as pa
import pytest

from siftwell.llm import ngram_join as module
from siftwell.llm.components import connected_components
from siftwell.llm.ngram_join import ngram_join
from siftwell.llm.shingles import Shingler, shingle_set


def brute(rows, words, num, den):
    """{row index: (set size, smallest id in its component)}"""
    sets = [shingle_set((t or "").encode(), words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (id_, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(id_)
    return sorted(str((id_, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None))) for i, (id_, _) in enumerate(rows))


@pytest.mark.parametrize(("words", "num", "bits"), [(3, 90, 20), (5, 80, 8)])
def test_against_brute_force(spark, words, num, bits):
    rng = random.Random(words)
    rows = []
    for family in range(25):
        base = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.choice([1, 2, 4, 30, 80, 200]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                if rng.random() < 0.6:
                    w[rng.randrange(len(w))] = f"e{rng.randint(0, 3 if family % 2 else 10**6)}"
            rows.append((len(rows), rng.choice([" ", "\n"]).join(w)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "one two", "one  two"])]
    rows += [(None, rows[3][1]), rows[3], rows[3], (None, "lonely null id of nobody else here")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, n int")
    found = ngram_join(df, words=words, num=num, sketch_bits=bits).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == brute(rows, words, num, 100)


@pytest.mark.parametrize("bits", [6, 12])
def test_hot_shingles_are_dealt_over_tasks(spark, monkeypatch, bits):
    """Short texts around one common line: salted groups, parts of a group and ranges of lengths give what brute force does."""
    monkeypatch.setattr(module, "HOT", 8)
    monkeypatch.setattr(module, "PART", 10)
    rng = random.Random(bits)
    line = [f"w{i}" for i in range(24)]
    rows = []
    for i in range(220):
        w = line[: rng.randint(20, 24)] + [f"x{rng.randint(0, 2)}" for _ in range(rng.randint(0, 6))] + ["y"] * (i % 3)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = ngram_join(df, sketch_bits=bits).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == brute(rows, 3, 90, 100)


def test_entries_meet_across_batches():
    """Any division into batches gives each entry of a shared token once at least, with the first of its group as hub."""
    rng = random.Random(7)
    drawn = {(t := rng.randint(0, 6), int(t > 5) * rng.randint(1, 2), c := rng.randint(0, 30)): (t * c) % 5 for _ in range(60)}
    rows = sorted((t, salt, pos, bytes([c])) for (t, salt, c), pos in drawn.items())
    rows = sorted(rows + rows[::7])
    table = pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary()), pa.array([9] * len(rows), pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=["token", "salt", "c", "n", "pos"])
    groups = {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    expected = {(g[0], r[3], r[2], of[0][3], g[1] > 0) for g, of in groups.items() for r in of if g[1] or len(set(of)) > 1}
    for size in (1, 2, 3, 7, 100):
        out = [r for b in module._meet(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {(r["token"], r["c"], r["pos"], r["hub"], r["hot"]) for r in out} == expected


def test_empty(nothing):
    assert ngram_join(nothing).count() == 0


def test_shingles_are_those_of_the_words():
    texts = [b"", b"a", b"A b", b"a b c d", b"x " * 50, b"a b  c\x0bd", "é ü".encode()]
    for k in (1, 3):
        for chunk in (1, 1 << 20):
            sizes = [len(set(seq.tolist())) for _, seq in Shingler(k, chunk).sequences(texts)]
            assert sizes == [len(shingle_set(t, k)) for t in texts]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60) if i % 20] + [(100, i) for i in range(101, 140)] + [(7, 7), (2, 1)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(found[i] == (i - 1) // 20 * 20 + 1 for i in range(1, 60)) and {found[i] for i in range(100, 140)} == {100}
