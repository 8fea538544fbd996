from __future__ import annotations

import itertools
import random

import pytest

from siftwell.llm.substring_dedup import _common, align, chain, repeated_passages


def test_chains_are_the_best():
    rng = random.Random(5)
    for _ in range(150):
        matches = list({(rng.randint(0, 15), rng.randint(0, 15)) for _ in range(rng.randint(1, 8))})

        def score(c):
            return 5 * len(c) - 0.2 * sum(q[0] - p[0] + q[1] - p[1] for p, q in itertools.pairwise(c))

        best = max(score(c) for n in range(1, len(matches) + 1) for c in itertools.combinations(sorted(matches), n) if all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(c)))
        found = chain(matches, 5, 0.2)
        assert score(found[0]) == pytest.approx(best)
        assert sorted(itertools.chain(*found)) == sorted(matches)


def words(rng, n):
    return [f"v{rng.randrange(10**7)}" for _ in range(n)]


def test_alignment_extends_to_the_whole_passage():
    rng = random.Random(1)
    core = words(rng, 60)
    changed = core[:20] + ["new"] + core[20:40] + core[41:]
    a, b = (x.encode() for x in (" ".join(words(rng, 30) + core + words(rng, 30)), " ".join(words(rng, 7) + changed + words(rng, 9))))
    start, stop, ostart, ostop, identity = align(a.split(), b.split(), [55], [33], 5)
    assert (start, stop, ostart, ostop) == (30, 90, 7, 67) and identity == pytest.approx(59 / 60)


@pytest.mark.parametrize("window", [1, 6])
def test_planted_passages(spark, nothing, window):
    rng = random.Random(9)
    core, other = words(rng, 60), words(rng, 55)
    rows, has, clean = [], {}, set()
    for i in range(40):
        body = words(rng, rng.randint(60, 200))
        if i % 4 == 0:
            passage = list(core)
            for _ in range(rng.randint(0, 3)):
                passage[rng.randrange(60)] = f"edit{i}"
            at = rng.randint(0, len(body))
            body[at:at] = passage
            has[i] = at
        elif i % 4 == 1 and i < 20:
            body[5:5] = other
            has[i] = 5
        else:
            if i % 4 == 2:
                body[3:3] = core[:20]  # too short to count
            clean.add(i)
        rows.append((i, " ".join(body)))
    rows += [(100, rows[2][1]), (101, rows[2][1].upper()), (102, None), (103, ""), (104, "short"), (105, "short"), (None, rows[0][1]), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, a int")
    found = repeated_passages(df, window=window).collect()
    copies = {(r.doc_id, r.other_id) for r in found if r.copy}
    assert copies == {(100, 2), (101, 2)}
    spans = {}
    for r in found:
        if not r.copy:
            for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end)):
                spans.setdefault(d, []).append((s, e))
    assert set(spans) == set(has)
    for d, at in has.items():
        n = 60 if d % 4 == 0 else 55
        assert any(s <= at + 8 and e >= at + n - 8 for s, e in spans[d]), (d, at, spans[d])
        assert all(s >= at - 3 and e <= at + n + 3 for s, e in spans[d])
    assert repeated_passages(nothing).count() == 0


@pytest.mark.parametrize("one_side", [False, True])
def test_two_passages_of_a_pair(spark, one_side):
    rng = random.Random(3)
    rows, spans = [], {}
    for k, between in enumerate([5, 10, 20, 30, 40, 60, 80, 100, 130, 170, 250, 400]):
        first, second = words(rng, 60), words(rng, 60)
        for d in (2 * k, 2 * k + 1):
            before, own = words(rng, rng.randint(0, 40)), words(rng, 0 if one_side and d % 2 else between)
            rows.append((d, " ".join(before + first + own + second + words(rng, 20))))
            spans[d] = [len(before), len(before) + 60 + len(own)]
    found = {d: [] for d in spans}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert {r.doc_id // 2} == {r.other_id // 2} and r.identity >= 0.8
        found[r.doc_id].append((r.start_word, r.end_word))
        found[r.other_id].append((r.other_start, r.other_end))
    for d, starts in spans.items():
        assert all(any(s <= at + 3 and e >= at + 57 for s, e in found[d]) for at in starts), (d, starts, found[d])


@pytest.mark.parametrize("n_lines", [5, 12])
def test_passages_of_common_lines(spark, n_lines):
    """Each line of a passage is also in many other documents, also in short ones, and parts of it are in some."""
    rng = random.Random(8)
    rows, has = [], {}
    for k in range(12):
        lines = [words(rng, 60 // n_lines) for _ in range(n_lines)]
        for i in range(3):
            before = words(rng, rng.randint(0, 30))
            has[100 * k + i] = (k, len(before))
            rows.append((100 * k + i, " ".join(before + sum(lines, []) + words(rng, 30))))
        for i, line in enumerate(lines):
            rows += [(100 * k + 10 + 4 * i + j, " ".join(words(rng, 40) + line + words(rng, 30))) for j in range(3)]
            rows.append((100 * k + 10 + 4 * i + 3, " ".join(line)))
        part = sum(lines, [])
        rows += [(100 * k + 90 + j, " ".join(words(rng, 40) + part[at : at + 44] + words(rng, 30))) for j, at in enumerate([0, 4, 8, 12, 16])]
    spans = {}
    for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if not r.copy:
            for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end)):
                spans.setdefault(d, []).append((s, e))
    assert set(spans) == set(has)
    for d, (_, at) in has.items():
        assert any(s <= at + 3 and e >= at + 57 for s, e in spans[d]), (d, at, spans[d])


def longest(a, b):
    """Most words that two lists share in order, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_words_of_gaps():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice([b"x", b"y", b"z", b"u"]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert _common(a, b) == longest(a, b)


@pytest.mark.parametrize("gap", [85, 119, 400, 3000])
def test_a_missing_word_in_a_long_gap(gap):
    rng = random.Random(gap)
    a = [w.encode() for w in words(rng, gap + 10)]
    b = a[: gap // 2] + a[gap // 2 + 1 :]
    found = align(a, b, [0, len(a) - 5], [0, len(b) - 5], 5)
    assert found[:4] == (0, len(a), 0, len(b)) and found[4] == pytest.approx((len(a) - 1) / len(a))


def test_query_against_brute_force(spark):
    """Every document that shares ``min_words`` words in a row with another is found over all of them; every passage that
    is reported has the identity it names, by the plain table; nothing else is reported. One text is very long."""
    rng = random.Random(11)
    common = [words(rng, rng.randint(50, 90)) for _ in range(6)]
    texts = {}
    for d in range(60):
        parts = [words(rng, rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            c = list(rng.choice(common))
            if d % 3 == 0:
                c[rng.randrange(len(c))] = "edit"
            parts += [c, words(rng, rng.randint(0, 60))]
        texts[d] = sum(parts, [])
    texts[60] = words(rng, 20_000) + common[0] + words(rng, 20_000)
    texts[61], texts[62] = texts[1], []
    runs = {}
    for d, w in texts.items():
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add(d)
    copied = {d: {(i, i + 50) for i in range(len(w) - 49) if len(runs[tuple(w[i : i + 50])]) > 1} for d, w in texts.items()}
    df = spark.createDataFrame([(d, " ".join(w), 1, "x") for d, w in texts.items()], "doc_id long, text string, number int, class string")
    spans = {d: [] for d in texts}
    for r in repeated_passages(df).collect():
        a, b = texts[r.doc_id][r.start_word : r.end_word], texts[r.other_id][r.other_start : r.other_end]
        assert r.copy == (a == b == texts[r.doc_id] == texts[r.other_id]) and min(len(a), len(b)) >= 50
        assert r.identity <= longest(a, b) / max(len(a), len(b)) + 1e-9 and r.identity >= 0.8
        for d, s, e in ((r.doc_id, r.start_word, r.end_word), (r.other_id, r.other_start, r.other_end)):
            spans[d].append((s, e))
    for d, need in copied.items():
        assert all(any(s <= lo and hi <= e for s, e in spans[d]) for lo, hi in need), d
    marked = {d for d in texts if spans[d]}
    assert {d for d in copied if copied[d]} <= marked and 62 not in marked


def pairs_of(spark, texts, **how):
    found = repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string"), **how).collect()
    return {tuple(sorted((r.doc_id, r.other_id))) for r in found}


def test_all_pairs_of_a_passage(spark):
    """Each document has its own changes, so each pair is a link between different texts."""
    rng = random.Random(21)
    core, texts = words(rng, 60), {}
    for d in range(8):
        passage = [f"e{d}x{i}" if i % 20 == d else w for i, w in enumerate(core)]
        texts[d] = words(rng, 20 + d) + passage + words(rng, 20)
    assert pairs_of(spark, texts) == set(itertools.combinations(range(8), 2))


@pytest.mark.parametrize("common", [4, 32])
def test_pairs_by_common_seeds(spark, common):
    """Two documents have all six lines of a passage, with words of their own between; each line is common by itself."""
    rng = random.Random(22)
    texts, want = {}, set()
    for k in range(4):
        lines = [words(rng, 10) for _ in range(6)]
        for d in (100 * k, 100 * k + 1):
            texts[d] = words(rng, 20) + sum((line + [f"own{d}"] for line in lines), []) + words(rng, 20)
        want.add((100 * k, 100 * k + 1))
        for i, line in enumerate(lines):
            texts |= {1000 + 1000 * k + 100 * i + j: words(rng, 30) + line + words(rng, 30) for j in range(40)}
    assert pairs_of(spark, texts, common=common) == want


def test_pairs_by_a_common_seed_and_a_rare_one(spark):
    rng = random.Random(23)
    texts, want = {}, set()
    line = words(rng, 10)
    for k in range(4):
        own = [words(rng, 4) for _ in range(4)] + [words(rng, 5)] + [words(rng, 4) for _ in range(4)]
        for d in (2 * k, 2 * k + 1):
            texts[d] = words(rng, 20) + line + sum(([f"own{d}", *part] for part in own), []) + words(rng, 20)
        want.add((2 * k, 2 * k + 1))
    texts |= {100 + j: words(rng, 30) + line + words(rng, 30) for j in range(40)}
    assert pairs_of(spark, texts, window=1) == want


def test_links_of_a_seed_over_batches():
    """However rows are cut into batches: all pairs of seeds with up to ``common`` rows, one link for each row of others."""
    import pyarrow as pa

    from siftwell.llm.substring_dedup import _meet, _twos

    rng = random.Random(24)
    rows = sorted({(s, rng.randrange(12), rng.randrange(50)) for s in range(40) for _ in range(rng.choice([1, 2, 4, 5, 30]))})
    groups = {s: [r[1:] for r in rows if r[0] == s] for s, *_ in rows}
    pairs = sorted((*y, *x) for g in groups.values() if len(g) <= 4 for x, y in itertools.combinations(g, 2) if x[0] != y[0])
    stars = sorted((s, *x, *g[0]) for s, g in groups.items() if len(g) > 4 for x in g)
    by_class = sorted(rows, key=lambda r: r[1:])
    near = sorted((c, p, q - p) for (_, c, p), (_, d, q) in itertools.combinations(by_class, 2) if c == d and q - p <= 7)
    for size in (1, 2, 3, 7, 50, 10**6):
        def cut(rows):
            return [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["seed", "a", "pa"]) for i in range(0, len(rows), size)]

        found = [tuple(r.values()) for b in _meet(4, pa.int32())(iter(cut([*rows, *rows[-1:]]))) for r in b.to_pylist()]
        assert sorted(r[1:] for r in found if r[0] is None) == pairs
        assert sorted({r for r in found if r[0] is not None}) == stars
        twos = [(r["a"], r["pa"] >> 16, r["pa"] & 0xFFFF) for b in _twos(7)(iter(cut(by_class))) for r in b.to_pylist()]
        assert sorted(twos) == near


def test_recurring_words_make_few_twos(spark):
    """Words on and on: links by twos grow with the words, not with words times ``min_words``; the passages are found."""
    from siftwell.llm.substring_dedup import _SEEDS, _all_links, _common_links, _seeds

    rng = random.Random(25)
    texts = {d: words(rng, 20) + ["on"] * 600 + words(rng, 20) for d in range(12)}
    rows = spark.createDataFrame([(" ".join(w),) for w in texts.values()], "text string")
    links = _all_links(rows.mapInArrow(_seeds(5, 6, 50, 8), _SEEDS), 8)
    assert _common_links(links, 8, 50).count() < 4 * links.count()
    assert {d for pair in pairs_of(spark, texts) for d in pair} == set(texts)


def test_twos_of_a_part_of_the_rows():
    """However rows are cut into batches and parts: every two goes on or has a link to the same two, unless it is known; no
    mark without more than ``common`` of them."""
    import pyarrow as pa

    from siftwell.llm.substring_dedup import _COMMON, _twos, _twos_own

    rng = random.Random(26)
    rows = [(s, c, 3 * i + rng.randrange(3), 0, i) for c in range(1, 13) for i, s in enumerate(rng.sample(range(40), rng.choice([5, 20, 40])))]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    for size, flush in (1, 5), (7, 100), (50, 10**6):
        def cut(n):
            return iter([pa.record_batch([pa.array(c, t) for c, t in zip(zip(*(r[:n] for r in rows[i : i + size]), strict=True), kinds[:n], strict=True)], names=["seed", "a", "pa", "b", "pb"][:n]) for i in range(0, len(rows), size)])

        twos = sorted((r["seed"], r["a"], r["pa"]) for b in _twos(20)(cut(3)) for r in b.to_pylist())
        found = [r for b in _twos_own(20, 3, flush)(cut(5)) for r in b.to_pylist()]
        on = [(r["seed"], r["a"], r["pa"]) for r in found if r["b"] is None]
        assert set(on) <= set(twos) and len(set(on)) == len(on)
        count = {s: sum(t[0] == s for t in twos) for s, *_ in twos}
        assert all(count[r["seed"]] > 3 for r in found if r["mark"] & _COMMON)
        assert {s for s, *_ in on} == set(count)
        assert all(t in set(on) for t in twos if count[t[0]] <= 3)


def test_texts_on_disk(spark):
    """Texts are stored packed, and a table of which all is used is deleted."""
    import pathlib

    from siftwell.llm import common as tables

    rng = random.Random(27)
    syllables = ["the", "in", "er", "on", "at", "re", "es", "nd", "ti", "ou"]
    rows = []
    for g in range(3):
        base = ["".join(rng.choices(syllables, k=3)) for _ in range(2000)]
        rows += [(4 * g + i, " ".join(f"e{i}" if rng.random() < 0.01 else w for w in base)) for i in range(4)]
    size = sum(len(text) for _, text in rows)
    with tables.scope(spark, "disk-test"):
        found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        folder = pathlib.Path(tables.table_path(spark, "").removeprefix("file:")).parent
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in found} == {(4 * g + i, 4 * g + j) for g in range(3) for j in range(4) for i in range(j)}
    stored = {p.name.rsplit("-", 1)[0]: sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in folder.iterdir()}
    tables.drop_scope(spark, "disk-test")
    assert stored["passage-texts"] < 0.4 * size and not {"links", "common-seeds"} & set(stored)


def test_packed_words():
    from siftwell.llm.substring_dedup import pack, unpack

    for text in (b"", b"a", "dérè üß\u00a0x".encode(), b"on " * 10**5):
        assert unpack(pack(text)) == text


def test_winnowing_many_texts_at_once():
    import numpy as np

    from siftwell.llm.substring_dedup import _winnowed, winnow

    rng = random.Random(28)
    for window in (1, 2, 6, 9):
        for least in (1, window):
            n = [rng.randint(least, 40) for _ in range(30)]
            start = [sum(n[:i]) + 3 * i for i in range(30)]
            hashes = np.array([rng.randrange(50) for _ in range(sum(n) + 90)], np.uint64)
            at, many = _winnowed(hashes, np.array(start), np.array(n), window)
            want = [winnow(hashes[s : s + k], window) + s for s, k in zip(start, n, strict=True)]
            assert at.tolist() == np.concatenate(want).tolist() and many.tolist() == [len(w) for w in want]
