"""Fuzzy repeated passages by seeds, collinear chains and alignment.

1. Texts with the same words form a class; the later documents of a class repeat the first as a whole. From here on
   only classes are compared.
2. Seeds are the k-word shingles that winnowing keeps: of every ``window`` neighbours the smallest hash, so two texts
   that share ``k + window - 1`` words in a row share a seed. All occurrences of a seed are linked with each other, up to
   ``common`` of them. A seed that occurs more often is a common one. Two common seeds of a text within ``min_words``
   words are a seed of their own, rarer than each, whose occurrences are linked with each other in the same way; and
   texts with one other link are linked by the common seeds around it that both have. Besides, occurrences of what is
   common are linked to the first, in each task and then overall; of a common seed no more than ``common`` + 1 rows of
   each task travel.
   Runs of ``long_seed`` words are seeds as well, winnowed so that every shared run of ``min_words`` words has one. Where
   texts share one, all runs of ``min_words`` words around it are linked to the first text that has the run: they are
   equal, so all texts that have a run are joined by it.
3. The links of two classes are chained: ordered matches, a gain for each seed, a cost for each word of a gap. A Fenwick
   tree over the places in the other text holds the best chain that ends before a place.
4. Chains are aligned word by word on the texts and extended on both sides, so a chain of some seeds of a passage finds
   the whole passage. A chain that falls short of ``identity`` as a whole is split at its gaps. Alignments of at least
   ``min_words`` words and ``identity`` are returned.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import common as tables
from siftwell.llm.common import discard
from siftwell.llm.shingles import Shingler, mix64

_LINK = ["a", "pa", "b", "pb"]
_U = np.uint64
_KNOWN, _COMMON = 1, 2


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the hashes that are the smallest of some ``window`` neighbours (all texts have one at least)."""
    n = len(hashes)
    if n <= window:
        return np.array([int(hashes.argmin())]) if n else np.zeros(0, np.int64)
    at = _least(hashes, window)
    return at[np.concatenate(([True], at[1:] != at[:-1]))].astype(np.int64)  # places never go back


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """Position of the first smallest hash of each ``window`` neighbours."""
    n = len(hashes)
    least, at, size = hashes, np.arange(n, dtype=np.int32), 1  # of the ``size`` neighbours from each, the first smallest
    while size < window:
        step = min(size, window - size)
        at = np.where(least[:-step] <= least[step:], at[:-step], at[step:])
        least = np.minimum(least[:-step], least[step:])
        size += step
    return at


def _winnowed(hashes: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``winnow`` keeps of texts with ``n`` hashes from ``start`` on: positions in all hashes, and how many of each text."""
    if not len(n) or n.min() < window:
        found = [winnow(hashes[a : a + k], window) + a for a, k in zip(start.tolist(), n.tolist(), strict=True)]
        return np.concatenate([np.zeros(0, np.int64), *found]), np.array([len(x) for x in found], np.int64)
    windows = n - window + 1
    ends = np.cumsum(windows)
    at = _least(hashes, window)[np.arange(ends[-1]) + np.repeat(start - ends + windows, windows)]
    new = np.concatenate(([True], at[1:] != at[:-1]))  # windows of two texts have no place in common
    return at[new].astype(np.int64), np.add.reduceat(new, ends - windows, dtype=np.int64)


def _firsts(seed: np.ndarray) -> np.ndarray:
    """Sorted seeds -> index of the first row of each row's seed."""
    new = np.concatenate(([True], seed[1:] != seed[:-1])) if len(seed) else np.zeros(0, bool)
    return np.flatnonzero(new)[np.cumsum(new) - 1] if len(seed) else np.zeros(0, np.int64)


def _rows(*cols: np.ndarray | None, place: pa.DataType) -> pa.RecordBatch:
    n = next(len(c) for c in cols if c is not None)
    kinds = (pa.int64(), pa.int64(), place, pa.int64(), place)
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["seed", *_LINK])


def _own(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], common: int) -> Iterator[pa.RecordBatch]:
    """Seeds, classes and places of a task's texts -> all of them; those of a seed beyond ``common`` + 1 stay here, linked to the
    first, as the seed is a common one whatever other tasks have."""
    if not parts:
        return
    seed, cls, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(seed)
    size = np.bincount(_firsts(seed[by]), minlength=len(seed))
    many = by[np.repeat(size > common + 1, size)]
    many = many[np.lexsort((pos[many], cls[many], seed[many]))]
    first = _firsts(seed[many])
    stay = np.arange(len(many)) - first > common
    to, stay = many[first[stay]], many[stay]
    go = np.ones(len(seed), bool)  # in the order of the texts, of which runs of rows have the class
    go[stay] = False
    for batch in (_rows(seed[go], cls[go], pos[go], None, None, place=pa.int32()), _rows(seed[stay], cls[stay], pos[stay], cls[to], pos[to], place=pa.int32())):
        yield from pa.Table.from_batches([batch]).to_batches(max_chunksize=1 << 17)


def long_seed(words: int, min_words: int) -> int:
    """Words of a long seed: a multiple of ``words``, three fifths of ``min_words`` at most where that is possible."""
    return words * max(1, 3 * min_words // (5 * words))


def _runs(shingles: np.ndarray, words: int, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words (``words`` at least), from those of ``words`` words."""
    m = max(0, len(shingles) + words - size)
    out = shingles[:m]
    for j in [*range(words, size - words, words), size - words]:
        out = mix64(out * _U(0x2545F4914F6CDD1D) + shingles[j : j + m])
    return out


def _seeds(words: int, window: int, min_words: int, common: int, flush: int = 1 << 21):
    """Texts under ``min_words`` have no seeds. Long seeds have the place -1 - p instead of p."""
    size = long_seed(words, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, parts, held, seen = Shingler(words), [], 0, set()

        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            for lo, _, rows, first in shingler.chunks(texts):
                mine, numbers = [], []
                for i in np.flatnonzero(np.diff(first) >= max(min_words, words)).tolist():
                    cls = _class(texts[lo + i])
                    if cls not in seen:
                        seen.add(cls)
                        mine.append(i)
                        numbers.append(_number(cls))
                start, n, runs = first[mine], np.diff(first)[mine] - words + 1, _runs(rows, words, size)
                for found, on, sign, less in (rows, n, 1, 0), (runs, n - size + words, -1, -1):
                    at, many = _winnowed(found, start, on, window if sign > 0 else max(1, min_words - size + 1))
                    parts.append((found[at].view(np.int64), np.repeat(np.array(numbers, np.int64), many), (sign * (at - np.repeat(start, many)) + less).astype(np.int32)))
                    held += len(at)
            if held > flush:
                yield from _own(parts, common)
                parts, held = [], 0
                seen.clear()
        yield from _own(parts, common)

    return run


def _class_and_size(text: bytes) -> tuple[str, int]:
    words = text.lower().split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest(), len(words)


def _class(text: bytes) -> str:
    return _class_and_size(text)[0]


def pack(words: bytes) -> bytes:
    """Words as they are stored and shuffled, in less than half the bytes; ``unpack`` gives them back."""
    return len(words).to_bytes(4, "little") + pa.compress(words, "zstd", asbytes=True)


def unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), "zstd", asbytes=True)


def _packed(min_words: int):
    """Texts -> number, class and packed words of those with ``min_words``; repeated ones once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, bytes] = {}
            for text in batch.column(0).cast(pa.binary()):
                words = (text.as_py() or b"").lower().split()
                if len(words) >= min_words:
                    joined = b" ".join(words)
                    cls = hashlib.blake2b(joined, digest_size=16).hexdigest()
                    if cls not in out:
                        out[cls] = pack(joined)
            cols = [pa.array([_number(c) for c in out], pa.int64()), pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["number", "class", "text"])

    return run


def _number(cls: str) -> int:
    """The class as a number, for the rows of seeds."""
    return int(cls[:16], 16) - (1 << 63)


def _meet(common: int, place: pa.DataType):
    """Rows sorted by seed, class and place -> links of all rows of a seed that has up to ``common``. Of other seeds each row
    is given with the seed and a link to its first row; the first one with a link to itself. A seed's rows may be in many batches.
    Rows that have a link already go through. Marks: a seed with a row of ``_COMMON`` is a common one, of which rows of
    ``_KNOWN`` need no link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # the rows of a seed that may go on
        hub = None  # a common seed of which rows have been given, class and place of its first row

        def give(seed: np.ndarray, cls: np.ndarray, pos: np.ndarray, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal hub
            first = _firsts(seed)
            size = np.bincount(first, minlength=len(seed))[first]
            marked = np.bincount(first, (mark & _COMMON) > 0, minlength=len(seed))[first] > 0
            b, pb, many = cls[first], pos[first], (size > common) | marked
            if hub and hub[0] == seed[0]:
                same = seed == seed[0]
                b, pb, many = np.where(same, hub[1], b), np.where(same, hub[2], pb), many | same
            if many.any():
                last = np.flatnonzero(many)[-1]
                hub = (seed[last], b[last], pb[last])
                told = many & ((mark & _KNOWN) == 0)
                yield _rows(seed[told], cls[told], pos[told], b[told], pb[told], place=place)
            few = np.flatnonzero(~many & (size > 1))
            first = first[few]
            for step in range(1, common):
                on = np.flatnonzero(first[step:] == first[:-step])
                if not len(on):
                    break
                i, j = few[on + step], few[on]
                far = cls[i] != cls[j]
                i, j = i[far], j[far]
                yield _rows(None, cls[i], pos[i], cls[j], pos[j], place=place)

        for batch in batches:
            if batch.num_columns > 3 and batch.column(3).null_count < len(batch):
                yield batch.filter(pc.is_valid(batch.column(3))).select([0, 1, 2, 3, 4])
                batch = batch.filter(pc.is_null(batch.column(3)))
            mark = batch.column(5).to_numpy() if batch.num_columns > 5 else np.zeros(len(batch), np.int8)
            cols = (*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), mark)
            if held:
                cols = tuple(np.concatenate(x) for x in zip(held, cols, strict=True))
            if not len(cols[0]):
                continue
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)))  # tasks may have the same texts
            cols = tuple(c[new] for c in cols)
            end = int(np.searchsorted(cols[0], cols[0][-1]))
            end = len(cols[0]) if len(cols[0]) - end > common else end
            if end:
                yield from give(*(c[:end] for c in cols))
            held = tuple(c[end:] for c in cols)
        if held and len(held[0]):
            yield from give(*held)

    return run


def _near(cls: np.ndarray, pos: np.ndarray, reach: int, old: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of each two rows of a class within ``reach`` words, of rows sorted by class and place; not those of two ``old`` ones."""
    for step in range(1, len(cls)):
        near = (cls[step:] == cls[:-step]) & (pos[step:] - pos[:-step] <= reach)
        if not near.any():
            break
        i = np.flatnonzero(near)
        i = i[i + step >= old]
        yield i, i + step


def _last(seed: np.ndarray, cls: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Index of the row before with the seed and class of each row, or its own."""
    by = np.lexsort((pos, cls, seed))
    same = (seed[by][1:] == seed[by][:-1]) & (cls[by][1:] == cls[by][:-1])
    out = np.arange(len(seed))
    out[by[1:][same]] = by[:-1][same]
    return out


def _two(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return mix64(one.view(_U) * _U(0x2545F4914F6CDD1D) + other.view(_U)).view(np.int64)


def _twos(reach: int):
    """Common seeds sorted by class and place -> each two of a class within ``reach`` words, as a seed with the place p << 16 | d
    for places p and p + d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            cols, old = tuple(batch.column(i).to_numpy() for i in range(3)), 0
            if not len(cols[0]):
                continue
            if held:
                old = len(held[0])
                cols = tuple(np.concatenate(x) for x in zip(held, cols, strict=True))
            seed, cls, pos = cols
            for i, j in _near(cls, pos, reach, old):
                at = pos[i].astype(np.int64) << 16 | (pos[j] - pos[i])
                yield pa.RecordBatch.from_arrays([pa.array(_two(seed[i], seed[j])), pa.array(cls[i]), pa.array(at)], names=["seed", "a", "pa"])
            tail = (cls == cls[-1]) & (pos >= pos[-1] - reach)
            held = tuple(c[tail] for c in cols)

    return run


def _twos_own(reach: int, common: int, flush: int = 1 << 21):
    """Common seeds with links to their first rows, sorted by class and place -> twos as ``_twos`` has them, with marks. Where
    both seeds have first rows that make the same two, the links of the seeds are those of the two (``_KNOWN``). Of twos
    that a part of the rows has more than ``common`` times only the first goes on, as ``_COMMON``; the others are
    linked to it here, or known. Where words recur within ``reach`` words, as in "on and on and on", each two is taken once
    of every ``reach`` words of a text."""

    def own(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        two, cls, at, known = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(two, kind="stable")
        two = two[by]
        first = _firsts(two)
        many = np.bincount(first, minlength=len(two))[first] > common
        head = first == np.arange(len(two))
        go, here = ~many | head, np.flatnonzero(many & ~head & ~known[by])
        mark = np.where(known[by], _KNOWN, 0) | np.where(many, _COMMON, 0)
        none = np.zeros(len(here), np.int8)
        for batch, mark in (_rows(two[go], cls[by[go]], at[by[go]], None, None, place=pa.int64()), mark[go]), (_rows(None, cls[by[here]], at[by[here]], cls[by[first[here]]], at[by[first[here]]], place=pa.int64()), none):
            yield from pa.Table.from_batches([batch]).append_column("mark", pa.array(mark, pa.int8())).to_batches(max_chunksize=1 << 17)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, held = [], 0, None
        for batch in batches:
            for lo in range(0, len(batch), 1 << 14):
                cols = tuple(batch.column(i).to_numpy()[lo : lo + (1 << 14)] for i in range(5))
                old = len(held[0]) if held else 0
                if held:
                    cols = tuple(np.concatenate(x) for x in zip(held, cols, strict=True))
                seed, cls, pos, hub, place = cols
                last = _last(seed, cls, pos)
                for i, j in _near(cls, pos, reach, old):
                    pi, back = pos[i], pos[i] - pos[last[i]]
                    new = (back == 0) | (back != pos[j] - pos[last[j]]) | (pi // reach != (pi - back) // reach)
                    i, j = i[new], j[new]
                    known = (hub[i] == hub[j]) & (place[j] - place[i] <= reach) & (place[j] > place[i])
                    parts.append((_two(seed[i], seed[j]), cls[i], pos[i].astype(np.int64) << 16 | (pos[j] - pos[i]), known))
                    size += len(i)
                tail = (cls == cls[-1]) & (pos >= pos[-1] - reach)
                held = tuple(c[tail] for c in cols)
                if size > flush:
                    yield from own(parts)
                    parts, size = [], 0
        if parts:
            yield from own(parts)

    return run


def _around(words: int, min_words: int, flush: int = 1 << 19):
    """Rows of number, packed text and the places of shared long seeds -> all runs of ``min_words`` words that hold one, linked
    as seeds are."""
    reach = min_words - long_seed(words, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, parts, held = Shingler(words), [], 0
        for batch in batches:
            numbers, spots = batch.column(0).to_numpy(), batch.column(2)
            for i, seq in shingler.sequences([unpack(t) for t in batch.column(1).to_pylist()]):
                runs = _runs(seq, words, min_words)
                edge = np.zeros(len(runs) + 1, np.int64)
                places = spots[i].values.to_numpy()
                np.add.at(edge, np.minimum(np.maximum(places - reach, 0), len(runs)), 1)
                np.add.at(edge, np.minimum(places + 1, len(runs)), -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                parts.append((runs[at].view(np.int64), np.full(len(at), numbers[i]), at.astype(np.int32)))
                held += len(at)
                if held > flush:
                    yield from _own(parts, 0)
                    parts, held = [], 0
        yield from _own(parts, 0)

    return run


def _stretches(words: int, min_words: int):
    """Links of runs of ``min_words`` words, sorted by a, b, pb - pa and pa -> chains of two seeds, the ends of a stretch.
    A stretch that batches divide is found twice, as alignment extends both to the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, p, b, q = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            if not len(a):
                continue
            on = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (q[1:] - p[1:] == q[:-1] - p[:-1]) & (p[1:] - p[:-1] <= min_words)
            lo, hi = np.flatnonzero(np.concatenate(([True], ~on))), np.flatnonzero(np.concatenate((~on, [True])))
            ends = [pa.ListArray.from_arrays(pa.array(np.arange(len(lo) + 1) * 2, pa.int32()), pa.array(np.column_stack((x[lo], x[hi] + min_words - words)).ravel(), pa.int32())) for x in (p, q)]
            yield pa.RecordBatch.from_arrays([pa.array(a[lo]), pa.array(b[lo]), *ends], names=["a", "b", "at", "other"])

    return run


def chain(matches: list[tuple[int, int]], gain: float, gap: float) -> list[list[tuple[int, int]]]:
    """Disjoint collinear chains of (place, other place), the best first; places of a chain grow on both sides.

    A match adds ``gain``, but no more than the words by which it goes on; every word skipped on either side costs ``gap``.
    """
    matches = sorted(set(matches))
    best, back = [0.0] * len(matches), [-1] * len(matches)
    if all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(matches)):  # what is just before is the best to follow
        last, score = (0, 0), 0.0
        for i, x in enumerate(matches):
            score -= gap * (x[0] - last[0] + x[1] - last[1])
            score, back[i] = (gain + score, i - 1) if score > 0 else (gain, -1)
            best[i], last = score, x
        return _taken(matches, best, back)
    rank = {p: r for r, p in enumerate(sorted({m[1] for m in matches}), 1)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(rank) + 1)
    waiting: list[int] = []
    for i, (p, q) in enumerate(matches):
        if waiting and matches[waiting[0]][0] < p:  # matches at the same place don't follow each other
            for j in waiting:
                value, r = (best[j] + gap * sum(matches[j]), j), rank[matches[j][1]]
                while r < len(tree):
                    tree[r] = max(tree[r], value)
                    r += r & -r
            waiting = []
        top, r = (-1e18, -1), rank[q] - 1
        while r:
            top = max(top, tree[r])
            r -= r & -r
        follow = top[0] - gap * (p + q)
        best[i], back[i] = (gain + follow, top[1]) if follow > 0 else (gain, -1)
        waiting.append(i)
    return _taken(matches, best, back)


def _taken(matches: list[tuple[int, int]], best: list[float], back: list[int]) -> list[list[tuple[int, int]]]:
    """The chains of matches by their scores and the matches that they follow; each match is in the best of its chains."""
    used, out = [False] * len(matches), []
    for i in sorted(range(len(matches)), key=lambda i: -best[i]):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(matches[i])
            i = back[i]
        if found:
            out.append(found[::-1])
    return out


def _chains(words: int, gap: float, least: int, size: int):
    """Rows of whole texts a, sorted by a, b, place and other place -> (a, b, places, other places), one row for each chain of
    ``least`` seeds or more. A link of ``size`` words, which has places below 0, counts as every second of ``words`` words in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        for batch in batches:
            a, p, b, q = (batch.column(i).to_numpy() for i in range(4))
            if not len(a):
                continue
            pair = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            new = pair | np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])))  # links may be repeated
            of = np.cumsum(pair) - 1
            keep = new & (np.bincount(of, np.where(p < 0, least, new))[of] >= least)
            a, p, b, q, of = (x[keep] for x in (a, p, b, q, of))
            edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))).tolist() if len(of) else [0]
            out = []
            at, other = p.tolist(), q.tolist()
            for lo, hi in itertools.pairwise(edge):
                matches = list(zip(at[lo:hi], other[lo:hi], strict=True))
                if at[lo] < 0:
                    matches = [m for i, j in matches for m in ([(i, j)] if i >= 0 else [(k - 1 - i, k - 1 - j) for k in range(0, size - words + 1, 2 * words)])]
                if len(matches) >= least:
                    out += [(a[lo], b[lo], [x[0] for x in c], [x[1] for x in c]) for c in chain(matches, words, gap) if len(c) >= least]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "at", "other"])

    return run


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Most words that two lists share in order: a row of the table of common subsequences is a number, with a bit for each
    word of a, so gaps of any length are aligned exactly."""
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    where: dict[bytes, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _extend(a: list[bytes], b: list[bytes], again: int = 3, reach: int = 6, drop: int = 20) -> tuple[int, int, int]:
    """How far two lists go on alike: words of a, of b, and equal ones, where the score is best: 1 for an equal word,
    -2 for another. After a difference they must find together again (``again`` equal words after at most ``reach``
    words on either side); it ends where the score has fallen by ``drop``."""
    i = j = same = score = top = 0
    stop = (0, 0, 0)
    while score > top - drop:
        n = 0
        limit = min(len(a) - i, len(b) - j)
        while n < limit and a[i + n] == b[j + n]:
            n += 1
        i, j, same, score = i + n, j + n, same + n, score + n
        if n and score >= top:
            stop, top = (i, j, same), score
        if set(a[i : i + reach + again]).isdisjoint(b[j : j + reach + again]):
            break
        runs = {tuple(a[i + x : i + x + again]) for x in range(min(reach, len(a) - i - again) + 1)}
        if not any(tuple(b[j + y : j + y + again]) in runs for y in range(min(reach, len(b) - j - again) + 1)):
            break
        for e in range(1, reach + 1):
            moves = [(e, e), *((e, d) for d in range(e - 1, -1, -1)), *((d, e) for d in range(e - 1, -1, -1))]
            hit = next(((x, y) for x, y in moves if len(a) - i - x >= again and a[i + x : i + x + again] == b[j + y : j + y + again]), None)
            if hit:
                shared = _common(a[i : i + hit[0]], b[j : j + hit[1]])
                i, j, same, score = i + hit[0], j + hit[1], same + shared, score + shared - 2 * (max(hit) - shared)
                break
        else:
            break
    return stop


def align(a: list[bytes], b: list[bytes], at: list[int], other: list[int], words: int, identity: float = 0.8, **reach: int) -> tuple[int, int, int, int, float]:
    """The passage around a chain: start and end in a, start and end in b (in words), share of equal words. Without its
    extensions where only these fall short of ``identity``."""
    i, j, same = at[0] + words, other[0] + words, words
    on, end, stop = other[0] - at[0], at[-1] + words, other[-1] + words
    if end - i == stop - j and a[i:end] == b[j:stop] and other == [p + on for p in at]:  # one run of equal words
        i, j, same, at, other = end, stop, same + end - i, at[:1], other[:1]
    for p, q in zip(at[1:], other[1:], strict=True):
        p, q = p + words, q + words  # ends of the next match
        da, db = p - i, q - j
        if da == db and a[i:p] == b[j:q]:
            same += da
        elif min(da, db) > 0:
            same += _common(a[i:p], b[j:q])
        i, j = max(i, p), max(j, q)
    ra, rb, rs = _extend(a[i:], b[j:], **reach)
    la, lb, ls = _extend(a[: at[0]][::-1], b[: other[0]][::-1], **reach)
    best = None
    for more in (1, 0):
        start, stop, ostart, ostop = at[0] - la * more, i + ra * more, other[0] - lb * more, j + rb * more
        found = (start, stop, ostart, ostop, min(1.0, (same + (rs + ls) * more) / max(stop - start, ostop - ostart)))
        if found[4] >= identity:
            return found
        best = best or found
    return best


def alignments(a: list[bytes], b: list[bytes], at: list[int], other: list[int], words: int, identity: float = 0.8, seen: list[tuple] | None = None, **reach: int) -> list[tuple[int, int, int, int, float]]:
    """The passages of a chain without those inside ``seen`` passages of the pair on both sides, or each other: the whole where it has ``identity``; else its parts, the ones of most seeds first, that
    have it on both sides, each aligned by itself. A part of one seed always has it, so every seed is in some part."""
    seen = list(seen or [])

    def inside(lo: int, hi: int) -> bool:
        return any(x[0] <= at[lo] and at[hi] + words <= x[1] and x[2] <= other[lo] and other[hi] + words <= x[3] for x in seen)

    if inside(0, -1):
        return []
    whole = align(a, b, at, other, words, identity, **reach)
    if whole[4] >= identity or len(at) < 2:
        return [whole]
    same = [0]
    for i, j, p, q in zip(at, other, at[1:], other[1:], strict=False):
        da, db = p - i, q - j
        x, y = a[i + words : p + words], b[j + words : q + words]
        same.append(same[-1] + (da if da == db and x == y else _common(x, y)))
    left, right = (np.array(same) - identity * np.array(x) for x in (at, other))
    slack, n, out = (1 - identity) * words + 1e-9, len(at), []
    taken = np.zeros(n + 1, np.int64)  # how many of the seeds before each are in parts
    for size in range(n, 0, -1):
        lo = np.arange(n - size + 1)
        hi = lo + size - 1
        end = 0
        for k in np.flatnonzero((left[hi] - left[lo] >= -slack) & (right[hi] - right[lo] >= -slack) & (taken[lo + size] == taken[lo])).tolist():
            if k >= end:
                end = k + size
                if not inside(k, end - 1):
                    out.append(align(a, b, at[k:end], other[k:end], words, identity, **reach))
                    seen += [out[-1]] if out[-1][4] >= identity else []
                taken[k + 1 : end + 1] += np.arange(1, size + 1)
                taken[end + 1 :] += size
        if taken[n] == n:
            break
    return out


def _cuts(lists: pa.ListArray) -> list[int]:
    """Ends of the rows of a column of lists in what ``flatten`` gives."""
    ends = lists.offsets.to_numpy()
    return (ends - ends[0]).tolist()


def _aligned(words: int, min_words: int, identity: float, **how: int):
    """Rows of two ids, their packed texts and chains, sorted by the second text -> passages of ``min_words`` words and ``identity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, []
        for batch in batches:
            keep, out = [], []
            _, *places = batch.column(4).flatten().flatten()
            cuts, (places, others) = _cuts(places[0]), (x.flatten().to_numpy() for x in places)
            for i, (b, ta, tb, (start, stop)) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), itertools.pairwise(_cuts(batch.column(4))), strict=True)):
                if b != last:
                    last, right = b, unpack(tb.as_py()).split()
                left, seen = unpack(ta.as_py()).split(), []
                for lo, hi in itertools.pairwise(cuts[start : stop + 1]):
                    for found in alignments(left, right, places[lo:hi].tolist(), others[lo:hi].tolist(), words, identity, seen, **how):
                        if min(found[1] - found[0], found[3] - found[2]) >= min_words and found[4] >= identity:
                            keep.append(i)
                            seen.append(found)
                            out.append((*found[:4], found[1] - found[0], found[4]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(),) * 5 + (pa.float64(),)
            taken = batch.select([0, 1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "other_id", "start_word", "end_word", "other_start", "other_end", "n_words", "identity"])

    return run


def materialize(df: DataFrame, label: str) -> DataFrame:
    """As in ``common``; the shuffles of the table are deleted when it is stored, as no other has them."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(name, None)
    conf.set(name, "true")
    try:
        return tables.materialize(df, label)
    finally:
        conf.unset(name) if was is None else conf.set(name, was)


_SEEDS, _CHAINS = "seed long, a long, pa int, b long, pb int", "a long, b long, at array<int>, other array<int>"


def _all_links(seeds: DataFrame, common: int) -> DataFrame:
    """Links of seeds; those of common seeds have the seed, and all occurrences of these are here, some linked to themselves."""
    return _dealt(seeds).mapInArrow(lambda rows: _meet(common, pa.int32())(_in_order(rows)), _SEEDS)


def _dealt(seeds: DataFrame) -> DataFrame:
    """Rows of a seed come together, those with a link anywhere."""
    return seeds.repartition(F.when(F.col("b").isNull(), F.col("seed")).otherwise(F.col("a"))).sortWithinPartitions("seed")


def _whole(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a column -> batches that have all rows of each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        if end or (held and held[0].column(key)[0].as_py() != keys[0]):
            yield pa.concat_batches([*held, batch.slice(0, end)])
            held = []
        held.append(batch.slice(end))
    if held:
        yield pa.concat_batches(held)


def _by_text(batches: Iterator[pa.RecordBatch], key: int, order) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the text in a column -> by the text, then by what ``order`` makes of the columns. (Spark sorts one
    number much faster than several; the links of one text fit in memory.)"""
    for batch in _whole(batches, key):
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        yield batch.take(pa.array(np.lexsort((*order(*cols)[::-1], cols[key]))))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seed -> by seed, class and place, those with a link apart. (Spark sorts one number much faster than
    three; no task has given more than some rows of a seed for each part of its rows, so a seed's rows fit in memory.)"""
    apart: list[pa.RecordBatch] = []

    def met() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = pc.is_valid(batch.column(3))
            if batch.column(3).null_count < len(batch):
                apart.append(batch.filter(given))
                batch = batch.filter(pc.invert(given))
            yield batch

    for rows in _whole(met(), 0):
        yield from apart
        apart.clear()
        seed, cls, pos = (rows.column(i).to_numpy() for i in range(3))
        size = np.bincount(_firsts(seed), minlength=len(seed))
        some = np.flatnonzero(np.repeat(size > 1, size))
        at = np.arange(len(seed))
        at[some] = some[np.lexsort((pos[some], cls[some], seed[some]))]
        yield rows.take(pa.array(at))
    yield from apart


def _common_seeds(links: DataFrame) -> DataFrame:
    """Occurrences of common seeds, each with the first one."""
    often = links.filter("seed IS NOT NULL AND pa >= 0").groupBy("seed", "a", "pa").agg(F.min(F.struct("b", "pb")).alias("x"))
    return materialize(often.select("seed", "a", "pa", "x.b", "x.pb"), "common-seeds")


def _common_links(links: DataFrame, common: int, reach: int, often: DataFrame | None = None) -> DataFrame:
    """Links of texts by common seeds (``often``, those of the links): those that have two of them within ``reach`` words, and
    those that have one of them within ``reach`` words of their only other link."""
    often = often or _common_seeds(links)
    kinds = "seed long, a long, pa long, b long, pb long"
    twos = often.repartition("a").sortWithinPartitions("a").mapInArrow(lambda rows: _twos_own(reach, common)(_by_text(rows, 1, lambda seed, a, pa, b, pb: (pa,))), f"{kinds}, mark byte")
    met = _dealt(twos).mapInArrow(lambda rows: _meet(common, pa.int64())(_in_order(rows)), kinds)
    place = lambda c, far: (F.shiftright(c, 16) + (F.col(c).bitwiseAND(0xFFFF) if far else 0)).cast("int").alias(c)
    met = met.filter("a <> b").select("a", "b", F.explode(F.array(*(F.struct(place("pa", x), place("pb", x)) for x in (False, True)))).alias("x"))
    one = links.filter("seed IS NULL AND pa >= 0").repartition("a").groupBy("a", "b").agg(F.count("*").alias("n"), F.first("pa").alias("p"), F.first("pb").alias("q")).filter("n = 1")
    often = often.select("seed", "a", "pa")
    one = one.join(often, "a").filter(F.abs(F.col("pa") - F.col("p")) <= reach)
    one = one.join(often.select("seed", F.col("a").alias("b"), F.col("pa").alias("pb")), ["b", "seed"]).filter(F.abs(F.col("pb") - F.col("q")) <= reach)
    return met.select("a", "x.pa", "b", "x.pb").unionByName(one.select(*_LINK))


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, identity: float = 0.8, words: int = 5,
    window: int = 6, gap: float = 0.2, least: int = 2, again: int = 3, reach: int = 6, drop: int = 20, common: int = 8,
) -> DataFrame:
    """Passages that documents share: id_col, other_id, start_word, end_word, other_start, other_end, n_words, identity, copy.

    Words are runs of non-blank characters, A-Z in lower case. Documents with the same words appear once for each but
    the first (smallest id), with copy true and the whole text as passage; other rows name the first document of a
    class. All pairs of classes are reported whose passage has a seed with up to ``common`` occurrences, or two common seeds
    within ``min_words`` words that occur together up to ``common`` times. Of a passage with none of these, each document
    is reported against one that has it too, not for all pairs.

    A passage has ``identity`` in equal words, exactly counted over its whole span. Chains are of ``least`` seeds of
    ``words`` words at least, winnowed by ``window``, and pay ``gap`` for each word skipped. Both ends of a chain are
    extended by the rules of ``_extend``: over differences of ``reach`` words at most that ``again`` equal words follow,
    until the score (1 for an equal word, -2 for another) has fallen by ``drop``.

    Rows with a null id, and null, empty and short texts have no passages; repeated rows are one document. An
    empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            classes, sizes = zip(*map(_class_and_size, texts), strict=True) if texts else ((), ())
            cols = [pa.array(classes, pa.string()), pa.array([_number(c) for c in classes], pa.int64()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", "class", "number", "n"])

    members = materialize(rows.mapInArrow(describe, f"id {kind}, class string, number long, n int"), "passage-members")
    heads = members.filter(F.col("n") >= min_words).groupBy("class").agg(F.min("id").alias("head"), F.first("number").alias("number"), F.first("n").alias("n"))
    heads = materialize(heads, "passage-heads")

    seeds = rows.select("text").mapInArrow(_seeds(words, window, min_words, common), _SEEDS)
    links = materialize(_all_links(seeds, common), "links")
    often = _common_seeds(links)
    near = links.filter("a <> b").select(*_LINK).unionByName(_common_links(links, common, min_words, often))
    chains = near.repartition("a").sortWithinPartitions("a").mapInArrow(lambda rows: _chains(words, gap, least, long_seed(words, min_words))(_by_text(rows, 0, lambda a, pa, b, pb: (b, pa, pb))), _CHAINS)
    chains = materialize(chains.withColumn("late", F.lit(False)), "chains")
    long = links.filter("a <> b AND pa < 0").select(F.explode(F.array(F.struct("a", "pa"), F.struct(F.col("b").alias("a"), F.col("pb").alias("pa")))).alias("x"))
    spots = materialize(long.groupBy(F.col("x.a").alias("number")).agg(F.collect_set(-1 - F.col("x.pa")).alias("spots")), "spots")
    discard(links)
    discard(often)

    used = chains.select(F.explode(F.array("a", "b")).alias("number")).unionByName(spots.select("number")).distinct()
    wanted = heads.join(used, "number", "left_semi").join(spots, "number", "left").select("number", F.col("class").alias("own"), F.col("head").alias("id"), "spots")
    texts = rows.select("text").mapInArrow(_packed(min_words), "number long, class string, text binary")
    texts = texts.join(wanted, "number").filter("class = own").dropDuplicates(["number"])
    texts = materialize(texts.select("number", "id", "text", "spots"), "passage-texts")

    runs = texts.filter("spots IS NOT NULL").select("number", "text", "spots").mapInArrow(_around(words, min_words), _SEEDS)
    stretches = _all_links(runs, 1).filter("a <> b").select(*_LINK).repartition("a").sortWithinPartitions("a").mapInArrow(lambda rows: _stretches(words, min_words)(_by_text(rows, 0, lambda a, pa, b, pb: (b, pb - pa, pa))), _CHAINS)
    stretches = materialize(stretches.withColumn("late", F.lit(True)), "stretches")
    chains = chains.unionByName(stretches).repartition("a").groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("late", "at", "other"))).alias("chains"))

    left = texts.select(F.col("number").alias("a"), F.col("id").alias("ia"), F.col("text").alias("ta"))
    right = texts.select(F.col("number").alias("b"), F.col("id").alias("ib"), F.col("text").alias("tb"))
    pairs = chains.join(left, "a").join(right, "b").select("ia", "ib", "ta", "tb", "chains")
    passages = pairs.mapInArrow(_aligned(words, min_words, identity, again=again, reach=reach, drop=drop), f"id {kind}, other_id {kind}, start_word int, end_word int, other_start int, other_end int, n_words int, identity double")
    passages = passages.dropDuplicates(["id", "other_id", "start_word", "end_word", "other_start", "other_end"]).withColumn("copy", F.lit(False))
    copies = members.select("id", "class").distinct().join(heads.select("class", F.col("head").alias("other_id"), "n"), "class").filter("id <> other_id")
    zero = F.lit(0)
    copies = copies.select("id", "other_id", zero.alias("start_word"), F.col("n").alias("end_word"), zero.alias("other_start"), F.col("n").alias("other_end"), F.col("n").alias("n_words"), F.lit(1.0).alias("identity"), F.lit(True).alias("copy"))
    return passages.unionByName(copies).withColumnRenamed("id", id_col)
