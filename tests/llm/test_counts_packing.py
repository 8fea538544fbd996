from __future__ import annotations

import functools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwell.llm.packing import best_fit, lower_bound, pack
from siftwell.llm.token_counts import token_counts
from siftwell.llm.tokens import UnitEncoder, tokenizer_json


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    return UnitEncoder(tokenizer_json(), limit=50)


@functools.cache
def _small_memory():
    return UnitEncoder(tokenizer_json(), limit=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB9é's -_”²\x01 \n\t\r\x0b\x1c\x85\xa0\u2003\u3000.,!|<"), st.characters(codec="utf-8")), max_size=40))
def test_units_give_the_ids_of_the_library(text):
    encoder = _small_memory()
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_units_on_chosen_texts(encoder, tokenizer):
    for text in ("", " ", "a  b", "a \n b", "\n\na", "x<|endoftext|>y", "it's  we'll\n've", "a\xa0 b", "a \xa0b", "!\x1c a", "tail \n", "don't.5's", "a1b2c3 ...x ,y", "wor—d,”, 'x'd", " 's's5'll"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_counts(spark, documents, nothing, tokenizer, tmp_path):
    cache = str(tmp_path / "cache")
    rows = documents.collect()
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in rows)
    for _ in range(2):
        found = token_counts(documents, cache_path=cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected
        assert spark.read.parquet(cache).count() == len({r.text or "" for r in rows})  # the second run appends nothing
    assert token_counts(nothing).count() == 0


def test_packing(documents, nothing, tokenizer):
    capacity = 64
    found = pack(documents, capacity=capacity, part_rows=20).collect()
    ids = defaultdict(list)
    for r in documents.collect():
        ids[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for doc, texts in ids.items():
        whole = texts[0]
        assert sum(p.length for p in pieces[doc]) == sum(map(len, texts))
        for p in pieces[doc]:
            assert p.ids_crc32 == zlib.crc32(np.asarray(whole[p.start : p.start + p.length], "<u4").tobytes())
            assert p.length == capacity or p.piece == 0
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = np.array([r.length for r in found])
    assert len(places) == lower_bound(*np.unique(lengths, return_counts=True), capacity)
    assert pack(nothing).count() == 0


def test_packing_keeps_large_ids_beside_null(spark):
    big = (1 << 60) + 1
    rows = spark.createDataFrame([(big, "a"), (None, "b"), (big + 2, "c"), (big + 2, "c")], "doc_id long, text string")
    found = pack(rows).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(map(str, (big, big + 2, big + 2, None)))
    assert len({r.sequence_id for r in found}) == 1 and sorted(r.offset for r in found) == [0, 2, 4, 6]


def test_a_cache_with_repeated_rows_counts_once(spark, documents, tmp_path):
    cache = str(tmp_path / "cache")
    expected = sorted(map(str, token_counts(documents, cache_path=cache).collect()))
    spark.read.parquet(cache).write.mode("append").parquet(cache)
    assert sorted(map(str, token_counts(documents, cache_path=cache).collect())) == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7))
def test_bounds_are_valid_and_best_fit_packs(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offsets, made = best_fit(lengths, 12)
    fill = defaultdict(int)
    for bin_, offset, n in zip(where, offsets, lengths, strict=True):
        assert offset == fill[bin_]
        fill[bin_] += n
    assert len(fill) == made and max(fill.values(), default=0) <= 12

    def fewest(rest, bins):
        if not rest:
            return len(bins)
        tries = [fewest(rest[1:], [*bins, rest[0]])]
        tries += [fewest(rest[1:], [*bins[:i], b + rest[0], *bins[i + 1 :]]) for i, b in enumerate(bins) if b + rest[0] <= 12 and b not in bins[:i]]
        return min(tries)

    bound = lower_bound(*np.unique(np.array(lengths, int), return_counts=True), 12)
    assert bound <= fewest(lengths, []) <= made


def test_few_ids_and_places_are_held():
    """The ids of many texts are made in parts: what is held at once doesn't grow with the texts."""
    import tracemalloc

    encoder = UnitEncoder(tokenizer_json())
    texts = [f"some words {i % 50} in a row of many " .encode() * 40 for i in range(6000)]  # 8 MB
    n = sum(map(len, encoder.ids_of(texts[:10])))
    tracemalloc.start()
    assert sum(map(len, encoder.ids_of(texts))) > n
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000
