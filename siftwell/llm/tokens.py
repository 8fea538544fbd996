"""Token ids of texts, with a memory of frequent units.

A byte-level BPE tokenizer first cuts a text by a fixed pattern and never merges
across a cut. ``UnitEncoder`` cuts at some of these places, which it finds in the bytes of many
texts at once (before white space that follows something else, and between ASCII
letters, digits and signs), so the ids of a text are the ids of its units, and each
unit is encoded by the library once.
Texts in which this does not hold (Unicode white space, strings of added tokens,
other kinds of tokenizers) go to the library whole.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: 1 ASCII letters, 2 digits, 3 signs; 0 for what the pattern may treat in another way beside them.
_KIND = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if chr(b).isprintable() and chr(b) not in " '" else 0 for b in range(128)] + [0] * 128, np.int8)


def worker_state() -> dict:
    """A dictionary that lives as long as this Python process."""
    return sys.modules.setdefault("_siftwell_worker", types.ModuleType("_siftwell_worker")).__dict__


def forget() -> None:
    """Free what other operators have left in this Python process, which Spark uses again and again."""
    worker_state().pop("encoder", None)
    worker_state().pop("definition", None)


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer's definition; by default that of the public byte-level BPE vocabulary of 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class UnitEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit numbers.

    When ``limit`` units are remembered, they become the old ones; the old ones before are forgotten, and old ones that
    are met again are remembered anew. So 2 * limit units are held at most, and frequent ones stay.
    """

    def __init__(self, definition: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.by_unit = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.line = self._whole("\n")
        self.by_unit = self.by_unit and len(self.line) == 4
        self.seen: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.limit = limit

    @classmethod
    def here(cls, definition: str) -> UnitEncoder:
        """The encoder of this process."""
        state = worker_state()
        if state.get("definition") != definition:
            state["encoder"], state["definition"] = cls(definition), definition
        return state["encoder"]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _encode(self, units: list[bytes]) -> None:
        """Units without line breaks are encoded many at a time, joined by line breaks, each of which is one id."""
        plain = [u for u in units if not u.isspace()]
        self.seen.update((u, self._whole(u.decode())) for u in units if u.isspace())
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = np.frombuffer(self._whole(b"\n".join(part).decode()), "<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(self.line, "<u4")[0])
            if len(cuts) == len(part) - 1:
                raw, ends = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
                at = 0
                for u, end in zip(part, ends, strict=True):
                    self.seen[u] = raw[at:end]
                    at = end + 4
            else:
                self.seen.update((u, self._whole(u.decode())) for u in part)

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self.ids_of([t.encode() for t in texts])]

    def ids_of(self, texts: list[bytes], size: int = 1_000_000) -> Iterator[np.ndarray]:
        """The ids of UTF-8 texts, about ``size`` bytes at a time: units that are new in any of these are encoded together.
        Only the ids of these are held, as places of units take many times their bytes."""
        at = 0
        while at < len(texts):
            end, n = at + 1, len(texts[at])
            while end < len(texts) and n + len(texts[end]) < size:
                n += len(texts[end])
                end += 1
            yield from self._some(texts[at:end])
            at = end

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        alone = set(range(len(texts))) if not self.by_unit else _holding(texts, self.added)
        ids = self._by_unit([t for i, t in enumerate(texts) if i not in alone])
        return [np.frombuffer(self._whole(t.decode()), "<u4") if i in alone else next(ids) for i, t in enumerate(texts)]

    def _by_unit(self, texts: list[bytes]):
        """Cuts the texts into units, looks each distinct one up once, and puts the ids together by position."""
        joined = b"".join(texts)
        edges = np.cumsum([0, *map(len, texts)])
        if not joined:
            yield from (np.zeros(0, "<u4") for _ in texts)
            return
        begins = unit_starts(np.frombuffer(joined, np.uint8), edges)
        units = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(joined)).astype(np.int32)), pa.py_buffer(joined)])
        coded = units.dictionary_encode()
        kinds, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self._known(kinds)
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(size) - size
        sizes = size[which]
        until = np.cumsum(sizes)
        ids = flat[np.repeat(start[which] - until + sizes, sizes) + np.arange(until[-1])]
        cuts = np.append(0, until)[np.searchsorted(begins, edges)]
        yield from (ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def _known(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units: from the memory, else from the old one, else from the library."""
        if len(self.seen) > self.limit:
            self.old, self.seen = self.seen, {}
        found = list(map(self.seen.get, units))
        gaps = [i for i, x in enumerate(found) if x is None]
        missing = [units[i] for i in gaps]
        again = {u: self.old[u] for u in missing if u in self.old}
        self.seen.update(again)
        self._encode([u for u in missing if u not in again])
        for i, u in zip(gaps, missing, strict=True):
            found[i] = self.seen[u]
        return found


def unit_starts(buf: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where units begin in texts that stand end to end, with their edges. A unit is a run of non-blank characters with
    one space before it, if there is one; else what remains of a run of blank characters, of which one that is no space
    and stands before a word is a unit by itself. Non-blank runs are cut between ASCII letters, digits and signs, of
    which the apostrophe is none."""
    blank = _SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[edges] = True
    after = np.append(False, blank[:-1]) & ~first[:-1]  # follows a blank one of the same text
    before_word = blank & ~np.append(blank[1:], True) & ~first[1:]
    begins = np.where(blank, ~after | before_word, first[:-1] | (after & (np.append(0, buf[:-1]) != 32)))
    kind = _KIND[buf]
    begins[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    return np.flatnonzero(begins)


def _holding(texts: list[bytes], added: list[str]) -> set[int]:
    """Texts with Unicode white space or strings of added tokens (or, which does no harm, next to one)."""
    joined = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    spots: list[np.ndarray] = []
    for a in (x.encode() for x in added if x):
        at = joined.find(a)
        while at >= 0:
            spots.append(np.array([at, at + len(a) - 1]))
            at = joined.find(a, at + 1)
    if not joined.isascii():
        buf = np.append(np.frombuffer(joined, np.uint8), np.zeros(2, np.uint8))
        lead = np.flatnonzero((buf >= 0xC2) & (buf <= 0xE3))
        lead = lead[np.isin(buf[lead], (0xC2, 0xE1, 0xE2, 0xE3))]
        code = buf[lead].astype(np.int32) << 16 | buf[lead + 1].astype(np.int32) << 8 | np.where(buf[lead] == 0xC2, 0, buf[lead + 2])
        spots.append(lead[np.isin(code, _WIDE)])
    at = np.concatenate(spots) if spots else np.zeros(0, np.int64)
    return set(np.searchsorted(ends, at, side="right").tolist())


#: UTF-8 of U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000, two bytes moved up to three.
_WIDE = np.array([0xC28500, 0xC2A000, 0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080], np.int32)
