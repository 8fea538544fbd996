"""Language-model scores by prediction by partial matching (PPM) over bytes, and a unigram base.

Contexts are the last ``order`` bytes of the lower-cased text; the symbol after them is a byte or the end of the text.
The context trie is held as sorted arrays, one per depth: a node is a context with the number of symbols seen after it
and how many of them are distinct. Escapes are estimated as in method C, distinct / (total + distinct), and a shorter
context excludes the symbols that the longer one has seen. Below the empty context all remaining symbols are alike.

Pretrained: counts of whole n-grams of all training texts are summed by Spark, and the trie is made from them.
Adaptive: every document starts with an empty trie and teaches it as it is read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialize

#: The alphabet has 256 bytes and the end. Within keys a symbol takes nine bits: 0 stands before the text, byte b is b + 1, the end is 257.
END, SYMBOLS, WIDTH = 257, 257, 9
_U = np.uint64


def n_grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of order + 1 symbols that end in each byte and in the end of each text, and the index of the text."""
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes + order) - sizes - order
    stream = np.zeros(int((sizes + order).sum()), _U)
    joined = np.frombuffer(b"".join(texts).lower(), np.uint8)
    spots = np.arange(len(stream))
    text = np.repeat(np.arange(len(texts)), sizes + order)
    offset = spots - begins[text]
    body = (offset >= order) & (offset < order + sizes[text] - 1)
    stream[body] = joined.astype(_U) + _U(1)
    stream[begins + order + sizes - 1] = END
    keys = np.zeros(max(0, len(stream) - order), _U)
    for j in range(order + 1):
        keys = (keys << _U(WIDTH)) | stream[j : len(stream) - order + j]
    valid = offset[order:] >= order
    return keys[valid], text[order:][valid]


@dataclass
class Level:
    """All contexts of one depth: keys (sorted), total and distinct; den: what the next shorter context's denominator is
    after an escape from here. And its n-grams: grams (sorted), count."""

    keys: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    den: np.ndarray
    left: np.ndarray
    grams: np.ndarray
    count: np.ndarray


def _group(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted keys -> distinct keys and sums of the values."""
    if not len(keys):
        return (keys, *values)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return (keys[at], *(np.add.reduceat(v, at) for v in values))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Trie:
    """levels[d]: contexts of d symbols; grams of depth d are d symbols of context and one more.

    The trie may be a shard: all contexts of two symbols and more that end in some pairs of symbols. The two levels
    above are whole in every shard.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int, low: tuple[np.ndarray, np.ndarray] | None = None):
        """grams: distinct keys of order + 1 symbols. low: keys of two symbols and their counts, over all shards."""
        self.order, self.levels = order, []
        for depth in range(order, -1, -1):
            if depth == min(1, order) and low is not None:
                grams, counts = low
            keys = grams & _U((1 << WIDTH * (depth + 1)) - 1)
            by = np.argsort(keys, kind="stable")
            g, c = _group(keys[by], counts[by])
            contexts, total, distinct = _group(g >> _U(WIDTH), c, np.ones(len(g), np.int64))
            none = np.zeros(len(contexts))
            self.levels.insert(0, Level(contexts, total, distinct, none, none, g, c))
            grams, counts = g, c
        for depth in range(1, order + 1):
            here, below = self.levels[depth], self.levels[depth - 1]
            mask = _U((1 << WIDTH * depth) - 1)
            at, _ = _find(below.grams, here.grams & mask)  # every symbol of a context was seen after the shorter one
            _, seen = _group(here.grams >> _U(WIDTH), below.count[at] if len(at) else here.count)
            parent, _ = _find(below.keys, here.keys & _U((1 << WIDTH * (depth - 1)) - 1))
            here.left = (below.distinct[parent] - here.distinct).astype(float) if len(parent) else here.left
            here.den = below.total[parent] - seen + here.left if len(parent) else here.den

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last symbol after the others, for each key of order + 1 symbols."""
        out = np.zeros(len(grams))
        todo = np.arange(len(grams))
        den = left = None  # of the current depth after an escape: denominator, distinct symbols not excluded
        for depth in range(self.order, -1, -1):
            level = self.levels[depth]
            g = grams[todo] & _U((1 << WIDTH * (depth + 1)) - 1)
            at, known = _find(level.keys, g >> _U(WIDTH))
            fresh = np.isnan(den) if den is not None else np.ones(len(todo), bool)
            total = np.where(known, level.total[at] + level.distinct[at] if len(level.keys) else 0, np.nan)
            d = np.where(fresh, total, den if den is not None else 0)
            n = np.where(fresh, np.where(known, level.distinct[at] if len(level.keys) else 0, np.nan), left if left is not None else 0)
            where, hit = _find(level.grams, g)
            hit &= known
            with np.errstate(divide="ignore", invalid="ignore"):
                out[todo[hit]] += np.log10(level.count[where[hit]] / d[hit])
                escape = ~hit & known & (n > 0)
                out[todo[escape]] += np.log10(n[escape] / d[escape])
            rest = ~hit
            todo, at, known = todo[rest], at[rest], known[rest]
            if depth:
                den = np.where(known, level.den[at] if len(level.keys) else 0, np.nan)
                left = np.where(known, level.left[at] if len(level.keys) else 0, np.nan)
            else:
                out[todo] -= np.log10(SYMBOLS - (len(level.grams)))
        return out

    def arrays(self) -> list[dict]:
        """The levels as plain arrays, for a broadcast."""
        return [vars(level) for level in self.levels]

    @classmethod
    def from_arrays(cls, arrays: list[dict]) -> Trie:
        out = cls.__new__(cls)
        out.order, out.levels = len(arrays) - 1, [Level(**a) for a in arrays]
        return out

    def scores(self, texts: list[bytes], pairs: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of each text and its end; of a shard the part of the symbols after its pairs."""
        out = np.zeros(len(texts))
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < min(len(texts), lo + 1024) and size + len(texts[hi]) < 1 << 21:
                size += len(texts[hi])
                hi += 1
            grams, text = n_grams(texts[lo:hi], self.order)
            if pairs is not None:
                mine = _find(pairs, (grams >> _U(WIDTH)) & _U((1 << 2 * WIDTH) - 1))[1]
                grams, text = grams[mine], text[mine]
            both = np.sort((grams << _U(10)) | text.astype(_U))  # at most 1024 texts at a time
            keys, text = both >> _U(10), (both & _U(1023)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            bits = np.repeat(self.bits(keys[first]), np.diff(np.append(first, len(keys))))
            out[lo:hi] = np.bincount(text, weights=bits, minlength=hi - lo)
            lo = hi
        return out


def adaptive_score(text: bytes, order: int, model: dict | None = None, learn: bool = True) -> float:
    """log10 of the probability of a text by a trie that starts as ``model`` (contexts to counts of symbols) and learns."""
    model = defaultdict(Counter) if model is None else model
    symbols = [0] * order + [b + 1 for b in text.lower()] + [END]
    score = 0.0
    for i in range(order, len(symbols)):
        out: set[int] = set()
        for depth in range(order, -1, -1):
            seen = model.get(tuple(symbols[i - depth : i]), {})
            left = {s: c for s, c in seen.items() if s not in out}
            if left:
                d = sum(left.values()) + len(left)
                if symbols[i] in left:
                    score += math.log10(left[symbols[i]] / d)
                    break
                score += math.log10(len(left) / d)
            out |= set(seen)
        else:
            score -= math.log10(SYMBOLS - len(out))
        if learn:
            for depth in range(order + 1):
                model[tuple(symbols[i - depth : i])][symbols[i]] += 1
    return score


def _count(order: int):
    """Task: n-grams and words of the training texts -> (gram, word, n). The end of a text counts as the word of one line feed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams, counts, waiting = np.zeros(0, _U), np.zeros(0, np.int64), []

        def merge() -> None:
            nonlocal grams, counts, waiting
            keys = np.concatenate([grams, *(w[0] for w in waiting)])
            n = np.concatenate([counts, *(w[1] for w in waiting)])
            by = np.argsort(keys, kind="stable")
            grams, counts = _group(keys[by], n[by])
            waiting = []

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal grams, counts
            merge()
            for at in range(0, len(grams), 1 << 18):
                g = pa.array(grams[at : at + (1 << 18)].view(np.int64))
                yield pa.RecordBatch.from_arrays([g, pa.nulls(len(g), pa.binary()), pa.array(counts[at : at + (1 << 18)])], names=["gram", "word", "n"])
            names = list(words)
            for at in range(0, len(names), 1 << 16):
                w = pa.array(names[at : at + (1 << 16)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(w), pa.int64()), w, pa.array([words[x] for x in names[at : at + (1 << 16)]], pa.int64())], names=["gram", "word", "n"])
            grams, counts = grams[:0], counts[:0]
            words.clear()

        for batch in batches:
            texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
            words[b"\n"] += len(texts)
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) < 1 << 22:
                    size += len(texts[hi])
                    hi += 1
                for t in texts[lo:hi]:
                    words.update(t.lower().split())
                keys = np.sort(n_grams(texts[lo:hi], order)[0])
                waiting.append(_group(keys, np.ones(len(keys), np.int64)))
                lo = hi
                if sum(len(w[0]) for w in waiting) > max(1 << 21, len(grams)):
                    merge()
                if len(grams) > 1 << 22 or len(words) > 1 << 20:
                    yield from give()
        yield from give()

    return run


def _shards(sizes: list[tuple[int, int]], most: int) -> list[np.ndarray]:
    """Pairs of symbols -> groups of pairs whose n-grams number at most ``most`` (a single pair may have more)."""
    out, n = [[]], 0
    for pair, size in sorted(sizes):
        if out[-1] and n + size > most:
            out.append([])
            n = 0
        out[-1].append(pair)
        n += size
    return [np.array(x, _U) for x in out]


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, order: int = 5, adaptive: bool = False,
    frequent: int = 150_000, max_grams: int = 8_000_000,
) -> DataFrame:
    """One row per input row: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out marks the rows that nothing is learned from; by default crc32 of the id as text, modulo 5, is 1. base_score:
    log10 probability under a unigram model of the lower-cased words and an end, with half a count added to each. score:
    log10 probability of the whole lower-cased text and its end by PPM with contexts of up to ``order`` bytes
    (order + 1 symbols must fit 54 bits), trained on the other rows, or adaptive. Null texts are empty, null ids count
    as the empty text; repeated rows count and come back as often as they occur. Other columns are ignored.

    Counts of the most ``frequent`` words go to all tasks, the others are joined. A trie of more than ``max_grams``
    n-grams is split into shards by the last two symbols of contexts, and the texts are read once for each shard.
    """
    spark = docs.sparkSession
    if order < 1 or (order + 1) * WIDTH > 54:
        raise ValueError("order must be 1 to 5")
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    held = F.coalesce(key % 5 == 1 if held_out is None else held_out, F.lit(False)).alias("held")
    rows = docs.select(F.col(id_col).alias("id"), held, F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    raw = rows.filter(~F.col("held")).select("text").mapInArrow(_count(order), "gram long, word binary, n long")
    learned = materialize(raw.groupBy("gram", "word").agg(F.sum("n").alias("n")), "lm-counts")
    words, grams = learned.filter("word IS NOT NULL").select("word", "n"), learned.filter("gram IS NOT NULL").select("gram", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    log_base = math.log10(total + 0.5 * (distinct + 1))
    top = words.filter(F.octet_length("word") <= 64).orderBy(F.desc("n"), "word").limit(frequent).toArrow()  # 64 bytes each at most
    known = spark.sparkContext.broadcast(dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True)))
    rest_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def base(texts: list[bytes]) -> list[pa.Array]:
        """n_tokens, n_known and sum of logs among the frequent words; the other words with their counts."""
        memo = {w: math.log10(n + 0.5) for w, n in known.value.items()} if not hasattr(known, "memo") else known.memo
        known.memo = memo  # kept by this process
        out = []
        for t in texts:
            tokens = t.lower().split()
            tokens.append(b"\n")
            logs = list(map(memo.get, tokens))
            rest = Counter(w for w, x in zip(tokens, logs, strict=True) if x is None) if None in logs else {}
            have = [x for x in logs if x is not None]
            out.append((len(tokens), len(have), math.fsum(have), [{"word": w, "n": n} for w, n in rest.items()]))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), rest_type), strict=True)]

    def task(trie, pairs, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Trie.from_arrays(trie.value) if trie else None
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                    score = model.scores(texts, pairs) if model else np.array([adaptive_score(t, order) for t in texts])
                    more = [part.column(2), part.column(3), *base(texts)] if first else []
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), *more], names=["row", "score", "id", "held", "n_tokens", "n_known", "base", "rest"][: 2 + len(more)])

        return run

    whole = f"row long, score double, id {kind}, held boolean, n_tokens long, n_known long, base double, rest array<struct<word: binary, n: int>>"
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "text", "id", "held")
    if adaptive:
        scored = materialize(rows.mapInArrow(task(None, None, True), whole), "lm-scores")
    else:
        low = grams.groupBy(F.col("gram").bitwiseAND((1 << 2 * WIDTH) - 1).alias("g")).agg(F.sum("n").alias("n")).toArrow()  # 66,306 rows at most
        low = tuple(low.column(c).to_numpy() for c in ("g", "n"))
        pair = F.shiftright("gram", WIDTH).bitwiseAND((1 << 2 * WIDTH) - 1)
        sizes = [(r["p"], r["n"]) for r in grams.groupBy(pair.alias("p")).agg(F.count("*").alias("n")).collect()]
        shards = _shards(sizes, max_grams)
        if len(shards) > 1:
            rows = materialize(rows, "lm-texts")
        scored = None
        for pairs in shards:
            mine = grams if len(shards) == 1 else grams.filter(pair.isin([int(p) for p in pairs]))
            got = mine.toArrow()
            g, n = got.column("gram").to_numpy().astype(_U), got.column("n").to_numpy()
            by = np.argsort(g)
            arrays = Trie(g[by], n[by], order, (low[0].astype(_U), low[1])).arrays()
            del got, g, n, by
            trie = spark.sparkContext.broadcast(arrays)
            pass_ = materialize(rows.mapInArrow(task(trie, pairs if len(shards) > 1 else None, scored is None), whole if scored is None else "row long, score double"), "lm-scores")
            scored = pass_ if scored is None else scored.unionByName(pass_, allowMissingColumns=True)
            del arrays
            trie.unpersist()
        if len(shards) > 1:
            scored = materialize(scored.groupBy("row").agg(F.sum("score").alias("score"), *(F.first(c, ignorenulls=True).alias(c) for c in ("id", "held", "n_tokens", "n_known", "base", "rest"))), "lm-scores")

    rest = scored.select("row", F.explode("rest").alias("w")).select("row", "w.word", F.col("w.n").alias("times"))
    found = rest.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = found.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("logs"))
    out = scored.drop("rest").join(found, "row", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * log_base).alias("base_score"), "score",
    )
