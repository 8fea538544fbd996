"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on posterior labels.

Voters look at the whole text and vote toxic, clean or not at all. Some are given: word lists in four languages and patterns
(insults addressed to the reader, masked words, shouting, exclamation marks). Others are mined: words and beginnings of words
that documents labelled toxic hold more often or more densely than others, each with the rule (so many hits, such a share
of the words) under which it was precise. One votes by how much of the text all lists find, from nothing to one word of 120.

The label model takes a document's class as hidden. By expectation maximisation over the distinct patterns of votes of all
documents it estimates the prior, how often each voter speaks in either class (its accuracy) and how much voters
repeat each other within a class (their correlations): a vote weighs its log likelihood ratio, divided by one plus its positive
correlations with the others, and so does its silence. Votes that exclude each other, such as amounts, are one voter with several
answers. A known label is a sure vote; where it is missing it says nothing.

A logistic model of hits, densities, shape and byte runs is then fitted to the posteriors of all documents by Newton steps. All
of a text that later steps need is in one compact row, so texts are read once. Only the labelled rows from which voters are
mined are a sample, of at most ``max_labelled`` ids chosen by a hash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialize
from siftwell.llm.tokens import forget

#: Common insults as whole words, and words that address the reader.
STOCK = {
    "en": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "worthless", "pathetic", "disgusting", "clown", "filth", "fool", "imbecile", "bastard", "bitch", "asshole", "retard", "vermin"),
    "de": ("idiot", "trottel", "dummkopf", "arschloch", "abschaum", "dreckig", "widerlich", "wertlos", "vollidiot", "schwachkopf", "hurensohn", "drecksau"),
    "fr": ("idiot", "imbécile", "crétin", "connard", "salaud", "ordure", "stupide", "débile", "abruti", "minable", "racaille", "pourriture"),
    "es": ("idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "cabrón", "gilipollas", "asqueroso", "patético", "payaso", "inútil"),
}
ADDRESS = ("you", "your", "youre", "du", "dein", "deine", "tu", "toi", "vous", "usted", "eres")
#: (hits at least, share of the words at least)
RULES = ((1, 1 / 300), (1, 1 / 120), (2, 1 / 250))
#: How much of a text the lists find: nothing, less than one word of 300, one word, two words or more, those and one word of 120.
AMOUNTS = ("nothing", "sparse", "single", "several", "dense")
GRAMS, SLICES, CHUNK = 64, 16, 4096
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b[A-Za-z][*#@$%]{2,}[A-Za-z]*")
_STOCK_OF = {w: tuple(i for i, lang in enumerate(STOCK) if w in STOCK[lang]) for lang in STOCK for w in STOCK[lang]}
_OTHERS = ("lexicon", "stock", "address", "masked", "words", "upper", "exclaims", "signs", "distinct", "length")


def units_of(word: str) -> list[str]:
    """What a word may be found by: itself, and its beginnings of four to eight letters."""
    return [f"={word}", *(f"<{word[:n]}" for n in range(4, min(8, len(word) - 1) + 1))]


@dataclass
class Voters:
    """mined: (unit, rule) of the mined voters. All voters: the mined ones, then the given ones of ``names``."""

    mined: list[tuple[str, int]]

    def __post_init__(self) -> None:
        self.units = list(dict.fromkeys(u for u, _ in self.mined))
        self.place = {u: i for i, u in enumerate(self.units)}
        self.heads = {u[1:5] for u in self.units} | {w[:4] for w in _STOCK_OF}
        self.names = [f"{u} {r}" for u, r in self.mined] + [f"stock {x}" for x in STOCK] + ["address", "masked", "shouting", "exclaims", *AMOUNTS]
        self.clean = np.array([n in AMOUNTS[:2] for n in self.names])
        self.exclusive = np.array([n in AMOUNTS for n in self.names])
        self.width = len(self.units) + len(STOCK) + len(_OTHERS) + GRAMS

    def look(self, text: str) -> np.ndarray:
        """Everything about a text that votes and features need."""
        out = np.zeros(self.width, np.float32)
        n_units = len(self.units)
        counts = Counter(_WORD.findall(text.lower()))
        words = sum(counts.values())
        lexicon = stock = 0
        for word, n in counts.items():
            if word[:4] in self.heads:
                found = [self.place[u] for u in units_of(word) if u in self.place]
                if found:
                    out[found] += n
                    lexicon += n
                if word in _STOCK_OF:
                    out[[n_units + i for i in _STOCK_OF[word]]] += n
                    stock += n
        raw = text.encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8)
        at = n_units + len(STOCK)
        letters = max(1, int((((b | 32) - np.uint8(97) < 26) | (b >= 0xC2)).sum()))
        out[at : at + len(_OTHERS)] = [
            lexicon, stock, _addressed(text) if stock else 0, len(_MASKED.findall(text)), words, ((b >= 65) & (b <= 90)).sum() / letters, (b == 33).sum() / max(1, words),
            np.isin(b, _SIGNS).sum() / max(1, len(b)), len(counts) / max(1, words), letters / max(1, words) / 10,
        ]
        wide = b.astype(np.uint32)
        grams = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(26)
        out[at + len(_OTHERS) :] = np.sqrt(np.bincount(grams, minlength=GRAMS) / max(1, len(b)))
        return out

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        n, s = len(self.units), len(STOCK)
        return x[:, :n], x[:, n : n + s], {name: x[:, n + s + i] for i, name in enumerate(_OTHERS)}

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Which voters speak, a row for each text."""
        hits, stock, o = self._split(x)
        words = np.maximum(1, o["words"])
        out = [(hits[:, self.place[u]] >= RULES[r][0]) & (hits[:, self.place[u]] >= RULES[r][1] * words) for u, r in self.mined]
        out += [stock[:, i] >= 1 for i in range(len(STOCK))]
        both = np.maximum(o["lexicon"], o["stock"])
        out += [
            o["address"] >= 1, o["masked"] >= 2, (o["upper"] >= 0.6) & (words >= 8), (o["exclaims"] >= 0.2) & (words >= 8),
        ]
        level = np.select([both == 0, both * 300 < words, both == 1, both * 120 < words], range(4), 4)
        out += [level == i for i in range(len(AMOUNTS))]
        return np.column_stack(out)

    def features(self, x: np.ndarray) -> np.ndarray:
        hits, stock, o = self._split(x)
        counted = np.column_stack([hits, stock, o["lexicon"], o["stock"], o["address"], o["masked"]])
        share = np.minimum(1, 40 * counted / (o["words"][:, None] + 20))
        shape = np.column_stack([o["upper"], np.minimum(1, o["exclaims"]), o["signs"], o["distinct"], np.minimum(2, o["length"]), np.log1p(o["words"]) / 10])
        dense = np.minimum(1, 300 * np.maximum(o["lexicon"], o["stock"]) / np.maximum(1, o["words"]))
        return np.column_stack([np.minimum(counted, 3) / 3 * dense[:, None], share, shape, x[:, -GRAMS:]]).astype(float)


_SIGNS = np.array([i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-?()!"], np.uint8)


def _addressed(text: str) -> int:
    """Insults at most three words after a word that addresses the reader."""
    words = _WORD.findall(text.lower().replace("'", "").replace("’", ""))
    spots = [i for i, w in enumerate(words) if w in _STOCK_OF]
    return sum(any(w in ADDRESS for w in words[max(0, i - 3) : i]) for i in spots)


def _sure(n1: int, n0: int) -> float:
    """The share of toxic documents, less one standard error."""
    p = (n1 + 0.5) / (n1 + n0 + 1)
    return p - np.sqrt(p * (1 - p) / (n1 + n0 + 1))


def choose_voters(counts: list[tuple[str, int, int, int]], most: int = 64, precision: float = 0.8) -> list[tuple[str, int]]:
    """counts: (unit, rule, toxic documents, clean documents). The best, whole words and long beginnings first; a unit that
    is part of a chosen one, or has it as a part, must find more than that, be more precise, or have a laxer rule."""
    ranked = sorted((n1 * (2 * (n1 + 0.5) / (n1 + n0 + 1) - 1), u.startswith("="), len(u), u, -r, n1, n0) for u, r, n1, n0 in counts if _sure(n1, n0) >= precision)[::-1]
    out: list[tuple[str, int, int, int]] = []
    for _, _, _, u, stricter, n1, n0 in ranked:
        r = -stricter
        if len(out) == most:
            break
        nested = [(v, s, m1, m0) for v, s, m1, m0 in out if v[1:].startswith(u[1:]) or u[1:].startswith(v[1:])]
        if not any(s <= r and n1 <= 1.1 * m1 and n0 * m1 >= m0 * n1 for _, s, m1, m0 in nested):
            out.append((u, r, n1, n0))
    return sorted((u, r) for u, r, _, _ in out)


def mine_voters(docs: DataFrame, gold: DataFrame, max_labelled: int = 20_000, least: int = 4, most: int = 64) -> Voters:
    """docs: (id, text). gold: (id, y). Voters from the documents of at most max_labelled labelled ids."""
    chosen = gold.orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    sample = materialize(docs.join(F.broadcast(chosen), "id").select("y", "text"), "labelled")

    def fired(counts: Counter, among: set[str] | None) -> Iterator[tuple[str, int]]:
        words, hits = sum(counts.values()), Counter()
        for word, n in counts.items():
            for u in units_of(word):
                if among is None or u in among:
                    hits[u] += n
        for u, n in hits.items():
            for r, (at_least, share) in enumerate(RULES):
                if n >= at_least and n >= share * words:
                    yield u, r

    def counter(among: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    total.update(fired(Counter(_WORD.findall((text or "").lower())), among))
                    if len(total) > 200_000:
                        yield _counted(total)
                        total = Counter()
            if total:
                yield _counted(total)

        return run

    schema = "unit string, rule int, n long"
    toxic = sample.filter("y = 1").select("text").mapInArrow(counter(None), schema).groupBy("unit", "rule").agg(F.sum("n").cast("int").alias("n1")).filter(F.col("n1") >= least)
    toxic = materialize(toxic, "units")
    units = {r["unit"] for r in toxic.select("unit").distinct().collect()}  # of max_labelled texts, met in ``least`` of them
    clean = sample.filter("y = 0").select("text").mapInArrow(counter(units), schema).groupBy("unit", "rule").agg(F.sum("n").cast("int").alias("n0")) if units else toxic.select("unit", "rule").limit(0).withColumn("n0", F.lit(0))
    counts = toxic.join(clean, ["unit", "rule"], "left").fillna(0, ["n0"]).filter("n1 > n0")
    return Voters(choose_voters([(r["unit"], r["rule"], r["n1"], r["n0"]) for r in counts.collect()], most))


def _counted(total: Counter) -> pa.RecordBatch:
    units, rules = zip(*total, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(rules, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["unit", "rule", "n"])


def _summed(rows: DataFrame, sums) -> np.ndarray | None:
    """The sum of sums(batch), a vector, over all batches: tasks add up their own, then slices of the vectors are added up."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                got = sums(batch.slice(at, CHUNK))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in np.array_split(total, SLICES)], pa.binary())], names=["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[i] = total[i] + np.frombuffer(s) if i in total else np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], names=["slice", "sums"])

    found = rows.mapInArrow(own, "slice int, sums binary").repartition(SLICES, "slice").mapInArrow(add, "slice int, sums binary").collect()  # SLICES rows
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["slice"])]) if found else None


@dataclass
class LabelModel:
    """Estimates of the label model. speaks: the probability that a voter speaks, given a clean or toxic document (2, voters);
    correlation: the mean of the two classes' correlations of speaking. exclusive: voters of which one speaks always. The last
    two voters are the known labels, toxic and clean."""

    prior: float
    speaks: np.ndarray
    correlation: np.ndarray
    exclusive: np.ndarray

    @classmethod
    def start(cls, clean: np.ndarray, exclusive: np.ndarray) -> LabelModel:
        """Before any data: voters are right nine times of ten, in one document of ten toxic."""
        speaks = np.where(np.append(clean, [False, True]), [[0.9], [0.1]], [[0.02], [0.3]])
        speaks[:, -2:] = [[0.005, 0.3], [0.3, 0.005]]
        return cls(0.1, speaks, np.eye(speaks.shape[1]), np.append(exclusive, [False, False]))

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """What a vote adds to the log odds, and what silence adds; a missing label adds nothing."""
        alone = self.exclusive.copy()
        alone[-2:] = True
        repeats = np.maximum(0, self.correlation - np.eye(len(self.correlation)))
        repeats[alone], repeats[:, alone] = 0, 0
        told = np.clip(np.log(self.speaks[1] / self.speaks[0]), -6, 6) / (1 + repeats.sum(axis=1))
        silent = np.log((1 - self.speaks[1]) / (1 - self.speaks[0])) / (1 + repeats.sum(axis=1))
        silent[alone] = 0
        told[-2:] = 6, -6
        return told, silent

    def accuracy(self) -> np.ndarray:
        """The probability that a document on which a voter speaks is toxic."""
        joint = self.speaks * np.array([[1 - self.prior], [self.prior]])
        return joint[1] / joint.sum(axis=0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        told, silent = (w[: votes.shape[1]] for w in self.weights())
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + silent.sum() + votes @ (told - silent), -30, 30)))

    def sums(self, votes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """What one step of estimation needs from these patterns: masses, votes and pairs of votes in either class."""
        q = self.posterior(votes)
        out = []
        for mass in (times * (1 - q), times * q):
            weighted = votes * mass[:, None]
            out += [[mass.sum()], weighted.sum(axis=0), (weighted.T @ votes).ravel()]
        return np.concatenate(out)

    @classmethod
    def of(cls, sums: np.ndarray, exclusive: np.ndarray) -> LabelModel:
        halves = np.split(sums, 2)
        m = int(np.sqrt(len(halves[0]) - 0.75) - 0.5)
        speaks, corr = [], []
        for half in halves:
            mass, one, two = half[0], half[1 : m + 1], half[m + 1 :].reshape(m, m)
            p = (one + 0.5) / (mass + 1)
            spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
            speaks.append(p)
            corr.append((two / max(mass, 1e-9) - np.outer(p, p)) / np.maximum(spread, 1e-6))
        mass = halves[0][0] + halves[1][0]
        return cls(float((halves[1][0] + 0.5) / (mass + 1)), np.array(speaks), np.clip(np.mean(corr, axis=0), -1, 1), exclusive)


def fit_labels(patterns: DataFrame, clean: np.ndarray, exclusive: np.ndarray, rounds: int = 10) -> LabelModel:
    """patterns: (votes, gold, times): distinct patterns of votes as bytes, the known label or null, how often."""
    m = len(clean)

    def of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        votes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, m)
        gold = np.array([-1 if g is None else g for g in batch.column(1).to_pylist()])
        return np.column_stack([votes, gold == 1, gold == 0]).astype(float), np.asarray(batch.column(2)).astype(float)

    model = LabelModel.start(clean, exclusive)
    for _ in range(rounds):
        sums = _summed(patterns.select("votes", "gold", "times"), lambda batch, now=model: now.sums(*of(batch)))
        if sums is None:
            break
        model, before = LabelModel.of(sums, model.exclusive), model
        if np.abs(model.weights()[0] - before.weights()[0]).max() < 1e-3:
            break
    return model


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def rows(self, f: np.ndarray) -> np.ndarray:
        return np.column_stack([(f - self.mean) / self.scale, np.ones(len(f))])

    def score(self, f: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.rows(f) @ self.weight, -30, 30)))


def fit_classifier(seen: DataFrame, voters: Voters, model: LabelModel, penalty: float = 1.0, steps: int = 12) -> Classifier:
    """Newton steps on the penalised likelihood of the posteriors of all rows (x)."""
    column = seen.schema.names.index("x")

    def of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(0).to_pylist()), "<f4").reshape(batch.num_rows, voters.width)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        f = voters.features(of(batch))
        return np.concatenate([[len(f)], f.sum(axis=0), (f * f).sum(axis=0)])

    rows = seen.select(seen.columns[column])
    total = _summed(rows, moments)
    d = voters.features(np.zeros((1, voters.width), np.float32)).shape[1]
    if total is None:
        return Classifier(np.zeros(d), np.ones(d), np.zeros(d + 1))
    mean = total[1 : d + 1] / total[0]
    scale = np.sqrt(np.maximum(0, total[d + 1 :] / total[0] - mean**2))
    out = Classifier(mean, np.where(scale < 1e-6, 1.0, scale), np.zeros(d + 1))
    ridge = np.append(np.full(d, penalty), 1e-6)

    def step(batch: pa.RecordBatch, now: Classifier) -> np.ndarray:
        x = of(batch)
        y, z = model.posterior(voters.votes(x).astype(float)), now.rows(voters.features(x))
        p = 1 / (1 + np.exp(-np.clip(z @ now.weight, -30, 30)))
        return np.concatenate([z.T @ (p - y), ((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z).ravel()])

    for _ in range(steps):
        sums = _summed(rows, lambda batch, now=out: step(batch, now))
        move = np.linalg.solve(sums[d + 1 :].reshape(d + 1, d + 1) + np.diag(ridge), sums[: d + 1] + ridge * out.weight)
        out = Classifier(out.mean, out.scale, out.weight - move * min(1.0, 5 / max(1e-9, np.abs(move).max())))
        if np.abs(move).max() < 1e-3:
            break
    return out


@dataclass
class Fitted:
    voters: Voters
    model: LabelModel
    classifier: Classifier
    seen: DataFrame


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000) -> Fitted:
    """labels: the rows that may be learned from. Null labels and ids, and ids that documents lack, are ignored; of several
    labels of an id the larger counts. seen: (id, x) of every row, stored."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    gold = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast(docs.schema[id_col].dataType).alias("id")).agg((F.max(label_col).cast("int") > 0).cast("int").alias("y"))
    gold = materialize(gold.join(own.select("id").distinct(), "id", "left_semi"), "gold")
    voters = mine_voters(own, gold, max_labelled)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = [voters.look(t or "").astype("<f4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], names=["id", "x"])

    seen = materialize(own.mapInArrow(look, f"id {docs.schema[id_col].dataType.simpleString()}, x binary"), "seen")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<f4").reshape(batch.num_rows, voters.width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in voters.votes(x).astype(np.uint8)], pa.binary())], names=["id", "votes"])

    voted = seen.mapInArrow(vote, f"id {docs.schema[id_col].dataType.simpleString()}, votes binary")
    patterns = materialize(voted.join(gold.withColumnRenamed("y", "gold"), "id", "left").groupBy("votes", "gold").agg(F.count("*").alias("times")), "patterns")
    model = fit_labels(patterns, voters.clean, voters.exclusive)
    return Fitted(voters, model, fit_classifier(seen, voters, model), seen)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """One row per input row: id_col, score (0 to 1), predicted (1 where the score is at least ``threshold``).

    Only the text decides. Null texts count as empty ones, which get a score like others; repeated rows are scored alike. Where
    labels are missing or of one class, the given voters alone are the evidence. An empty table gives an empty
    result. Other columns are ignored.
    """
    fitted = fit_toxicity(docs, labels, id_col, text_col, label_col, max_labelled)
    voters, classifier = fitted.voters, fitted.classifier  # a few KB, which travel with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), "<f4").reshape(part.num_rows, voters.width)
                score = classifier.score(voters.features(x))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return fitted.seen.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)
