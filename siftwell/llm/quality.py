"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

Both views are logistic models: the text view sees what is written (bytes, words, signs), the metadata view where it
stands (language, source, size, layout of lines). In each round all documents outside the labelled sample are scored in one
distributed pass: those that a view is sure of are pseudo-labelled for the other view, which learns them as sums of
gradients and Hessians that the tasks make at its current weights. How sure a view must be of a class is read off a
labelled fold held back for that: the smallest bound beyond which its marks are right; where there is none it marks nothing
of that class. Rounds end when nothing is marked or the marks repeat. In the end both views are calibrated on this fold,
and a logistic model of the two combines them on another one, which sets the threshold too.

Only the labelled rows are a sample, of at most ``max_labelled`` ids chosen by a hash; pseudo-labels and scores cover every
document and its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.shingles import Shingler
from siftwell.llm.tokens import forget

_LETTER, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + list(range(128, 256))] = True
_UPPER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_SIGN = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in ".,;:'\"-?()" for i in range(256)])
LANGS, SOURCES, WORDS, GRAMS = 16, 64, 128, 128
SHAPE, LAYOUT = 9, 12
TEXT_SIZE, META_SIZE = 192 + SHAPE + WORDS + GRAMS, LANGS + SOURCES + 2 * LAYOUT
SLICES, CHUNK = 32, 2048


def text_features(text: bytes, words: np.ndarray, own: list[bytes], lines: list[bytes]) -> np.ndarray:
    """Byte frequencies; how letters, signs and repetitions are shared out; hashed words (given as hashes) and runs of three
    bytes. own, lines: the words and the lines that are not blank."""
    out = np.zeros(TEXT_SIZE, np.float32)
    if not text:
        out[192 + SHAPE - 1] = 1
        return out
    b = np.frombuffer(text, np.uint8)
    counts = np.bincount(b, minlength=256)
    out[:128] = np.sqrt(counts[:128] / len(b))
    out[128:192] = np.sqrt((counts[128:192] + counts[192:256]) / len(b))
    n = max(1, len(own))
    letters = max(1, int(counts[_LETTER].sum()))
    ends = np.frombuffer(b"".join(w[-1:] for w in own), np.uint8)
    starts = np.frombuffer(b"".join(w[:1] for w in own), np.uint8)
    out[192 : 192 + SHAPE - 1] = [
        counts[_UPPER].sum() / letters, counts[_SIGN].sum() / len(b), letters / len(b), len(set(own)) / n, len(set(lines)) / max(1, len(lines)),
        _SIGN[ends].mean() if len(ends) else 0, (~_LETTER[starts]).mean() if len(starts) else 0, (b[1:] == b[:-1]).mean() if len(b) > 1 else 0,
    ]
    out[192 + SHAPE : 192 + SHAPE + WORDS] = np.sqrt(np.bincount(words.view(np.int64) & (WORDS - 1), minlength=WORDS) / n)
    wide = b.astype(np.uint32)
    grams = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(25)
    out[192 + SHAPE + WORDS :] = np.sqrt(np.bincount(grams, minlength=GRAMS) / len(b))
    return out


def meta_features(lang: str | None, source: str | None, text: bytes, own: list[bytes], lines: list[bytes]) -> np.ndarray:
    """Language and source; size and layout with their squares: bytes, words, lines, bytes a word, words a line, bytes a
    character, blank lines, the longest line and word, how words and lines differ in length, words of over 20 bytes."""
    out = np.zeros(META_SIZE, np.float32)
    out[zlib.crc32((lang or "?").encode()) % LANGS] = 1
    out[LANGS + zlib.crc32((source or "?").encode()) % SOURCES] = 1
    if text:
        of_words, of_lines = (np.fromiter(map(len, x), np.float64, len(x)) if x else np.zeros(1) for x in (own, lines))
        breaks = text.count(b"\n") + 1
        begun = int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
        layout = [
            np.log1p(len(text)), np.log1p(len(own)), np.log1p(breaks), np.log1p(len(text) / max(1, len(own))), np.log1p(len(own) / breaks), len(text) / max(1, begun),
            1 - len(lines) / breaks, np.log1p(of_lines.max()), np.log1p(of_words.max()), np.log1p(of_words.std()), np.log1p(of_lines.std()), (of_words > 20).mean(),
        ]
        out[LANGS + SOURCES :] = [*layout, *np.square(layout)]
    return out


def features(texts: list[bytes], langs: list[str | None], sources: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Both views of some documents."""
    hashes, first = Shingler(1).words_of(texts) if texts else (np.zeros(0, np.uint64), np.zeros(1, int))
    text, meta = np.zeros((len(texts), TEXT_SIZE), np.float32), np.zeros((len(texts), META_SIZE), np.float32)
    for i, (t, lang, source) in enumerate(zip(texts, langs, sources, strict=True)):
        own, lines = t.split(), [x for x in t.split(b"\n") if x.strip()]
        text[i] = text_features(t, hashes[first[i] : first[i + 1]], own, lines)
        meta[i] = meta_features(lang, source, t, own, lines)
    return text, meta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """weight: of the standardised features, and last the bias."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient and Hessian of the loss over these rows at the current weights, end to end."""
        d = len(self.weight)
        grad, hess = np.zeros(d), np.zeros((d, d))
        for at in range(0, len(x), CHUNK):
            z = self._rows(x[at : at + CHUNK])
            p = _sigmoid(z @ self.weight)
            grad += z.T @ (p - y[at : at + CHUNK])
            hess += (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z
        return np.concatenate([grad, hess.ravel()])

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 20, start: Logistic | None = None, learned: np.ndarray | None = None) -> Logistic:
        """Newton steps on the penalised likelihood of the rows and of what ``sums`` gave for others at ``start``."""
        if start is None:
            mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
            start = cls(mean, np.where(scale < 1e-9, 1.0, scale), np.zeros(x.shape[1] + 1))
        d = len(start.weight)
        out, ridge = cls(start.mean, start.scale, start.weight.copy()), np.full(d, penalty)
        ridge[-1] = 1e-6
        for _ in range(steps):
            sums = out.sums(x, y)
            grad, hess = sums[:d] + ridge * out.weight, sums[d:].reshape(d, d) + np.diag(ridge)
            if learned is not None:
                more = learned[d:].reshape(d, d)
                grad, hess = grad + learned[:d] + more @ (out.weight - start.weight), hess + more
            step = np.linalg.solve(hess, grad)
            out.weight -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-3:
                break
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._rows(x) @ self.weight, -20, 20)


@dataclass
class CoTrained:
    """The two views with their calibrations, the combination and the threshold. prior: where labels have one class."""

    text: Logistic | None = None
    meta: Logistic | None = None
    text_map: Logistic | None = None
    meta_map: Logistic | None = None
    both: Logistic | None = None
    threshold: float = 0.5
    prior: float = 1.0
    exchanged: list[dict[str, int]] = field(default_factory=list)  # of each round: learner and label -> rows marked for it

    def score(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: text view, metadata view, both."""
        if self.text is None:
            flat = np.full(len(x_text), self.prior)
            return flat, flat, flat
        a, b = self.text_map.logit(self.text.logit(x_text)[:, None]), self.meta_map.logit(self.meta.logit(x_meta)[:, None])
        return tuple(_sigmoid(z) for z in (a, b, self.both.logit(np.column_stack([a, b]))))

    def kept(self, score: np.ndarray) -> np.ndarray:
        return score >= self.threshold if self.text else np.ones(len(score), bool)


def sure_from(conf: np.ndarray, right: np.ndarray, wanted: float, least: int) -> float | None:
    """The smallest bound of at least 0.5 for which ``wanted`` of the rows at or above it are right, and ``least`` rows are there."""
    order = np.argsort(-conf, kind="stable")
    conf, hits = conf[order], np.cumsum(right[order])
    n = np.arange(1, len(conf) + 1)
    last = np.append(conf[1:] != conf[:-1], True) if len(conf) else np.zeros(0, bool)  # rows of equal confidence come together
    fits = np.flatnonzero(last & (hits >= wanted * n) & (n >= least) & (conf >= 0.5))
    return float(conf[fits[-1]]) if len(fits) else None


def pseudo_sums(models: dict[str, Logistic], bounds: dict[tuple[str, int], float], x: dict[str, np.ndarray]) -> dict[tuple[str, int], tuple[int, np.ndarray]]:
    """(view that learns, label) -> number of rows that the other view is sure of, and their sums. bounds: (view that marks,
    label) -> how sure it must be. Rows that the views are sure of in different ways are marked for neither."""
    sure = {}
    for view in ("text", "meta"):
        p = _sigmoid(models[view].logit(x[view]))
        for label, conf in ((1, p), (0, 1 - p)):
            sure[view, label] = (conf >= bounds[view, label]) & (conf >= 0.5) if (view, label) in bounds else np.zeros(len(p), bool)
    out = {}
    for view, other in (("text", "meta"), ("meta", "text")):
        for label in (1, 0):
            if len(rows := np.flatnonzero(sure[view, label] & ~sure[other, 1 - label])):
                out[other, label] = (len(rows), models[other].sums(x[other][rows], np.full(len(rows), float(label))))
    return out


def co_train(x: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray, mark, rounds: int = 2, share: float = 1.0, right: float = 0.95, least: int = 5) -> CoTrained:
    """x: both views of the labelled rows. fold: 0 learns, 1 gates and calibrates, 2 combines. mark(models, bounds) gives
    ``pseudo_sums`` over all other rows. Pseudo-labels that a view learns weigh ``share`` of its labelled rows at
    most, in each class alike: they keep the classes' ratio, so marks of one class alone teach nothing. right, least: those
    of ``sure_from`` on fold 1."""
    train, gate, join = (fold == i for i in range(3))
    if min(min(y[f].sum(), (1 - y[f]).sum()) for f in (train, gate, join)) < 2:
        return CoTrained(prior=float(y.mean()) if len(y) else 1.0)
    models = {view: Logistic.fit(x[view][train], y[train]) for view in x}
    exchanged = []
    for _ in range(rounds):
        bounds = {}
        for view in x:
            held = _sigmoid(models[view].logit(x[view][gate]))
            for label, conf in ((1, held), (0, 1 - held)):
                if (bound := sure_from(conf, y[gate] == label, right, least)) is not None:
                    bounds[view, label] = bound
        if not bounds or not (marks := mark(models, bounds)):
            break
        exchanged.append({f"{view} {label}": n for (view, label), (n, _) in sorted(marks.items())})
        if exchanged[-2:-1] == exchanged[-1:]:
            break
        for view in x:
            labelled = {label: (y[train] == label).sum() for label in (0, 1)}
            part = min(share, *(marks[view, label][0] / labelled[label] if (view, label) in marks else 0.0 for label in (0, 1)))
            if part:
                learned = sum(marks[view, label][1] * (part * labelled[label] / marks[view, label][0]) for label in (0, 1))
                models[view] = Logistic.fit(x[view][train], y[train], start=models[view], learned=learned)
    out = CoTrained(models["text"], models["meta"], exchanged=exchanged)
    out.text_map, out.meta_map = (Logistic.fit(models[v].logit(x[v][gate])[:, None], y[gate], 1e-2) for v in ("text", "meta"))
    maps = np.column_stack([m.logit(models[v].logit(x[v][join])[:, None]) for v, m in (("text", out.text_map), ("meta", out.meta_map))])
    out.both = Logistic.fit(maps, y[join], 1e-2)
    scores = out.score(x["text"][join], x["meta"][join])[2]
    out.threshold = float(min(0.5, np.quantile(scores[y[join] == 1], 0.002)))
    return out


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> list:
    """The columns that the views read, under their own names; metadata columns may be missing or of another type."""
    def get(name: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast("string")

    return [F.col(id_col).cast("string").alias("id"), get(text_col).alias("text"), get("lang").alias("lang"), get("source").alias("source")]


def _parts(batch: pa.RecordBatch, text: pa.Array, lang: str = "lang", source: str = "source") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A batch in parts, with both views of each."""
    text = text.cast(pa.binary())
    for at in range(0, batch.num_rows, 1000):
        part = batch.slice(at, 1000)
        columns = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (lang, source))
        yield part, *features([t or b"" for t in text.slice(at, 1000).to_pylist()], *columns)


def _marker(rows: DataFrame):
    """mark() for ``co_train`` over rows (id, text, lang, source): one pass, whose tasks each give their sums once."""

    def mark(models: dict[str, Logistic], bounds: dict[tuple[str, int], float]) -> dict[tuple[str, int], tuple[int, np.ndarray]]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forget()
            total: dict[tuple[str, int], tuple[int, np.ndarray]] = {}
            for batch in batches:
                for _, text, meta in _parts(batch, batch.column(1)):
                    for key, (n, s) in pseudo_sums(models, bounds, {"text": text, "meta": meta}).items():
                        m, t = total.get(key, (0, 0.0))
                        total[key] = (m + n, t + s)
            out = [(*key, i, n, piece.tobytes()) for key, (n, s) in total.items() for i, piece in enumerate(np.array_split(s, SLICES))]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["view", "label", "slice", "n", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for *key, n, s in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    m, t = total.get(tuple(key), (0, 0.0))
                    total[tuple(key)] = (m + n, t + np.frombuffer(s))
            cols = list(zip(*((*key, n, s.tobytes()) for key, (n, s) in total.items()), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["view", "label", "slice", "n", "sums"])

        schema = "view string, label int, slice int, n long, sums binary"
        found = rows.mapInArrow(sums, schema).repartition("view", "label", "slice").mapInArrow(add, schema).collect()  # 4 * SLICES rows at most
        out = {}
        for key in {(r["view"], r["label"]) for r in found}:
            mine = sorted((r for r in found if (r["view"], r["label"]) == key), key=lambda r: r["slice"])
            out[key] = (mine[0]["n"], np.concatenate([np.frombuffer(r["sums"]) for r in mine]))
        return out

    return mark


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = 20_000, **options: float) -> CoTrained:
    """Labels of ids that documents lack, and null labels, are ignored; of several labels of an id the larger counts, and of
    several rows of an id the one whose text is the smallest. options: those of ``co_train``."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = docs.select(F.col(id_col).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    chosen = ids.join(known, "id").orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # max_labelled ids at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part, text, meta in _parts(batch, batch.column(2)):
                x = np.concatenate([text, meta], axis=1).astype("<f4")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    rows = docs.select(*_inputs(docs, id_col, text_col))
    sample = rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct("text", "lang", "source")).alias("row")).select("id", "y", "row.*")
    found = sample.mapInArrow(extract, "id string, y int, x binary").toArrow()
    found = found.take(pa.compute.sort_indices(found, [("id", "ascending")]))
    x = np.frombuffer(b"".join(v.as_py() for c in found.column("x").chunks for v in c), "<f4").reshape(found.num_rows, TEXT_SIZE + META_SIZE)
    y = (np.array(found.column("y").to_pylist(), float) > 0).astype(float)
    fold = np.array([{0: 1, 4: 2}.get(zlib.crc32(i.encode()) % 8, 0) for i in found.column("id").to_pylist()], int)
    del found
    others = rows.join(F.broadcast(chosen.select("id")), "id", "left_anti")
    return co_train({"text": x[:, :TEXT_SIZE], "meta": x[:, TEXT_SIZE:]}, y, fold, _marker(others), **options)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row per input row: id_col, text_score, meta_score, score (probabilities of good quality), kept.

    Rows below the threshold are not kept: 0.5, or lower where more than 0.2 % of the good documents held back would go.
    Nulls count as empty texts or unknown metadata, which may have any type. Where labels lack a class every document gets
    their mean and is kept. Repeated rows are scored alike. An empty table gives an empty result. Other columns are ignored.
    """
    model = fit_quality(docs, labels, id_col, text_col, **options)  # a few KB, which travel with the tasks
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x_text, x_meta in _parts(batch, batch.column(1)):
                text, meta, both = model.score(x_text, x_meta)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v) for v in (text, meta, both, model.kept(both)))], names=["id", "text_score", "meta_score", "score", "kept"])

    rows = docs.select(F.col(id_col).alias("id"), *_inputs(docs, id_col, text_col)[1:])
    return rows.mapInArrow(run, f"id {kind}, text_score double, meta_score double, score double, kept boolean").withColumnRenamed("id", id_col)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The rows that ``score_quality`` keeps, with all their columns, which may have any names and types."""
    model = fit_quality(docs, labels, id_col, text_col, **options)  # a few KB, which travel with the tasks
    inside = isinstance(docs.schema[text_col].dataType, T.StringType)  # then the text is read from the row and doesn't travel twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            text = batch.column(0).field(text_col) if inside else batch.column(3)
            for part, x_text, x_meta in _parts(batch, text):
                yield part.select([0]).filter(pa.array(model.kept(model.score(x_text, x_meta)[2])))

    _, text, lang, source = _inputs(docs, id_col, text_col)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, lang, source, *([] if inside else [text]))
    return rows.mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")
