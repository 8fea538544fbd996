"""N-gram Jaccard self-join: documents whose shingle sets overlap by a threshold, and their components.

1. Documents with the same shingle set form a class (by a 128-bit digest of the sorted shingle hashes); from here on
   only classes are compared. The same pass counts shingles in a sketch, whose size follows that of the texts.
2. The sketch gives a global order of shingles, rare first (any total order keeps the filters exact; the sketch makes
   it a good one). A class keeps its prefix: two sets that reach the threshold share a shingle in their prefixes.
3. Entries of prefixes meet by shingle, once: those that one class alone holds end there. The classes of a shared
   shingle are compared with its hub, the member with the fewest rarer shingles before it, which is linear in the
   entries. A shingle of which the sketch has counted ``HOT`` or more is dealt over tasks, whose hubs meet afterwards.
   Pairs pass a length, a positional and a suffix filter (an upper bound of the overlap from counts in cells); each that
   is left is verified once, on the texts. Verified links give components.
4. What is left are pairs of classes of different components under one prefix shingle. They are joined within ranges of
   lengths, large groups in parts, and pass the same filters and the same verification.
   A pair inside one component cannot change the components and is not compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import discard, materialize
from siftwell.llm.components import connected_components
from siftwell.llm.shingles import Shingler, shingle_set
from siftwell.llm.tokens import forget

SLICES, CELLS, HOT, PART = 64, 128, 4096, 2000
_ENTRY = "token long, c binary, n int, pos int, hub binary, hub_n int, hub_pos int, hot boolean"


def _texts(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return [t or b"" for t in batch.column(i).cast(pa.binary()).to_pylist()]


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _rank(count: int | np.ndarray) -> np.ndarray:
    """Counts on a scale of eighths of powers of two."""
    return np.minimum(255, 8 * np.log2(np.asarray(count, float) + 1)).astype(np.uint8)


def _first_pass(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Rows of two kinds: (id, sha, n, digest) of every document, and (slice, counts) of each task's sketch."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, sha binary, n int, digest binary, slice int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingler, sketch = Shingler(words), np.zeros(1 << bits, np.int64)
        low, id_type = np.uint64((1 << bits) - 1), None
        for batch in batches:
            texts, id_type = _texts(batch, 1), batch.column(0).type
            n, digests = [], []
            for _, seq in shingler.sequences(texts):
                tokens = np.unique(seq)
                np.add.at(sketch, (tokens & low).astype(np.int64), 1)
                n.append(len(tokens))
                digests.append(_digest(tokens))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=["id", "sha", "n", "digest", "slice", "counts"])
        if id_type is not None:
            packed = [zstandard.compress(s.tobytes(), 1) for s in sketch.reshape(SLICES, -1)]
            none = pa.nulls(SLICES)
            yield pa.RecordBatch.from_arrays([none.cast(id_type), none.cast(pa.binary()), none.cast(pa.int32()), none.cast(pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["id", "sha", "n", "digest", "slice", "counts"])

    return materialize(docs.mapInArrow(run, schema), "sets")


def _ranks(first: DataFrame, bits: int) -> np.ndarray:
    """Ranks of the sums of the tasks' sketches: a byte for each of 2 ** bits slots."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zstandard.decompress(packed.as_py()), np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_rank(s).tobytes() for s in sums.values()], pa.binary())], names=["slice", "ranks"])

    rows = first.filter("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(add, "slice int, ranks binary").collect()
    out = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.ravel()


def _prefixes(docs: DataFrame, ranks: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """(digest, n, tokens, hot, cells): the prefix of each class in order, which of it may be hot, and counts of its
    shingles in cells. A class comes once from each task that holds it, or a few times."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # 16 MB at most
    hot_rank = _rank(HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, rank_of = Shingler(words), set(), shared.value
        low = np.uint64(len(rank_of) - 1)
        for batch in batches:
            rows: list[tuple] = []
            for _, seq in shingler.sequences(_texts(batch, 0)):
                tokens = np.unique(seq)
                n = len(tokens)
                digest = _digest(tokens)
                if not n or digest in seen:  # copies that follow in this task
                    continue
                seen.add(digest)
                if len(seen) > 100_000:
                    seen.clear()
                p = n - -(-num * n // den) + 1
                rank = rank_of[(tokens & low).astype(np.int64)]
                order = np.lexsort((tokens, rank))[:p]
                cells = np.minimum(np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=CELLS), 65535).astype("<u2")
                rows.append((digest, n, tokens[order].view(np.int64), rank[order] >= hot_rank, cells.tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["digest", "n", "tokens", "hot", "cells"])

    return materialize(docs.select("text").mapInArrow(run, "digest binary, n int, tokens array<long>, hot array<boolean>, cells binary"), "prefixes")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by token, salt, pos and c -> those of tokens that several classes hold, with the first of the token
    as its hub. Of a salted token all are given, each with the first of its part. The last group of a batch may go on in
    the next: its first entry waits until a second one comes."""
    names = ["token", "salt", "c", "n", "pos"]
    schema = pa.schema([("token", pa.int64()), ("c", pa.binary()), ("n", pa.int32()), ("pos", pa.int32()), ("hub", pa.binary()), ("hub_n", pa.int32()), ("hub_pos", pa.int32()), ("hot", pa.bool_())])
    hub, waiting = None, False  # the first entry of the last group (one row), and whether it was not given yet
    for batch in batches:
        rows = pa.Table.from_batches([batch.select(names)])
        lead = 0 if hub is None else 1
        rows = (pa.concat_tables([hub, rows]) if lead else rows).combine_chunks()
        if not rows.num_rows:
            continue
        token, salt = rows.column("token").to_numpy(), rows.column("salt").to_numpy()
        c = rows.column("c").combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])))
        same = np.concatenate(([False], ~new[1:] & pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False))) if len(c) > 1 else np.zeros(1, bool)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        others = np.bincount(group[~new & ~same], minlength=len(first)) > 0
        give = np.where(new, others[group] | (salt > 0), ~same)
        if lead and not waiting:
            give[0] = False
        at = np.flatnonzero(give)
        heads = first[group[at]]
        out = rows.take(pa.array(at))
        top = rows.take(pa.array(heads))
        yield from pa.table([*(out.column(x) for x in ("token", "c", "n", "pos")), *(top.column(x) for x in ("c", "n", "pos")), pa.array(salt[at] > 0)], schema=schema).to_batches()
        last = int(first[-1])
        waiting = (waiting if last == 0 and lead else True) and not give[last]
        hub = rows.slice(last, 1)


def _needed(a: str, b: str, num: int, den: int) -> Column:
    """Least overlap of sets of these sizes that reach the threshold."""
    return F.ceil((F.col(a) + F.col(b)) * num / F.lit(float(num + den)))


def _may_link(na: str, pa_: str, nb: str, pb: str, num: int, den: int) -> Column:
    """Length filter, and positional filter for a shingle at positions pa_, pb: pairs that reach the threshold pass it
    at the first shingle that their prefixes share."""
    length = (F.least(na, nb) * den) >= (F.greatest(na, nb) * num)
    return length & (F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb)) >= _needed(na, nb, num, den))


def _bounded(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Suffix filter: of pairs (a, b, need) those whose counts in cells allow for the overlap that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, CELLS) for i in (3, 4))
            bound = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            full = ((a == 65535) | (b == 65535)).any(axis=1)
            yield batch.select([0, 1]).filter(pa.array(full | (bound >= batch.column(2).to_numpy())))

    used = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    cells = prefixes.select("digest", "cells").join(used, "digest", "left_semi").dropDuplicates(["digest"])
    both = pairs.join(cells.select(F.col("digest").alias("a"), F.col("cells").alias("ca")), "a").join(cells.select(F.col("digest").alias("b"), F.col("cells").alias("cb")), "b")
    return both.select("a", "b", "need", "ca", "cb").mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of classes those that reach the threshold, by their texts' shingles themselves. Only texts of these
    classes travel, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zstandard.compress(t, 3) for t in _texts(batch, 1)], pa.binary())], names=["digest", "packed"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, set()
        for batch in batches:
            keep = []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, right = b, shingle_set(zstandard.decompress(y.as_py()), words)
                left = shingle_set(zstandard.decompress(x.as_py()), words)
                both = len(left & right)
                keep.append(both > 0 and both * den >= num * (len(left) + len(right) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    used = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    wanted = classes.join(used, "digest", "left_semi").select("digest", F.col("rep.id").alias("rid"), F.col("rep.sha").alias("rsha"))
    bodies = rows.withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    texts = bodies.join(wanted, (F.col("sha") == F.col("rsha")) & F.col("id").eqNullSafe(F.col("rid"))).select("digest", "text")
    texts = materialize(texts.mapInArrow(pack, "digest binary, packed binary").dropDuplicates(["digest"]), "texts")
    left, right = (texts.select(F.col("digest").alias(x), F.col("packed").alias(f"t{x}")) for x in "ab")
    links = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(linked, "a binary, b binary"), "class-links")
    discard(texts)
    return links


def _components(links: DataFrame) -> DataFrame:
    """(c, component): classes by a class of their component, over links (a, b)."""
    nodes = materialize(links.select(F.explode(F.array("a", "b")).alias("c")).distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    a, b = (nodes.select(F.col("c").alias(x), F.col("node").alias(f"n{x}")) for x in "ab")
    roots = connected_components(links.join(a, "a").join(b, "b"), "na", "nb").withColumnRenamed("component", "root")
    names = nodes.select(F.col("node").alias("root"), F.col("c").alias("component"))
    return roots.join(nodes, "node").join(names, "root").select("c", "component")


def _across(named: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, need) of classes of different components under one shingle. Classes meet within neighbouring ranges
    of lengths, and the left side of a large group is dealt over parts, to each of which the right side goes."""
    open_ = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("token", "m")
    wide = math.log(den / num) * (1 + 1e-6) if num < den else 1e-6
    rows = named.join(open_, "token").withColumn("range", F.floor(F.log(F.col("n").cast("double")) / F.lit(wide))).withColumn("parts", F.ceil(F.col("m") / F.lit(float(PART))))
    rows = materialize(rows.select("token", "c", "n", "pos", "hub", "hot", "component", "range", "parts"), "open")
    cols = ("c", "n", "pos", "component", "hub")
    a = rows.select("token", "range", F.pmod(F.xxhash64("c"), "parts").alias("part"), "hot", *(F.col(x).alias(f"{x}_a") for x in cols))
    b = rows.select("token", F.explode(F.sequence(F.col("range") - 1, F.col("range") + 1)).alias("range"), "parts", *(F.col(x).alias(f"{x}_b") for x in cols))
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    new = F.col("hot") | ((F.col("c_a") != F.col("hub_a")) & (F.col("c_b") != F.col("hub_a")))  # others have met their hub already
    met = a.join(b, ["token", "range", "part"]).filter((F.col("c_a") < F.col("c_b")) & (F.col("component_a") != F.col("component_b")) & new & _may_link("n_a", "pos_a", "n_b", "pos_b", num, den))
    return met.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"), _needed("n_a", "n_b", num, den).alias("need")).distinct()


def sketch_size(n_bytes: int) -> int:
    """Bits of the slots of the sketch: one for each 256 bytes of text, 2 ** 16 to 2 ** 24 of them."""
    return min(24, max(16, (n_bytes // 256).bit_length()))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, sketch_bits: int | None) -> DataFrame:
    """(id, sha, n, digest, component_id, first) of every row; first: id and sha of the first row of its component, by
    smallest id, nulls last. Rows without shingles have only id, sha and n."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = sketch_bits or sketch_size(rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    first = _first_pass(rows, words, bits)
    members = materialize(first.filter("slice IS NULL").select("id", "sha", "n", "digest"), "members")
    ranks = _ranks(first, bits)
    discard(first)
    classes = materialize(members.filter("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "sha")).alias("rep")), "classes")
    prefixes = _prefixes(rows, ranks, words, num, den)

    entries = prefixes.select(F.col("digest").alias("c"), "n", F.posexplode(F.arrays_zip("tokens", "hot")).alias("pos", "x"))
    salt = F.when(F.col("x.hot"), 1 + F.pmod(F.xxhash64("c"), F.lit(64))).otherwise(0).cast("int")
    entries = entries.select(F.col("x.tokens").alias("token"), salt.alias("salt"), "c", "n", "pos")
    shared = materialize(entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "pos", "c").mapInArrow(_meet, _ENTRY), "shared")

    hot = shared.filter("hot")
    tops = hot.groupBy("token").agg(F.min(F.struct("hub_pos", "hub_n", "hub")).alias("top")).select("token", "top.*")
    met = shared.filter("NOT hot").select("c", "n", "pos", "hub", "hub_n", "hub_pos").unionByName(hot.drop("hub", "hub_n", "hub_pos").join(tops, "token").select("c", "n", "pos", "hub", "hub_n", "hub_pos"))
    met = met.filter(F.col("c") != F.col("hub")).filter(_may_link("n", "pos", "hub_n", "hub_pos", num, den))
    pairs = met.select(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b"), _needed("n", "hub_n", num, den).alias("need")).distinct()
    pairs = materialize(_bounded(materialize(pairs, "hub-pairs"), prefixes), "pairs")
    links = _verified(pairs, rows, classes, words, num, den)

    labels = _components(links)
    named = materialize(shared.drop("hub_n", "hub_pos").join(labels, "c", "left").withColumn("component", F.coalesce("component", "c")), "named")
    discard(shared)
    met = materialize(_across(named, num, den), "met")
    discard(named)
    pairs = materialize(_bounded(met, prefixes), "pairs")
    discard(prefixes)
    links = links.unionByName(_verified(pairs, rows, classes, words, num, den))

    grouped = classes.join(_components(links).withColumnRenamed("c", "digest"), "digest", "left").withColumn("root", F.coalesce("component", "digest"))
    firsts = grouped.groupBy("root").agg(F.min("rep").alias("first"))
    found = materialize(grouped.join(firsts, "root").select("digest", F.col("first.id").alias("component_id"), F.struct("first.id", "first.sha").alias("first")), "components")
    return members.filter("n > 0").join(found, "digest").unionByName(members.filter("n = 0"), allowMissingColumns=True)


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100, sketch_bits: int | None = None,
) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id that links reach), class_digest (binary).

    Two rows link when their sets of distinct shingles have a Jaccard similarity of num/den or more. A text of fewer
    words than a shingle has one shingle; null, empty and blank texts have none and link with nothing. Rows with equal
    sets link with each other. Repeated rows come back repeated. Null ids are ignored as smallest ids; a row with a
    null id that links with no other has a null component. An empty table gives an empty result. Other columns are
    ignored. sketch_bits: of the sketch that orders shingles, by default ``sketch_size`` of all texts; any size gives
    the same result.
    """
    rows = _grouped(docs, id_col, text_col, words, num, den, sketch_bits)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("digest").alias("class_digest"))


def keep_unlike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, sketch_bits: int | None = None) -> DataFrame:
    """The rows of docs of which no other like them stays, with all their columns: of each component of ``ngram_join`` the
    row with the smallest id (nulls last), and every row without shingles.

    Rows are told apart by id and text: an id that occurs with several texts is judged for each of them, and rows that
    repeat both id and text stay or go together. A row with a null id goes if its component has another id. An empty
    table gives an empty result. Columns may have any names.
    """
    rows = _grouped(docs, id_col, text_col, words, num, den, sketch_bits).filter("n > 0")
    gone = rows.filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("sha") == F.col("first.sha")))).select("id", "sha").distinct().alias("gone")
    text = F.unhex(F.sha2(F.coalesce(F.col(f"docs.`{text_col}`").cast("string"), F.lit("")), 256))
    return docs.alias("docs").join(gone, F.col(f"docs.`{id_col}`").eqNullSafe(F.col("gone.id")) & (text == F.col("gone.sha")), "left_anti")
