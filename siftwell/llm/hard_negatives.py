"""Hard negatives by a Voronoi-partitioned distributed kNN join.

Vectors become integer vectors. With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q becomes
(q, 0); then |q - x|^2 = |q|^2 + M^2 - 2 <q, x>, so the nearest row has the largest inner product. Every row is assigned to
the nearest of some pivots. Anchors of neighbouring cells form groups of bounded size; for each group and cell the triangle
inequality gives the range of distances from the pivot in which a row can serve an anchor of the group, and a row goes to
those groups alone. What meets in a group is dealt over blocks of bounded size, joined exactly in each block, and the best of
all blocks are merged.

Two such joins are made: the nearest rows of the anchor's label are its positives; then rows of other labels are sought in
the window of scores that each positive leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import materialize

#: Products of integers are exact in floating point below this.
EXACT = float(2**53)


def integer_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """(id, label, x, tag): distinct rows; x is floor(scale * component) as int64 bytes, tag a hash of it. Rows with a null
    label, a null vector, or a null or non-finite component take no part."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id_col, label_col)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            flat, ends = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float), np.cumsum(np.asarray(vectors.value_lengths().fill_null(0)))
            good, out = np.isfinite(flat), []
            for a, b, missing in zip(np.concatenate([[0], ends[:-1]]), ends, vectors.is_null().to_pylist(), strict=True):
                out.append(None if missing or not good[a:b].all() else np.floor(scale * flat[a:b]))
            if any(v is not None and len(v) and np.abs(v).max() > 2.0**31 for v in out):
                raise ValueError(f"components beyond {2.0**31 / scale} have no exact products")
            packed = pa.array([None if v is None else v.astype("<i8").tobytes() for v in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["id", "label", "x"])

    chosen = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).filter("label IS NOT NULL AND v IS NOT NULL")
    found = chosen.mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label_col]}, x binary").filter("x IS NOT NULL")
    return found.distinct().withColumn("tag", F.xxhash64("x"))


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "<i8").reshape(len(packed), -1) if packed and packed[0] else np.zeros((len(packed), 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a with all rows of b."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if top < 2.0**63:
        return a @ b.T
    raise ValueError("an inner product may not fit in 64 bits")


def _assign(rows: DataFrame, pivots: np.ndarray, norm: float, lifted: bool) -> DataFrame:
    """Each row with the nearest pivot (cell) and its distance (far). lifted: rows get the extra component, anchors don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("x")).to_pylist()).astype(float)
            extra = np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1))) if lifted else np.zeros(len(x))
            y = np.column_stack([x, extra])
            d = np.sqrt(np.maximum(0.0, (y * y).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * y @ pivots.T))
            cell = d.argmin(axis=1) if len(x) else np.zeros(0, int)
            own = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell], pa.float64())], names=[*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, far double")


def _routes(cells: DataFrame, gaps: DataFrame, slack: float, by: list[str]) -> DataFrame:
    """cells: (cell, team, *by, reach, near, far) of the anchors of a cell: they need rows from ``near`` to ``reach`` away.
    The range of distances from its pivot in which a row of a cell can serve a team: (row_cell, team, *by, lo, hi)."""
    both = cells.join(gaps, "cell")
    lo = F.greatest(F.col("gap") - F.col("far") - F.col("reach"), F.col("near") - F.col("gap") - F.col("far")) - slack
    hi = F.col("gap") + F.col("far") + F.col("reach") + slack
    return both.groupBy("row_cell", "team", *by).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))


def _block(shared: dict, kind: str, k: int):
    """Joins a block of rows with its anchors exactly. positives: for each anchor the k best other rows of its label, among
    rows of the same label. negatives: for each (anchor, positive) the k best rows of another label in its window."""

    def join(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor": [], "place": [], "row_id": [], "tag": [], "score": []}
        if anchors.num_rows and rows.num_rows:
            ids = rows.column("id")
            order = pa.compute.sort_indices(pa.table({"id": ids, "tag": rows.column("tag"), "none": ids.is_null()}), [("none", "ascending"), ("id", "ascending"), ("tag", "ascending")])
            rows = rows.take(order)
            x, ids, tags, labels = _matrix(rows.column("x").to_pylist()), rows.column("id").to_pylist(), np.array(rows.column("tag")), rows.column("label").to_pylist()
            names = {v: i for i, v in enumerate(dict.fromkeys(labels))}
            codes = np.array([names[v] for v in labels])
            q, step = _matrix(anchors.column("x").to_pylist()), max(1, shared["cells"] // max(1, len(x)))
            a_id, a_tag, a_label, a_key = (anchors.column(c).to_pylist() for c in ("id", "tag", "label", "anchor"))
            windows = anchors.column("windows").to_pylist() if kind == "negatives" else None
            for at in range(0, len(q), step):
                scores = _products(q[at : at + step], x)
                for i, s in enumerate(scores, at):
                    if kind == "positives":
                        keep = ~((tags == a_tag[i]) & np.array([v == a_id[i] for v in ids])) if a_tag[i] in shared_tags(tags) else np.ones(len(s), bool)
                        asked = [(0, None, None)]
                    else:
                        asked = [(w["place"], w["lo"], w["hi"]) for w in windows[i]]
                        keep = (codes != names.get(a_label[i], -1)) & (s >= min(w[1] for w in asked)) & (s <= max(w[2] for w in asked))
                    spots = np.flatnonzero(keep)
                    if kind == "positives" and len(spots) > 8 * k:
                        spots = spots[s[spots] >= np.partition(s[spots], len(spots) - k)[len(spots) - k]]
                    spots = spots[np.argsort(-s[spots], kind="stable")]
                    falling = -s[spots]
                    for place, lo, hi in asked:
                        best = spots[:k] if hi is None else spots[(first := np.searchsorted(falling, -hi)) : first + k]
                        for j in best if lo is None else best[s[best] >= lo]:
                            for name, v in zip(out, (a_key[i], place, ids[j], int(tags[j]), int(s[j])), strict=True):
                                out[name].append(v)
        types = {"anchor": pa.int64(), "place": pa.int32(), "row_id": rows.schema.field("id").type, "tag": pa.int64(), "score": pa.int64()}
        return pa.table({n: pa.array(v, types[n]) for n, v in out.items()})

    def shared_tags(tags: np.ndarray) -> set:
        if shared.get("of") is not tags:
            shared["of"], shared["tags"] = tags, set(tags.tolist())
        return shared["tags"]

    return join


def _meet(rows: DataFrame, anchors: DataFrame, routes: DataFrame, by: list[str], kind: str, k: int, block: int) -> DataFrame:
    """Sends rows along the routes and joins them block by block: (anchor, place, row_id, tag, score)."""
    sent = rows.withColumnRenamed("cell", "row_cell").join(routes, ["row_cell", *by]).filter("far >= lo AND far <= hi")
    sent = materialize(sent.select("id", "label", "x", "tag", "team"), "routed")
    keys = ["team", *by]
    parts = sent.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = sent.join(F.broadcast(parts) if not by else parts, keys).withColumn("part", F.pmod(F.xxhash64("id", "tag"), F.col("parts")).cast("int"))
    asking = anchors.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["anchor", "id", "label", "x", "tag", "team", "part", *(["windows"] if kind == "negatives" else [])]
    kind_of_id = rows.schema["id"].dataType.simpleString()
    got = asking.select(*columns).groupBy(*keys, "part").cogroup(dealt.select("id", "label", "x", "tag", "team", "part").groupBy(*keys, "part"))
    return got.applyInArrow(_block({"cells": 4_000_000}, kind, k), f"anchor long, place int, row_id {kind_of_id}, tag long, score long")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("row_id").asc_nulls_last(), "tag")
    return found.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    pivots: int = 64, team_size: int = 4096, block: int = 20_000,
) -> DataFrame:
    """For each anchor and positive the hardest rows of other labels: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    The score is the integer inner product of floor(scale * component); ties go to the smaller id, null ids last. is_anchor
    is a condition on the column ``id``. The positives of an anchor are its best other rows of the same label. Negatives
    satisfy low * positive_score <= 100 * negative_score <= high * positive_score. Rows with a null label or vector, or with
    a null or non-finite component, take no part; rows with a null id do, but are no anchors unless is_anchor says so. Rows
    equal in id, label and vector count once; rows that share only the id are different ones. Only vectors of as many
    components meet; empty ones have product 0. Components whose floor is beyond 2 ** 31 raise an error, as do
    products that might not fit in 64 bits. An empty table, and one without anchors, gives an empty result. Other columns
    are ignored.

    pivots: rows with the smallest hashes, so many at most for each length of vectors. team_size bounds the anchors and
    block the rows that one task holds (up to what hashes deal unevenly, or a label's anchors in one cell beyond it).
    """
    ints = materialize(integer_rows(rows, id_col, vector_col, label_col, scale), "vectors")
    sizes = [r["n"] for r in ints.select((F.length("x") / 8).cast("int").alias("n")).distinct().limit(1001).collect()]
    if len(sizes) > 1000:
        raise ValueError("vectors have more than 1000 different lengths")
    parts = [_of_one_size(ints.filter(F.length("x") == 8 * n), is_anchor, positives, negatives, low, high, pivots, team_size, block) for n in sorted(sizes)]
    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long")
    for part in parts:
        if part is not None:
            out = out.unionByName(part)
    return out


def _of_one_size(ints: DataFrame, is_anchor, positives: int, negatives: int, low: int, high: int, pivots: int, team_size: int, block: int) -> DataFrame | None:
    spark = ints.sparkSession
    largest = ints.mapInArrow(_norms, "n double").agg(F.max("n")).first()[0]
    if largest is None:
        return None
    chosen = ints.dropDuplicates(["x"]).orderBy(F.xxhash64("tag"), "x").limit(pivots).select("x").collect()
    base = _matrix([bytes(r["x"]) for r in chosen]).astype(float)
    lifted = np.column_stack([base, np.sqrt(np.maximum(0.0, largest**2 - (base * base).sum(axis=1)))])
    gap = np.sqrt(np.maximum(0.0, ((lifted[:, None] - lifted[None]) ** 2).sum(axis=2)))
    slack = 1e-6 * (1 + largest)
    gaps = spark.createDataFrame([(i, j, float(gap[i, j])) for i in range(len(gap)) for j in range(len(gap))], "cell int, row_cell int, gap double")
    placed = materialize(_assign(ints, lifted, largest, True), "placed")
    anchors = materialize(_assign(ints.filter(is_anchor), lifted, largest, False).withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    # neighbouring cells are put together until a team is full: one row for each pivot on the driver
    counts = {r["cell"]: r["n"] for r in anchors.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    teams, left, team, held = {}, set(counts), 0, 0
    at = min(left)
    while left:
        left.discard(at)
        if held and held + counts[at] > team_size:
            team, held = team + 1, 0
        teams[at], held = (team, max(1, -(-counts[at] // team_size))), held + counts[at]
        team += teams[at][1] - 1
        at = min(left, key=lambda c: gap[at, c]) if left else at
    teamed = spark.createDataFrame([(c, t, n) for c, (t, n) in teams.items()], "cell int, first int, of int")
    anchors = anchors.join(teamed, "cell").withColumn("team", (F.col("first") + F.pmod(F.xxhash64("id", "tag"), F.col("of"))).cast("int")).drop("first", "of")

    # how far an anchor of a cell must look for enough rows of its label: over the rows nearest to each pivot
    order = Window.partitionBy("cell", "label").orderBy("far", "tag")
    nearest = placed.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= positives + 1).select(F.col("cell").alias("row_cell"), "label", F.col("far").alias("row_far"))
    of_cells = anchors.groupBy("cell", "team", "label").agg(F.max("far").alias("far"))
    bounds = of_cells.join(nearest, "label").join(gaps, ["cell", "row_cell"]).withColumn("bound", F.col("far") + F.col("gap") + F.col("row_far"))
    order = Window.partitionBy("cell", "team", "label").orderBy("bound")
    enough = bounds.withColumn("no", F.row_number().over(order)).filter(F.col("no") == positives + 1).select("cell", "team", "label", F.col("bound").alias("reach"))
    need = of_cells.join(enough, ["cell", "team", "label"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf")))).withColumn("near", F.lit(0.0))
    met = _meet(placed, anchors, _routes(need, gaps, slack, ["label"]), ["label"], "positives", positives, block)
    best = materialize(_first(met, ["anchor"], positives).select("anchor", F.col("no").alias("place"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # the window of each positive, in scores and in distances: |q - x|^2 = |q|^2 + M^2 - 2 <q, x>
    exact = F.col("positive_score").cast("decimal(20,0)")
    window = best.withColumn("lo", F.ceil(exact * low / 100).cast("long")).withColumn("hi", F.floor(exact * high / 100).cast("long")).filter("lo <= hi")
    windows = window.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "lo", "hi"))).alias("windows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))  # one entry for each positive
    square = F.col("own") + F.lit(largest**2)
    hunting = anchors.join(windows, "anchor").join(anchors.select("anchor", "x").mapInArrow(_squares, "anchor long, own double"), "anchor")
    hunting = hunting.withColumn("reach", F.sqrt(F.greatest(F.lit(0.0), square - 2 * F.col("lo")))).withColumn("near", F.sqrt(F.greatest(F.lit(0.0), square - 2 * F.col("hi")))).drop("lo", "hi")
    hunting = materialize(hunting, "hunting")
    need = hunting.groupBy("cell", "team").agg(F.max("far").alias("far"), F.max("reach").alias("reach"), F.min("near").alias("near"))
    met = _meet(placed, hunting, _routes(need, gaps, slack, []), [], "negatives", negatives, block)
    mined = _first(met, ["anchor", "place"], negatives).select("anchor", "place", F.col("no").alias("rank"), F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return mined.join(best, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(batch.schema.get_field_index("x")).to_pylist()).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1).max()))] if len(x) else [], pa.float64())], names=["n"])


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(1).to_pylist()).astype(float)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x * x).sum(axis=1), pa.float64())], names=["anchor", "own"])
