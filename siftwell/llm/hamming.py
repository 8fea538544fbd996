"""Exact top-k search over binary codes by incremental multi-index hashing.

Vectors become codes of their signs. Equal codes are one entry with its k smallest ids, so a code that a third of the
rows share is one entry too. Entries are dealt over index partitions of bounded size; each partition holds one table
for each of m segments of the code. Queries go to every partition in blocks. A query grows its search radius one
segment at a time: once segments 0..j have been searched to radius r and the others to r - 1, every code within
m * r + j has been met (pigeonhole), so the search ends when the kth verified distance is not above that. The nearest k
of all partitions are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import materialize


def sign_codes(rows: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    """(id, code): the number of elements in four bytes, then one bit for each element, set where it is positive. Null
    vectors and those with null elements, which have no code, are left out."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [None if v is None or None in v else len(v).to_bytes(4, "big") + np.packbits(np.asarray(v, float) > 0).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["id", "code"])

    return rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(run, f"id {kind}, code binary").filter("code IS NOT NULL")


class MultiIndex:
    """Segment tables over codes of one length, (n, bytes)."""

    def __init__(self, codes: np.ndarray, bits: int | None = None):
        self.codes = codes
        self.bits = 8 * codes.shape[1] if bits is None else bits
        width = max(1, min(16, int(np.log2(max(2, len(codes))))))
        self.m = max(1, -(-self.bits // width))
        flat = np.unpackbits(codes, axis=1)[:, : self.bits]
        edges = np.linspace(0, self.bits, self.m + 1).astype(int)
        self.parts = list(zip(edges[:-1], edges[1:], strict=True))
        self.tables = []
        for a, b in self.parts:
            value = self._value(flat[:, a:b])
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << int(b - a)) + 1))
            self.tables.append((order, starts))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _value(bits: np.ndarray) -> np.ndarray:
        return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1], dtype=np.int64)) if bits.shape[1] else np.zeros(len(bits), np.int64)

    def _ball(self, width: int, radius: int) -> np.ndarray:
        """All numbers of ``width`` bits with ``radius`` bits set."""
        if (width, radius) not in self.masks:
            self.masks[width, radius] = np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)
        return self.masks[width, radius]

    def nearest(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows within the distance of the kth nearest, all of them, and their distances; the radius that was covered."""
        n = len(self.codes)
        flat = np.unpackbits(code)[: self.bits]
        values = [int(self._value(flat[None, a:b])[0]) for a, b in self.parts]
        met = np.zeros(n, bool)
        rows, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        within = np.zeros(self.bits + 2, np.int64)
        count = 0
        for radius in range(self.bits + 1):
            for j, (a, b) in enumerate(self.parts):
                covered = self.m * radius + j
                if radius <= b - a:
                    order, starts = self.tables[j]
                    probes = values[j] ^ self._ball(int(b - a), radius)
                    lo, size = starts[probes], starts[probes + 1] - starts[probes]
                    hit = size > 0
                    lo, size = lo[hit], size[hit]
                    spots = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(lo) else lo
                    found = order[spots]
                    found = found[~met[found]]
                    if len(found):
                        met[found] = True
                        d = np.bitwise_count(self.codes[found] ^ code).sum(axis=1).astype(np.int64)
                        rows.append(found)
                        dist.append(d)
                        within += np.bincount(np.minimum(d, self.bits + 1), minlength=self.bits + 2)
                        count += len(found)
                # every code at a distance up to `covered` has been met
                if count == n or within[: covered + 1].sum() >= k:
                    r, d = np.concatenate(rows), np.concatenate(dist)
                    order_ = np.argsort(d, kind="stable")
                    kth = d[order_[min(k, len(d)) - 1]]
                    chosen = d <= kth
                    return r[chosen], d[chosen], covered
        raise AssertionError("unreachable: the last radius covers all codes")


def _searcher(shared, k: int):
    def search(group: pa.Table) -> pa.Table:
        by_size: dict[int, list[int]] = {}
        codes, ids = group.column("code").to_pylist(), group.column("ids").to_pylist()
        for r, c in enumerate(codes):
            by_size.setdefault(int.from_bytes(c[:4], "big"), []).append(r)
        out: list[tuple] = []
        for size, members in by_size.items():
            if not size:
                continue
            index = MultiIndex(np.frombuffer(b"".join(codes[r][4:] for r in members), np.uint8).reshape(len(members), -1), size)
            for q, code in zip(*shared.value, strict=True):
                if int.from_bytes(code[:4], "big") == size:
                    hits, dist, _ = index.nearest(np.frombuffer(code, np.uint8, offset=4), k)
                    best = sorted((int(d), x is None, x if x is not None else 0) for h, d in zip(hits, dist, strict=True) for x in ids[members[h]])
                    out += [(q, None if none else x, d) for d, none, x in best[:k]]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        kinds = (pa.int64(), group.schema.field("ids").type.value_type, pa.int32())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("q", "neighbor_id", "distance"), cols, kinds, strict=True)})

    return search


def top_k(
    rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", part_codes: int = 100_000, block: int = 20_000,
) -> DataFrame:
    """For each distinct query id and code the k rows nearest in Hamming distance: query_id, rank, neighbor_id, distance.

    Ties go to the smaller id (null ids come last). A row that is a query too is its own neighbour. Rows whose vectors
    are null, hold nulls or have another length than the query's take no part; repeated rows count as often as they
    occur, up to k. Empty tables give an empty result. part_codes bounds the codes of an index partition, block the
    queries that one pass broadcasts (a code and an id each).
    """
    coded = sign_codes(rows, vector_col, id_col)
    order = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    entries = coded.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= k).groupBy("code").agg(F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("z"), "id"))).alias("ids"))
    entries = materialize(entries.select("code", F.col("ids.id").alias("ids")), "codes")
    parts = max(1, -(-entries.count() // part_codes))
    index = materialize(entries.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts))), "index")
    asked = materialize(sign_codes(queries, vector_col, id_col).distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-asked.count() // block))
    kind = coded.schema["id"].dataType.simpleString()
    schema = f"q long, neighbor_id {kind}, distance int"
    sc = rows.sparkSession.sparkContext
    found = None
    for i in range(blocks):
        table = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).select("q", "code").toArrow()
        shared = sc.broadcast((table.column("q").to_pylist(), table.column("code").to_pylist()))

        got = index.groupBy("part").applyInArrow(_searcher(shared, k), schema)
        if blocks > 1:  # a block's results are stored, and its queries leave the executors
            got = materialize(got, "found")
            shared.destroy()
        found = got if found is None else found.unionByName(got)
    best = Window.partitionBy("q").orderBy("distance", F.col("neighbor_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "neighbor_id", "distance")
