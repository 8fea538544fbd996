"""Best-fit packing of documents into training sequences, certified by lower bounds.

Documents are cut into pieces, and pieces are dealt over partitions of bounded size.
Each partition packs its pieces by best-fit decreasing and compares its number of
sequences with the best of several dual-feasible-function bounds. A partition that
meets its bound keeps its sequences but for the emptiest, which only rounds its
bound up. Partitions with a gap give the pieces of all sequences with room, the
others those of the emptiest one, to an exchange, where they are dealt anew and
packed again; a round counts only if it saves sequences. The rounds end when the
global bound is met or a round saves nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialize
from siftwell.llm.tokens import UnitEncoder, tokenizer_json


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that can hold ``counts[i]`` pieces of ``lengths[i]``: the best bound of three families of
    dual-feasible functions (identity, threshold, rounding), in whole numbers. At most ``capacity`` lengths."""
    if not len(lengths):
        return 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((lengths * counts).sum()) // capacity)
    for t in np.unique(np.concatenate([lengths[lengths <= capacity // 2], [0]])):
        # threshold: over capacity - t counts as a whole sequence, under t as nothing
        value = np.where(lengths > capacity - t, capacity, np.where(lengths >= t, lengths, 0))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 64):  # rounding: x if (k + 1) x is whole, else floor((k + 1) x) / k, in units of 1 / (k * capacity)
        scaled = (k + 1) * lengths
        value = np.where(scaled % capacity == 0, k * lengths, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """lengths, largest first -> sequence and offset of each, number of sequences. The fullest sequence with room gets
    the piece; sequences are found by their room through the lowest set bit of a mask."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made, where, offsets = 0, 0, [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            room = (fits & -fits).bit_length() - 1 + n
            bin_ = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, bin_ = capacity, made
            made += 1
        where.append(bin_)
        offsets.append(capacity - room)
        if left := room - n:
            rooms[left].append(bin_)
            mask |= 1 << left
    return where, offsets, made


def cut(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer_path: str | None, end_id: int) -> DataFrame:
    """id_col, piece, start, length, ids_crc32. Only documents of over ``capacity`` ids are cut; the first piece takes the rest."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path))
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what other operators have left in this Python process
        encoder = UnitEncoder.here(shared.value)
        for batch in batches:
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for i, ids in enumerate(encoder.ids_of(texts)):
                raw = memoryview(ids.tobytes() + end)
                n = len(raw) // 4
                at, piece = 0, 0
                while at < n:
                    stop = at + (n % capacity or capacity) if at == 0 else at + capacity
                    rows.append(i)
                    out.append((piece, at, stop - at, zlib.crc32(raw[at * 4 : stop * 4])))
                    at, piece = stop, piece + 1
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None,
    end_id: int = 0, part_rows: int = 50_000,
) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they occur. An empty table gives an
    empty result. Other columns are ignored. part_rows bounds the pieces that one task packs. Ids keep their type and
    value, nulls among them too; rows with null ids are packed like others.
    """
    pieces = materialize(cut(docs, id_col, text_col, capacity, tokenizer_path, end_id), "pieces")
    seen = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    bound = lower_bound(np.array([r["length"] for r in seen]), np.array([r["n"] for r in seen]), capacity)
    kind = pieces.schema["id"].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32"]
    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    schema = f"{columns}, sequence_id long, offset long, open boolean"

    def packer(round_: int):
        def one(key: tuple, group: pa.Table) -> pa.Table:
            group = group.select(names).sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            lengths = group.column("length").to_numpy()
            where, offsets, made = best_fit(lengths.tolist(), capacity)
            at = np.asarray(where)
            fill = np.bincount(at, weights=lengths, minlength=made)
            gap = made > lower_bound(*np.unique(lengths, return_counts=True), capacity)
            base = (round_ << 56) | (key[0].as_py() << 28)
            open_ = (fill[at] < capacity) & (gap | (at == fill.argmin()))
            return pa.table([*group.columns, pa.array(at + base), pa.array(offsets, pa.int64()), pa.array(open_)], names=[*names, "sequence_id", "offset", "open"])

        return one

    def packed(rows: DataFrame, n: int, round_: int) -> DataFrame:
        parts = max(1, -(-n // part_rows))
        part = F.pmod(F.xxhash64(F.lit(round_), "id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(parts)).alias("__part")
        return materialize(rows.select("*", part).groupBy("__part").applyInArrow(packer(round_), schema), f"packed-{round_}")

    done, now, round_ = None, packed(pieces, sum(r["n"] for r in seen), 0), 0
    total = now.agg(F.count_distinct("sequence_id")).first()[0]
    while total > bound:  # every round that counts saves a sequence at least
        old = now.filter("open")
        rows, bins = old.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if not rows:
            break
        round_ += 1
        new = packed(old.select(names), rows, round_)
        saved = bins - new.agg(F.count_distinct("sequence_id")).first()[0]
        if saved <= 0:
            break
        closed = now.filter(~F.col("open"))
        done, now, total = closed if done is None else done.unionByName(closed), new, total - saved
    out = now if done is None else done.unionByName(now)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
