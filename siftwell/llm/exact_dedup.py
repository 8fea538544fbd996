"""Exact deduplication through an extendible-hash index on shared files.

1. Every text gets its SHA-256; the leading bits are its key. A histogram of the
   distinct keys' prefixes (its size is bounded by ``max_bits``) drives the
   directory: buckets that would hold more than ``bucket_rows`` texts are split,
   doubling the directory whenever the local depth reaches the global depth.
2. Map tasks combine equal texts of a batch (a hot group shrinks to one entry per
   batch), look the bucket up in the directory and send the entry to its owner.
3. Each owner task streams whole buckets, which are key ranges, in key order.
   Entries of one key form a chain; bytes are compared with each link of the
   chain, so texts whose keys collide stay apart. The owner writes its buckets to
   the shared folder: one row for each distinct text, with the row that stays.
4. Documents look their digest up in the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import materialize
from siftwell.llm.tokens import forget

BUCKET, KEY, SHA, ROWS, TIES = "__bucket", "__key", "__sha", "__rows", "__ties"


@dataclass
class Directory:
    """Slots of the leading ``depth`` bits of a key, each pointing to a bucket with its own local depth."""

    depth: int = 0
    slots: list[int] = field(default_factory=lambda: [0])
    local: list[int] = field(default_factory=lambda: [0])

    @classmethod
    def build(cls, histogram: dict[int, int], bits: int, bucket_rows: int) -> Directory:
        """histogram: distinct keys by their leading ``bits`` bits. A bucket at full depth that is still overfull chains."""
        out, sizes = cls(), [sum(histogram.values())]
        total = [0] * ((1 << bits) + 1)
        for i in range(1 << bits):
            total[i + 1] = total[i] + histogram.get(i, 0)
        start, todo = [0], [0]
        while todo:
            b = todo.pop()
            if sizes[b] <= bucket_rows or out.local[b] == bits:
                continue
            if out.local[b] == out.depth:  # double: each slot becomes two
                out.slots = [x for x in out.slots for _ in (0, 1)]
                out.depth += 1
            out.local[b] += 1
            width = 1 << (bits - out.local[b])
            new, low = len(sizes), start[b]
            sizes[b] = total[low + width] - total[low]
            sizes.append(total[low + 2 * width] - total[low + width])
            start.append(low + width)
            out.local.append(out.local[b])
            step = bits - out.depth
            for s in range((low + width) >> step, (low + 2 * width) >> step):
                out.slots[s] = new
            todo += [b, new]
        return out

    def bucket(self, key: int) -> int:
        """key: 63 bits."""
        return self.slots[key >> (63 - self.depth)]


def _digest(text: bytes | None) -> str:
    return hashlib.sha256(text or b"").hexdigest()


def _key(sha: str, key_bits: int) -> int:
    """The leading bits of the digest as a number of 63 bits; a few key_bits make collisions, for tests."""
    return int(sha[:16], 16) >> (64 - key_bits) << (63 - key_bits) if key_bits < 63 else int(sha[:16], 16) >> 1


def _replaced(table: pa.RecordBatch | pa.Table, columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else table.column(f.name) for f in schema]
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return pa.RecordBatch.from_arrays([a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=schema)


def _later(a: object, b: object) -> bool:
    """Whether id a is larger than b; null is the smallest."""
    return a is not None and (b is None or a > b)


def build_index(
    docs: DataFrame, digests: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bucket_rows: int = 2048, max_bits: int = 20, key_bits: int = 63,
) -> DataFrame:
    """The index as a table in the shared folder: for each distinct text the whole row that stays (largest id),
    its bucket, key, digest, the number of rows with this text (``__rows``) and of those with this id too (``__ties``)."""
    n = digests.count()
    bits = min(max_bits, key_bits, max(4, (n // bucket_rows).bit_length() + 3))
    prefix = F.conv(F.substring(SHA, 1, 8), 16, 10).cast("long")
    grid = (F.shiftright(prefix, 32 - bits)).cast("int").alias("p")
    seen = digests.select(SHA).distinct().groupBy(grid).agg(F.count("*").alias("n"))  # at most 2**max_bits rows
    directory = Directory.build({r["p"]: r["n"] for r in seen.collect()}, bits, bucket_rows)

    extra = [T.StructField(BUCKET, T.IntegerType()), T.StructField(KEY, T.LongType()), T.StructField(SHA, T.StringType()), T.StructField(ROWS, T.LongType()), T.StructField(TIES, T.LongType())]
    schema = T.StructType([*docs.schema.fields, *extra])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()).to_pylist()
            heads: dict[str, list] = {}
            for i, text in enumerate(texts):
                head = heads.setdefault(sha := _digest(text), [i, 0, 0])
                if _later(ids[i], ids[head[0]]):
                    head[0], head[2] = i, 0
                head[1] += 1
                head[2] += ids[i] == ids[head[0]]
            kept = batch.take(pa.array([h[0] for h in heads.values()], pa.int64()))
            keys = [_key(s, key_bits) for s in heads]
            new = {BUCKET: [directory.bucket(k) for k in keys], KEY: keys, SHA: list(heads), ROWS: [h[1] for h in heads.values()], TIES: [h[2] for h in heads.values()]}
            out = pa.schema([*kept.schema, *(pa.field(k, pa.string() if k == SHA else pa.int32() if k == BUCKET else pa.int64()) for k in new)])
            yield _replaced(kept, new, out)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: list[list] = []  # of one key: [row, id, text, rows, ties]
        key = None

        def flush(done: list[list]) -> Iterator[pa.RecordBatch]:
            if done:
                rows = pa.Table.from_batches([h[0] for h in done])
                yield _replaced(rows, {ROWS: [h[3] for h in done], TIES: [h[4] for h in done]}, rows.schema)

        for batch in batches:
            at = {name: batch.column(batch.schema.get_field_index(name)) for name in (KEY, id_col, ROWS, TIES)}
            keys, ids, rows, ties = (at[name].to_pylist() for name in (KEY, id_col, ROWS, TIES))
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            done: list[list] = []
            for i, k in enumerate(keys):
                if k != key:
                    done, key, chain = done + chain if len(chain) > 1 else done, k, chain if len(chain) == 1 else []
                    if chain:
                        done.append(chain[0])
                        chain = []
                text = texts[i].as_py() or b""
                for head in chain:
                    if head[2] == text:
                        head[3] += rows[i]
                        if _later(ids[i], head[1]):
                            head[0], head[1], head[4] = batch.slice(i, 1), ids[i], ties[i]
                        elif ids[i] == head[1]:
                            head[4] += ties[i]
                        break
                else:
                    chain.append([batch.slice(i, 1), ids[i], text, rows[i], ties[i]])
            yield from flush(done)
        yield from flush(chain)

    owned = docs.mapInArrow(combine, schema).repartition(BUCKET).sortWithinPartitions(BUCKET, KEY).mapInArrow(own, schema)
    return materialize(owned, "dedup-index")


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return materialize(docs.select(F.col(id_col).alias("__id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(SHA)), "digests")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; texts are compared as they are, byte by byte. Of equal texts the row with the largest
    id stays; null ids are smaller than any other. Of rows that repeat both text and id exactly one is kept. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    digests = digest_table(docs, id_col, text_col)
    index = build_index(docs.select(id_col, text_col), digests, id_col, text_col, **options)
    found = digests.join(index.select(SHA, F.col(id_col).alias("__keep"), ROWS, TIES), SHA).withColumn("__top", F.col("__id").eqNullSafe(F.col("__keep")))
    tied = F.col("__top") & (F.col(TIES) > 1)
    once = found.filter(tied).withColumn("__first", F.row_number().over(Window.partitionBy(SHA).orderBy("__id")) == 1)
    out = found.filter(~tied).withColumn("__first", F.lit(True)).unionByName(once)
    return out.select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col(ROWS).alias("group_size"),
        (F.col("__top") & F.col("__first")).alias("kept"), F.col(SHA).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns: they are read from the index, which holds them.

    Null texts count as empty, and one row of all those without a text stays. Null ids are smaller than any other; of rows
    that repeat both text and id exactly one stays. An empty table gives an empty result. Columns may have any names.
    """
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    id_, text = (f"c{docs.columns.index(name)}" for name in (id_col, text_col))
    index = build_index(own, digest_table(own, id_, text), id_, text, **options)
    return index.select(*own.columns).toDF(*docs.columns)
