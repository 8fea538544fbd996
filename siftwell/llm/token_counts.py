"""Token counts through a cache of digests.

The cache is a table in a shared folder: SHA-256 of the content, SHA-256 of the
tokenizer's definition, number of tokens. Documents are joined to it; only distinct
contents that it lacks are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import materialize, table_path
from siftwell.llm.tokens import UnitEncoder, tokenizer_json

CACHE_SCHEMA = "content string, tokenizer string, n_tokens long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct texts of each batch, compressed: they move to the task that owns their digest."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = {hashlib.sha256(t).hexdigest(): t for t in (x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist())}
        yield pa.RecordBatch.from_arrays([pa.array(list(texts), pa.string()), pa.array([pack.compress(t) for t in texts.values()], pa.binary())], names=["content", "packed"])


def _cached(spark: SparkSession, path: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None,
    cache_path: str | None = None, limit: int = 512,
) -> DataFrame:
    """One row per input row: id_col, n_bytes (of UTF-8), n_tokens, over_limit (more than limit tokens).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows come back repeated; equal texts are encoded once.
    A cache that holds a content twice (a run that failed and came again) counts once. cache_path: the cache to use and to extend; by default a new one in the shared folder. One run writes to a cache
    at a time. Other columns are ignored. Special strings inside texts count as the tokenizer's definition says.
    """
    spark = docs.sparkSession
    definition = tokenizer_json(tokenizer_path)
    version = hashlib.sha256(definition.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(definition)  # 2 MB, whatever the input
    cache_path = cache_path or table_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, unpack, last = UnitEncoder.here(shared.value), zstandard.ZstdDecompressor(), None
        for batch in batches:  # sorted by digest: equal ones stand together
            names, counts, texts, size = [], [], [], 0
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != last:
                    names.append(name)
                    texts.append(unpack.decompress(packed.as_py()))
                    size += len(texts[-1])
                last = name
                if size > 4_000_000:
                    counts += map(len, encoder.ids_of(texts))
                    texts, size = [], 0
            counts += map(len, encoder.ids_of(texts))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([version] * len(names), pa.string()), pa.array(counts, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    known = _cached(spark, cache_path).filter(F.col("tokenizer") == version)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_packed, "content string, packed binary")
    missing = texts.join(known.select("content"), "content", "left_anti").repartition("content").sortWithinPartitions("content")
    missing.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])
    counts = materialize(counts, "token-counts")  # stored, so that the join below can split a content that many rows share
    rows = docs.select(F.col(id_col).alias("__id"), F.sha2(text, 256).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.join(counts, "content").select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
