"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import discard, drop_scope, materialize, read_table, scope
from siftwell.llm.exact_dedup import keep_distinct
from siftwell.llm.mixing import mixed
from siftwell.llm.ngram_join import keep_unlike
from siftwell.llm.packing import pack
from siftwell.llm.quality import keep_quality

#: The scope of the last stage of each session.
_last: weakref.WeakKeyDictionary[SparkSession, str] = weakref.WeakKeyDictionary()


def _stage(make):
    """A stage's intermediate tables are deleted when the next stage begins: by then its result is written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark in _last:
            drop_scope(spark, _last.pop(spark))
        _last[spark] = f"stage-{uuid.uuid4().hex}"
        with scope(spark, _last[spark]):
            return make(spark, docs, sf_dir)

    run.__name__, run.__doc__ = make.__name__, make.__doc__
    return run


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are judged as empty ones, nulls elsewhere as unknown
    metadata; repeated rows are judged alike. Where labels lack a class all documents stay."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, nulls being the smallest; null texts are empty ones. Of rows that
    repeat both exactly one stays."""
    return keep_distinct(docs)


@_stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more: of each group the row with the smallest id stays, null ids last.
    Rows are told apart by id and text; empty and null texts stay."""
    return keep_unlike(docs, words=5, num=80, den=100)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 5, 2, 1 in turn, three times their size at most: rows come as often as the mix takes them. A null
    source is one like others, the last; null and empty texts have size 0; repeated rows are rows of their own."""
    return mixed(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens at most. Null and empty texts are the end token alone; repeated rows, and rows with null ids,
    are packed like others."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage has read is deleted then. Each stage gives
    an empty table for an empty one, and keeps extra columns of any name up to the packing."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        made = materialize(stage(spark, docs, sf_dir), name)
        if i:
            discard(docs)
        docs = made
    return docs
