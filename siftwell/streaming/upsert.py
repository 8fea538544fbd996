"""Micro-batches of observations merged into a snapshot, and expiry; both restart from their checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.folds import trust_merge


def upsert_stream(
    observations: DataFrame, folder: str, checkpoint: str, now: Callable[[], object], fields: tuple[str, ...] = ("title", "venue"), interval: str | None = None,
) -> StreamingQuery:
    """Each micro-batch is folded into the latest snapshot and written as the next one, ``folder/v=<batch id>``.

    A batch that runs again after a failure overwrites its own snapshot, so it counts once. With ``interval`` the query
    runs on, one batch at a time; without, it stops when what is there has been read.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        names = ["event_key", *fields, "registration_state", "trust", "score", "status", "ends_at"]
        before = spark.read.parquet(f"{folder}/v={batch_id - 1}") if batch_id else batch.limit(0).select(*names)
        trust_merge(before, batch, F.lit(now()), fields).write.mode("overwrite").parquet(f"{folder}/v={batch_id}")

    writer = observations.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
