"""Keyed state against the batch merge: any split into batches, a restart between them, and the timer."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from siftwell.operators import ingest as G
from siftwell.operators.merge import merge_observations
from siftwell.streaming.events import event_stream
from test_ingest import KINDS, NOW, frame, some

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STORE)


def start(spark, folder, clock=None, schema=None, interval=None):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    def keep(batch, n):
        batch.write.mode("overwrite").parquet(str(folder / "out" / f"batch={n}"))

    writer = event_stream(rows, clock).writeStream.foreachBatch(keep).option("checkpointLocation", str(folder / "check")).outputMode("update")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


@pytest.mark.parametrize("cuts", [(200,), (1, 90, 91, 200)])
def test_any_split_into_batches(spark, rocks, tmp_path, cuts):
    rng = random.Random(21)
    seen = sorted((some(rng, f"k{rng.randrange(12)}", i) for i in range(200)), key=lambda x: (x["observed_at"], x["seq"]))
    whole = frame(spark, seen, KINDS)
    clock = int(NOW.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    begin = 0
    for end in cuts:  # each batch by a query of its own, which starts from the checkpoint
        frame(spark, seen[begin:end], KINDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(spark, tmp_path, clock, whole.schema).awaitTermination()
        begin = end
    out = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    events, changes, _ = merge_observations(frame(spark, [], G.EVENT), whole, F.lit(NOW))
    told = ("event_key", "seq", "change_type", "old_value", "new_value")
    assert sorted(map(str, out.filter("kind = 'change'").select(*told).collect())) == sorted(map(str, changes.select(*told).collect()))
    last = out.filter("kind = 'event'").groupBy("event_key").agg(F.max_by("event", "batch").alias("e")).select("e.*")
    assert {r.event_key: {f: r[f] for f in G.EVENT} for r in last.collect()} == {r.event_key: r.asDict() for r in events.collect()}
    touched = out.filter("kind = 'event'").groupBy("batch").count().collect()
    if len(cuts) > 1:  # a batch of one observation writes one event at most
        assert {r.batch: r["count"] for r in touched}.get(2, 0) <= 1


def test_an_eligible_event_expires_by_its_timer(spark, rocks, tmp_path):
    end = dt.datetime.now(dt.UTC).replace(tzinfo=None) + dt.timedelta(seconds=30)
    x = some(random.Random(1), "k", 1) | {"status": "eligible", "starts_at": end, "ends_at": None, "organizer_trust": "high", "registration_state": "open"}
    df = frame(spark, [x], KINDS)
    df.write.parquet(str(tmp_path / "in"))
    query = start(spark, tmp_path, None, df.schema, "1 second")
    try:
        for _ in range(75):
            time.sleep(1)
            if (tmp_path / "out").exists():
                out = spark.read.option("basePath", str(tmp_path / "out")).schema("kind string, change_type string, old_value string, new_value string, batch int").parquet(str(tmp_path / "out"))
                found = out.filter("kind = 'change'").orderBy("batch").select("change_type", "old_value", "new_value").collect()
                if len(found) == 2:
                    break
    finally:
        query.stop()
    assert [tuple(r) for r in found] == [("new_event", None, "qualified"), ("expired", "eligible", "expired")]
