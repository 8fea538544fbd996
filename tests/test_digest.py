"""Chunks with their changes, and the states of deliveries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from siftwell.operators import digest as D

NOW = dt.datetime(2026, 6, 1, 9)
KINDS = "run_id long, chunk_index int, body string, event_change_ids array<bigint>, message_id string, sent_at timestamp, attempt_count int, error string, next_attempt_at timestamp"


def rows(spark, *given):
    return spark.createDataFrame([(r, i, f"b{i}", ids, None, sent, n, None, at) for r, i, ids, sent, n, at in given], KINDS)


def test_chunks_know_their_changes(spark):
    entries = [(1, 2, "bbbb\n\ncc", [3]), (1, 1, "aaaa", [2, 1]), (2, 1, "x" * 9 + "\n" + "y" * 14, [7, 7]), (3, 1, "", [9])]
    df = D.digest_chunks(spark.createDataFrame(entries, "run_id long, position int, body string, event_change_ids array<bigint>"), "head", 12)
    assert {(r.run_id, r.chunk_index): (r.body, r.event_change_ids) for r in df.collect()} == {
        (1, 0): ("head\n\naaaa", [1, 2]), (1, 1): ("bbbb\n\ncc", [3]), (2, 0): ("head", []), (2, 1): ("x" * 9, [7]), (2, 2): ("y" * 12, [7]), (2, 3): ("yy", [7]), (3, 0): ("head", []),
    }


def test_sends(spark):
    later = NOW + dt.timedelta(hours=1)
    d = rows(spark, (1, 0, [1], None, 0, None), (1, 1, [2], None, 2, NOW), (1, 2, [3], None, 1, later), (1, 3, [3], None, 3, None), (2, 0, [4], NOW, 0, None), (3, 0, None, None, 3, None))
    assert sorted((r.run_id, r.chunk_index) for r in D.due_deliveries(d, F.lit(NOW)).collect()) == [(1, 0), (1, 1)]
    after = D.record_sends(d, spark.createDataFrame([(1, 0, "m", None), (1, 1, None, "down")], "run_id long, chunk_index int, message_id string, error string"), F.lit(NOW))
    got = {(r.run_id, r.chunk_index): (r.message_id, r.sent_at, r.attempt_count, r.error, r.next_attempt_at) for r in after.collect()}
    assert got[1, 0] == ("m", NOW, 0, None, None)
    assert got[1, 1] == (None, None, 3, "down", NOW + dt.timedelta(minutes=8))
    assert got[1, 2] == (None, None, 1, None, later)
    assert {r.run_id: r.status for r in D.run_states(after).collect()} == {1: "partial", 2: "sent", 3: "failed"}


def test_failed_runs_carry_over(spark):
    runs = spark.createDataFrame([(1, "2026-05-01", "failed", [1, 2]), (2, "2026-05-02", "failed", [3, 4]), (3, "2026-05-03", "failed", [5]), (4, "2026-05-04", "failed", [6]), (5, "2026-06-01", "failed", [7]), (6, "2026-05-05", "sent", [8])], "run_id long, digest_date string, status string, event_change_ids array<bigint>")
    d = rows(spark, (1, 0, [1], None, 3, None), (2, 0, [3], NOW, 0, None), (2, 1, None, None, 3, None), (3, 0, [5], NOW, 0, None), (5, 0, [7], None, 3, None))
    changes = spark.createDataFrame([(i, NOW if i == 4 else None) for i in range(1, 9)], "id long, digested_at timestamp")
    chunks, excluded, delivered = D.failed_carry(runs, d, changes, "2026-06-01")
    assert [(r.run_id, r.chunk_index, r.event_change_ids) for r in chunks.collect()] == [(2, 1, [3])]
    assert sorted(r.id for r in excluded.collect()) == [1, 2, 3]
    assert [r.id for r in delivered.collect()] == [5]
    marked = D.mark_digested(changes, delivered, F.lit(NOW))
    assert sorted(r.id for r in marked.filter("digested_at IS NOT NULL").collect()) == [4, 5]
    assert [x.count() for x in D.failed_carry(runs.limit(0), d.limit(0), changes.limit(0), "2026-06-01")] == [0, 0, 0]
