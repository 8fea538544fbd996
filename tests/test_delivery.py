"""A digest run: suppression, frozen chunks, and sending that is killed and resumed."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwell.operators.delivery import RESULT, deliver, plan_run, suppressed

NOW = dt.datetime(2026, 6, 1, 9)
EVENT = "event_id long, status string, format string, starts_at timestamp, ends_at timestamp, registration_state string, local boolean, score long, title string"
CHANGE = "id long, event_id long, change_type string, old_value string, new_value string, observed_at timestamp, digested_at timestamp"


@pytest.fixture
def tables(spark):
    day = lambda n: dt.datetime(2026, 6, n)
    events = [(1, "eligible", "online", day(10), None, "open", True, 5, "One"), (2, "eligible", "online", day(2), None, "open", False, 3, "Two"), (3, "rejected", "online", day(3), None, "cancelled", False, 1, "Gone"), (4, "eligible", "hybrid", day(9), None, "open", False, 9, "Four")]
    iso = lambda n: f"2026-06-{n:02}T00:00:00+00:00"
    changes = [
        (1, 1, "new_event", None, "qualified"), (2, 1, "registration_url", "https://r.org/a", "https://r.org/a?utm_source=x"), (3, 1, "format", "online", "hybrid"), (4, 1, "format", "hybrid", "online"),
        (5, 2, "schedule", iso(2), iso(5)), (6, 2, "schedule", iso(5), iso(2)), (7, 2, "venue", "a", "b"), (8, 3, "registration_state", "open", "cancelled"), (9, 3, "venue", "a", "b"), (10, 4, "format", "online", "hybrid"), (11, 4, "registration_url", "https://r.org/a", "https://r.org/b"),
    ]
    return spark.createDataFrame([(*c, NOW - dt.timedelta(hours=20 - c[0]), None) for c in changes], CHANGE), spark.createDataFrame(events, EVENT)


def test_what_tells_nothing(tables):
    assert sorted((r.id, r.why) for r in suppressed(*tables).collect()) == [(2, "same destination"), (3, "format reverted"), (4, "format reverted"), (5, "schedule reverted"), (6, "schedule reverted")]


def test_a_run_is_frozen_in_order(spark, tables):
    body = F.concat(F.col("title"), F.lit(": "), F.array_join("kinds", ", "))
    run = plan_run(*tables, F.lit(NOW), 7, body, "Digest")
    row = run.run.first()
    assert (row.event_change_ids, row.digest_date, row.status) == ([1, 7, 8, 10, 11], "2026-06-01", "pending")
    chunk = run.deliveries.first()
    assert chunk.body == "Digest\n\nTwo: venue\n\nGone: registration_state\n\nOne: new_event\n\nFour: format, registration_url"
    assert chunk.event_change_ids == [1, 7, 8, 10, 11]
    held = spark.createDataFrame([(7,), (1,)], "id long")
    assert plan_run(*tables, F.lit(NOW), 8, body, "Digest", held, limit=1).run.first().event_change_ids == [8]


def test_a_killed_run_sends_no_chunk_twice(spark, tmp_path):
    kinds = "run_id long, chunk_index int, body string, event_change_ids array<bigint>, message_id string, sent_at timestamp, attempt_count int, error string, next_attempt_at timestamp"
    rows = spark.createDataFrame([(1, i, f"b{i}", [i], None, None, 0, None, None) for i in range(4)], kinds)
    sent, log = [], str(tmp_path / "log")

    def sender(breaks: int | None = None, fails: int | None = None):
        def send(chunk):
            r = chunk.first()
            if r.chunk_index == breaks:
                raise KeyboardInterrupt
            if r.chunk_index == fails:
                return spark.createDataFrame([(r.run_id, r.chunk_index, None, "refused")], RESULT)
            sent.append(r.chunk_index)
            return spark.createDataFrame([(r.run_id, r.chunk_index, f"m{r.chunk_index}", None)], RESULT)

        return send

    with pytest.raises(KeyboardInterrupt):
        deliver(rows, log, sender(breaks=1), F.lit(NOW))
    _, states = deliver(rows, log, sender(fails=2), F.lit(NOW + dt.timedelta(minutes=1)))
    assert sent == [0, 1] and states.first().status == "partial"
    again, _ = deliver(rows, log, sender(), F.lit(NOW + dt.timedelta(minutes=2)))
    assert sent == [0, 1] and again.filter("chunk_index = 2").first().attempt_count == 1  # it waits, and so does what comes after it
    after, states = deliver(rows, log, sender(), F.lit(NOW + dt.timedelta(minutes=9)))
    assert sent == [0, 1, 2, 3] and states.first().status == "sent"
    assert [r.message_id for r in after.orderBy("chunk_index").collect()] == ["m0", "m1", "m2", "m3"]
