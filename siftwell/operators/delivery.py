"""A digest run from pending changes to sent chunks: what is suppressed, what is frozen, and sending that resumes."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.constants import DIGEST_LIMIT
from siftwell.functions import url as U
from siftwell.functions.text import casefold
from siftwell.functions.time import iso_text, urgency
from siftwell.operators.digest import digest_chunks, digest_order, due_deliveries, pending, record_sends, run_states
from siftwell.operators.folds import reverted_schedules

RESULT = "run_id long, chunk_index int, message_id string, error string"


class Run(NamedTuple):
    run: DataFrame
    deliveries: DataFrame
    suppressed: DataFrame


def suppressed(changes: DataFrame, events: DataFrame) -> DataFrame:
    """(id, why) of changes that tell nothing: a registration url that leads to the same place; all format changes of an event
    whose oldest began with the format that it has now; schedules that were reverted (see ``reverted_schedules``).

    changes: id, event_id, change_type, old_value, new_value, observed_at. events: event_id, format, starts_at, ends_at.
    """
    c = F.col
    moved = changes.filter((c("change_type") == "registration_url") & U.same_destination(c("old_value"), c("new_value"))).select("id", F.lit("same destination").alias("why"))
    formats = changes.filter("change_type = 'format'")
    oldest = formats.groupBy("event_id").agg(F.min_by("old_value", F.struct("observed_at", "id")).alias("oldest"))
    back = oldest.join(events.select("event_id", "format"), "event_id").filter("oldest = format").select("event_id")
    flipped = formats.join(back, "event_id", "left_semi").select("id", F.lit("format reverted").alias("why"))
    dates = changes.filter("change_type = 'schedule'").join(events.select("event_id", iso_text(c("starts_at")).alias("starts_at"), iso_text(c("ends_at")).alias("ends_at")), "event_id")
    undone = reverted_schedules(dates.select("event_id", "id", "old_value", "new_value", "observed_at", "starts_at", "ends_at")).select("id", F.lit("schedule reverted").alias("why"))
    return moved.unionByName(flipped).unionByName(undone)


def plan_run(changes: DataFrame, events: DataFrame, now: Column, run_id: int, body: Column, header: str, held: DataFrame | None = None, limit: int = DIGEST_LIMIT) -> Run:
    """One run of the changes that are pending, not suppressed and not ``held`` back (ids) for an earlier run: the run with the ids
    that it names, its frozen chunks, and what was suppressed, which is to be marked digested too.

    events: event_id, status, format, starts_at, ends_at, registration_state, local, score, title, and what ``body`` reads. The
    body of an event's entry may read ``kinds``, the sorted kinds of its changes. Of all events the first ``limit`` are told, in the
    order of the digest; the changes of the others stay pending.
    """
    c = F.col
    quiet = suppressed(changes.filter("digested_at IS NULL"), events)
    open_ = pending(changes, events, now).join(quiet.select("id").distinct(), "id", "left_anti")
    if held is not None:
        open_ = open_.join(held.select("id").distinct(), "id", "left_anti")
    told = open_.groupBy("event_id").agg(F.array_sort(F.collect_set("change_type")).alias("kinds"), F.array_sort(F.collect_set("id")).alias("ids"))
    entries = digest_order(events.join(told, "event_id"), now, limit).checkpoint()  # ``limit`` rows
    place = F.row_number().over(_by_order(now))
    rows = entries.select(F.lit(run_id).cast("long").alias("run_id"), place.alias("position"), body.alias("body"), c("ids").alias("event_change_ids"))
    chunks = digest_chunks(rows, header)
    empty = {"message_id": "string", "sent_at": "timestamp", "attempt_count": "int", "error": "string", "next_attempt_at": "timestamp"}
    deliveries = chunks.withColumns({n: F.lit(0 if n == "attempt_count" else None).cast(t) for n, t in empty.items()})
    run = rows.groupBy("run_id").agg(F.array_sort(F.flatten(F.collect_list("event_change_ids"))).alias("event_change_ids")).withColumns({"digest_date": F.to_date(F.from_utc_timestamp(now, "Asia/Kolkata")).cast("string"), "status": F.lit("pending")})
    return Run(run, deliveries, quiet)


def _by_order(now: Column):
    return Window.partitionBy(F.lit(1)).orderBy(urgency(F.col("starts_at"), now).desc(), F.desc("local"), F.desc("score"), F.asc_nulls_last("starts_at"), casefold(F.col("title")), "event_id")


def deliver(deliveries: DataFrame, log: str, send: Callable[[DataFrame], DataFrame], now: Column) -> tuple[DataFrame, DataFrame]:
    """Sends the chunks that are due, in order, each once: (deliveries afterwards, states of their runs).

    ``send`` gets one chunk after another as a DataFrame of one row and returns its result (RESULT). A result is appended to the
    table ``log`` before the next chunk is sent, and what the log has is applied first, so a run that was killed goes on after
    the last chunk that it logged. A chunk that fails waits for its next attempt, and so do those after it: a digest is sent in order.
    """
    spark = deliveries.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    done = spark.read.schema(f"{RESULT}, logged_at timestamp").parquet(log) if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else spark.createDataFrame([], f"{RESULT}, logged_at timestamp")
    state = _apply(deliveries, done).checkpoint()
    waiting = due_deliveries(state, now).select("run_id", "chunk_index").orderBy("run_id", "chunk_index").toLocalIterator()  # a digest has few chunks
    stopped: set[int] = set()
    blocked = {(r["run_id"], r["chunk_index"]) for r in state.filter("sent_at IS NULL").join(due_deliveries(state, now).select("run_id", "chunk_index"), ["run_id", "chunk_index"], "left_anti").select("run_id", "chunk_index").collect()}
    for chunk in waiting:
        if chunk["run_id"] in stopped or any(run == chunk["run_id"] and i < chunk["chunk_index"] for run, i in blocked):
            continue
        one = state.filter((F.col("run_id") == chunk["run_id"]) & (F.col("chunk_index") == chunk["chunk_index"]))
        result = [tuple(r) for r in send(one).select("run_id", "chunk_index", "message_id", "error").collect()]  # one row
        logged = spark.createDataFrame(result, RESULT).withColumn("logged_at", now.cast("timestamp"))
        logged.coalesce(1).write.mode("append").parquet(log)
        state = _apply(state, logged).checkpoint()
        if any(r[3] is not None for r in result):
            stopped.add(chunk["run_id"])
    return state, run_states(state)


def _apply(deliveries: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the log that the deliveries do not know yet: sent ones, or the tries after those counted."""
    tries = results.groupBy("run_id", "chunk_index").agg(F.count("error").alias("failures"), F.max_by(F.struct("message_id", "error", "logged_at"), "logged_at").alias("r"))
    fresh = deliveries.join(tries, ["run_id", "chunk_index"]).filter("sent_at IS NULL AND (r.error IS NULL OR failures > coalesce(attempt_count, 0))")
    told = fresh.select("run_id", "chunk_index", "r.*")
    at = deliveries.join(told.select("run_id", "chunk_index", "logged_at"), ["run_id", "chunk_index"], "left")
    return record_sends(at, told, F.col("logged_at")).drop("logged_at").select(deliveries.columns)
