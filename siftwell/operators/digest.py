"""Changes, digests and their delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import ATTEMPTS, CHUNK_CHARS, TERMINAL_STATES
from siftwell.functions.text import casefold
from siftwell.functions.time import backoff_minutes, urgency
from siftwell.operators.folds import pack_attributed


def pending(changes: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Changes not yet digested with their events, in order of observation: those of eligible events that are not over, and
    those by which an event has come to a terminal state, eligible or not. An event is over by its end, or else its start.
    events: event_id, status, starts_at, and perhaps ends_at and registration_state."""
    have = set(events.columns)
    end = F.coalesce("ends_at", "starts_at") if "ends_at" in have else F.col("starts_at")
    visible = (F.col("status") == "eligible") & (end.isNull() | (end >= now))
    final = F.col("registration_state").isin(*TERMINAL_STATES) if "registration_state" in have else F.lit(False)
    told = final & F.col("change_type").isin("registration_state", "lifecycle")
    return changes.filter(F.col("digested_at").isNull()).join(events, "event_id").filter(F.coalesce(visible, F.lit(False)) | F.coalesce(told, F.lit(False))).orderBy("observed_at", "id")


def grouped_changes(changes: DataFrame) -> DataFrame:
    """(event_id, changes in order of observation)"""
    return changes.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("observed_at", "id", "change_type"))).alias("changes"))


def digest_order(events: DataFrame, now: Column, limit: int) -> DataFrame:
    """Urgent first, then local, best score, earliest start, title. events: event_id, starts_at, local, score, title."""
    ordered = events.withColumn("urgency", urgency(F.col("starts_at"), now))
    return ordered.orderBy(F.desc("urgency"), F.desc("local"), F.desc("score"), F.asc_nulls_last("starts_at"), casefold(F.col("title")), "event_id").limit(limit)


def run_pairs(runs: DataFrame, changes: DataFrame, events: DataFrame) -> DataFrame:
    """Changes and events that a run names, in its order; ids that lead nowhere are left out."""
    ids = runs.select("run_id", F.posexplode("event_change_ids").alias("pos", "id"))
    return ids.join(changes, "id").join(events, "event_id")


def completed_changes(chunks: DataFrame) -> DataFrame:
    """(run_id, id) of changes all of whose chunks were sent. A chunk without attribution completes a run only as a whole."""
    known = chunks.filter("event_change_ids IS NOT NULL").select("run_id", F.explode("event_change_ids").alias("id"), "sent_at")
    per_id = known.groupBy("run_id", "id").agg(F.bool_and(F.col("sent_at").isNotNull()).alias("sent"))
    blocked = chunks.filter("event_change_ids IS NULL AND sent_at IS NULL").select("run_id").distinct()
    return per_id.filter("sent").join(blocked, "run_id", "left_anti")


def digest_chunks(entries: DataFrame, header: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """entries: run_id, position, body, event_change_ids -> (run_id, chunk_index, body, event_change_ids). A digest has few
    entries. Its header belongs to no change; blank lines inside an entry are places to part it."""
    blocks = F.transform(F.filter(F.split("body", "\n\n"), lambda b: b != ""), lambda b: F.struct(b.alias("body"), F.col("event_change_ids").cast("array<bigint>").alias("ids")))
    ordered = entries.select("run_id", "position", blocks.alias("blocks")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "blocks"))).alias("all"))
    first = F.array(F.struct(F.lit(header).alias("body"), F.array().cast("array<bigint>").alias("ids")))
    packed = pack_attributed(F.concat(first, F.flatten(F.transform("all", lambda x: x["blocks"]))), limit)
    return ordered.select("run_id", F.posexplode(packed).alias("chunk_index", "m")).select("run_id", "chunk_index", "m.body", F.col("m.ids").alias("event_change_ids"))


def due_deliveries(deliveries: DataFrame, now: Column, attempts: int = ATTEMPTS) -> DataFrame:
    """Chunks to send now: not sent, not given up, and not waiting for their next attempt."""
    return deliveries.filter(F.col("sent_at").isNull() & (F.coalesce("attempt_count", F.lit(0)) < attempts) & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))


def record_sends(deliveries: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """results: run_id, chunk_index, message_id, error, one row for each chunk that was tried; an error is a failed try."""
    tried = deliveries.join(results.select("run_id", "chunk_index", F.col("message_id").alias("__id"), F.col("error").alias("__error"), F.lit(True).alias("__tried")), ["run_id", "chunk_index"], "left")
    done, failed = F.col("__tried") & F.col("__error").isNull(), F.col("__tried") & F.col("__error").isNotNull()
    count = F.coalesce("attempt_count", F.lit(0)) + F.when(failed, 1).otherwise(0)
    wait = now + F.make_dt_interval(F.lit(0), F.lit(0), backoff_minutes(count).cast("int"))
    changed = {
        "message_id": F.when(done, F.col("__id")).otherwise(F.col("message_id")), "sent_at": F.when(done, now).otherwise(F.col("sent_at")), "attempt_count": count,
        "error": F.when(done, None).when(failed, F.col("__error")).otherwise(F.col("error")), "next_attempt_at": F.when(done, None).when(failed, wait).otherwise(F.col("next_attempt_at")),
    }
    return tried.withColumns(changed).drop("__id", "__error", "__tried")


def run_states(deliveries: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(run_id, status): sent; failed when every chunk not sent is given up; else partial."""
    sent = F.col("sent_at").isNotNull()
    return deliveries.groupBy("run_id").agg(F.when(F.bool_and(sent), "sent").when(F.bool_and(sent | (F.coalesce("attempt_count", F.lit(0)) >= attempts)), "failed").otherwise("partial").alias("status"))


def failed_carry(runs: DataFrame, deliveries: DataFrame, changes: DataFrame, digest_date: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What failed runs before a day leave to it: (chunks, excluded, delivered).

    Runs count that name changes not yet digested and have chunks. ``chunks`` are those not sent of the latest such run, in order,
    with the run's open changes where a chunk has no attribution; ``excluded`` are the ids that all such runs hold back from new
    chunks; ``delivered`` are the ids of runs all of whose chunks were sent.
    """
    failed = runs.filter((F.col("status") == "failed") & (F.col("digest_date") < digest_date))
    open_ = failed.select("run_id", "digest_date", F.explode("event_change_ids").alias("id")).join(changes.filter("digested_at IS NULL").select("id"), "id", "left_semi")
    per_run = deliveries.groupBy("run_id").agg(F.bool_or(F.col("sent_at").isNull()).alias("unsent"))
    held = open_.join(per_run, "run_id")
    latest = held.filter("unsent").groupBy("run_id", "digest_date").agg(F.array_sort(F.collect_set("id")).alias("open_ids")).orderBy(F.desc("digest_date"), F.desc("run_id")).limit(1)
    chunks = deliveries.filter("sent_at IS NULL").join(latest, "run_id").select("run_id", "chunk_index", "body", F.coalesce("event_change_ids", "open_ids").alias("event_change_ids"))
    return chunks, held.filter("unsent").select("id").distinct(), held.filter(~F.col("unsent")).select("id").distinct()


def mark_digested(changes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """The changes, those of ``ids`` that were open digested at ``now``."""
    hit = changes.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return hit.withColumn("digested_at", F.coalesce("digested_at", F.when(F.col("__hit"), now))).drop("__hit")
