"""The query surface: filters, ranked lists, health of sources, cadence."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.constants import CITY_WORDS, DASHBOARD_LIMIT, TERMINAL_STATES
from siftwell.functions.text import phrase


def conditions(
    *, status: str | None = "eligible", event_type: str | None = None, event_types: list[str] | None = None, format: str | None = None,
    registration_state: str | None = None, text: str | None = None, organizer: str | None = None, start_after: Column | dt.datetime | None = None,
    start_before: Column | dt.datetime | None = None, before_exclusive: bool = False, opened_after: Column | dt.datetime | None = None, city_only: bool = False,
    as_of: Column | dt.datetime | None = None, topic: str | None = None,
) -> list[Column]:
    """The conditions of all the given filters. Text is a pattern of ILIKE: % and _ in it are not escaped."""
    at = lambda x: x if isinstance(x, Column) else F.lit(x)
    tests: list[Column] = []
    tests += [F.col(name) == value for name, value in (("status", status), ("event_type", event_type), ("format", format), ("registration_state", registration_state)) if value is not None]
    if event_types is not None:
        tests.append(F.col("event_type").isin(event_types))
    if text:
        tests.append(F.col("title").ilike(f"%{text}%") | F.col("description").ilike(f"%{text}%"))
    if organizer:
        tests.append(F.col("organizer").ilike(f"%{organizer}%"))
    if start_after is not None:
        tests.append(F.col("starts_at") >= at(start_after))
    if start_before is not None:
        tests.append(F.col("starts_at") < at(start_before) if before_exclusive else F.col("starts_at") <= at(start_before))
    if opened_after is not None:
        tests.append((F.col("registration_opened_at") >= at(opened_after)) | (F.col("first_observed_open_at") >= at(opened_after)))
    if city_only:
        tests.append(reduce(or_, (F.col(c).ilike(f"%{w}%") for c in ("city", "venue") for w in CITY_WORDS)))
    if as_of is not None:
        end = F.coalesce("ends_at", "starts_at")
        tests.append(end.isNull() | (end >= at(as_of)))
    if topic:
        tests.append(phrase(F.concat_ws(" ", "title", "description", F.array_join("topics", " ")), topic))
    return tests


def matching(events: DataFrame, *, sources: DataFrame | None = None, source_name: str | None = None, **filters) -> DataFrame:
    """Events that pass all the given filters (see ``conditions``), and that a source whose name has ``source_name`` has told of."""
    out = reduce(DataFrame.filter, conditions(**filters), events)
    if sources is not None and source_name:
        found = sources.filter(F.col("source_name").ilike(f"%{source_name}%")).select(F.col("event_id").alias("id"))
        out = out.join(found, "id", "left_semi")
    return out


def sections(events: DataFrame, filters: dict[str, dict], limit: int = DASHBOARD_LIMIT) -> DataFrame:
    """The first ``limit`` events of each section, with the column ``section``: one scan of the events, whatever the number of
    sections. filters: the filters of each section by its name, in which no status means eligible ones."""
    tests = {name: reduce(and_, conditions(**how), F.lit(True)) for name, how in filters.items()}
    names = F.filter(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())), lambda n: n.isNotNull())
    order = Window.partitionBy("section").orderBy(F.desc("score"), F.asc_nulls_last("starts_at"), "id")
    return events.withColumn("section", F.explode(names)).withColumn("no", F.row_number().over(order)).filter(F.col("no") <= limit).drop("no")


def ranked(events: DataFrame, limit: int = DASHBOARD_LIMIT) -> DataFrame:
    """Best score first, then the earliest start, events without one last."""
    return events.orderBy(F.desc("score"), F.asc_nulls_last("starts_at"), "id").limit(limit)


def refresh_queue(events: DataFrame, limit: int = 50) -> DataFrame:
    return events.filter("status = 'eligible'").orderBy(F.asc_nulls_first("starts_at"), "id").limit(limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run of each source that started last."""
    order = Window.partitionBy("source_name").orderBy(F.desc("started_at"), F.desc("id"))
    return runs.withColumn("__no", F.row_number().over(order)).filter("__no = 1").drop("__no")


def source_health(runs: DataFrame) -> DataFrame:
    """error over degraded (nothing fetched) over ok."""
    state = F.when(F.col("error").isNotNull(), "error").when(F.coalesce("fetched_count", F.lit(0)) == 0, "degraded").otherwise("ok")
    return latest_runs(runs).select("source_name", "started_at", "fetched_count", state.alias("state")).orderBy("source_name")


def quorum(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """(total, fresh, needed, healthy): at least half of the sources, and one, need a fresh good run.
    sources: source_name, cadence_hours."""
    last = latest_runs(runs).select("source_name", "started_at", "error")
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    fresh = F.col("started_at").isNotNull() & F.col("error").isNull() & (age <= F.col("cadence_hours") * 2 * 3_600_000_000)
    counted = sources.join(last, "source_name", "left").agg(F.count("*").alias("total"), F.count_if(F.coalesce(fresh, F.lit(False))).alias("fresh"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("total") / 2)).cast("long")
    return counted.select("total", "fresh", needed.alias("needed"), (F.col("fresh") >= needed).alias("healthy"))


def due(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Whether each source should run: never ran, or its cadence has passed (inclusive, to the microsecond)."""
    last = runs.groupBy("source_name").agg(F.max("started_at").alias("last"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    return sources.join(last, "source_name", "left").withColumn("due", F.col("last").isNull() | (age >= F.col("cadence_hours") * 3_600_000_000))


def score(topic: Column, kind: Column, trust: Column, local: Column, format_: Column, state: Column, speakers: Column, deadline: Column, opened: Column, now: Column) -> Column:
    """0 to 15 points."""
    week = F.make_dt_interval(F.lit(7))
    parts = [
        F.when(topic, 3), F.when(kind != "unknown", 2), F.when(trust == "high", 2).when(trust == "medium", 1), F.when(local, 2).when(format_ == "online", 1),
        F.when(state == "open", 2).when(state == "waitlist", 1), F.when(speakers > 0, 1), F.when(deadline.between(now, now + week), 2), F.when(opened >= now - week, 1),
    ]
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))


def assess(rows: DataFrame, now: Column, minimum: int) -> DataFrame:
    """Status, reason, score and approval_required: the first rule that applies decides.

    Rows carry the flags of the rules as columns: paid, excluded, ineligible, in_window, place_ok, ambiguous, approval, the
    score, and the verdict on ambiguous rows, which is null without a classifier, else unavailable, no or yes. Rows that are
    decided before their score counts have 0, and approval is told of those only that may still be attended.
    """
    is_ = lambda c: F.coalesce(c, F.lit(False))
    unclear, verdict = is_(F.col("ambiguous")), F.col("verdict")

    def result(status: str, reason: str | Column, scored: bool = False, approval: bool = False) -> Column:
        points = F.col("score") if scored else F.lit(0)
        return F.struct(F.lit(status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), points.cast("long").alias("score"), (is_(F.col("approval")) if approval else F.lit(False)).alias("approval_required"))

    # Reasons are stored with the events.
    out = (
        F.when(is_(F.col("paid")), result("rejected", "Explicitly paid admission")).when(is_(F.col("excluded")), result("rejected", "Excluded event category"))
        .when(is_(F.col("ineligible")), result("rejected", "Explicitly incompatible eligibility"))
        .when(F.col("registration_state").isin(*TERMINAL_STATES), result("rejected", F.concat(F.lit("Registration is "), F.col("registration_state"))))
        .when(is_(F.col("registration_deadline") < now), result("needs_review", "Registration deadline has passed"))
        .when(~is_(F.col("in_window")), result("needs_review", "Missing or out-of-window start time"))
        .when(~is_(F.col("place_ok")), result("rejected", "Not Bengaluru or trusted global online"))
        .when(unclear & verdict.isNull(), result("needs_review", "Ambiguous technical fit", approval=True))
        .when(unclear & (verdict == "unavailable"), result("needs_review", "Ambiguous candidate; AI classification unavailable", approval=True))
        .when(unclear & (verdict == "no"), result("rejected", "AI classification rejected ambiguous candidate"))
        .when(F.col("score") < minimum, result("needs_review", "Below deterministic ranking threshold", True, True))
        .otherwise(result("eligible", "Technical event matching location and time policy", True, True))
    )
    return rows.withColumn("__a", out).drop("score").select("*", "__a.*").drop("__a")
