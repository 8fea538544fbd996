"""Candidates become assessed events: identity, policy, classifier slot, merge with a change log, provenance.

Events are a table keyed by ``event_key`` with the columns of EVENT. Nothing here depends on the number of rows of one
batch: keys meet by equi-joins, and the merge is running windows (see ``merge``).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import EVENT_TYPES, MINIMUM_SCORE
from siftwell.functions import text as X
from siftwell.functions import url as U
from siftwell.functions.time import within_window
from siftwell.operators.arrival import identities, resolve_in_order, survivor_rank
from siftwell.operators.events import assess, score
from siftwell.operators.folds import identity_resolve, organizer_match
from siftwell.operators.merge import ASSESSED, EVENT, FACTS, GUARDED, KEPT, KNOWN, LISTS, OBSERVED, merge_observations

__all__ = ["ASSESSED", "EVENT", "FACTS", "GUARDED", "KEPT", "KNOWN", "LISTS", "OBSERVED", "merge_observations"]
PROMPT = ("title", "description", "organizer", "eligibility_text", "price_text", "format", "event_type")
VERDICT = "is_technical boolean, compatible_eligibility boolean, event_type string, topics array<string>, concise_summary string, rationale string"


class Ingested(NamedTuple):
    events: DataFrame
    changes: DataFrame
    sources: DataFrame
    assessed: DataFrame


def prompts(rows: DataFrame) -> DataFrame:
    """(id, record): all that a classifier may see of a candidate, as JSON with nulls."""
    return rows.select("id", F.to_json(F.struct(*PROMPT), {"ignoreNullFields": "false"}).alias("record"))


def verdicts(answers: DataFrame) -> DataFrame:
    """answers (id, place, provider, model, content) -> the first valid one of each id, by place.

    Valid is a JSON object, perhaps fenced, with two booleans, a known event type if any, a list of texts if any, and a
    summary and rationale of at most 400 characters each.
    """
    body = X.unfenced_json(F.col("content"))
    kind = lambda c: F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{c}", "variant"))
    rows = answers.withColumns({"v": F.try_parse_json(body), "j": F.from_json(body, VERDICT)})
    one_of = F.coalesce(F.col("j.event_type"), F.lit("unknown"))
    sound = (
        (kind("is_technical") == "BOOLEAN") & (kind("compatible_eligibility") == "BOOLEAN") & (kind("concise_summary") == "STRING") & (kind("rationale") == "STRING")
        & (F.length("j.concise_summary") <= 400) & (F.length("j.rationale") <= 400) & one_of.isin(*EVENT_TYPES)
        & F.coalesce(kind("topics").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(True))
    )
    told = F.map_filter(F.create_map(F.lit("provider"), "provider", F.lit("model"), "model", F.lit("rationale"), "j.rationale"), lambda _, v: F.coalesce(v, F.lit("")) != "")
    row = F.struct(
        (F.col("j.is_technical") & F.col("j.compatible_eligibility")).alias("fits"), one_of.alias("event_type"), F.coalesce("j.topics", F.array().cast("array<string>")).alias("topics"),
        F.col("j.concise_summary").alias("concise_summary"), told.alias("ai_provenance"),
    )
    return rows.filter(F.coalesce(sound, F.lit(False))).groupBy("id").agg(F.min_by(row, "place").alias("verdict"))


def assess_candidates(
    candidates: DataFrame, organizers: DataFrame, aliases: DataFrame, domains: DataFrame, now: Column, *, profiles: DataFrame | None = None,
    topics: tuple[str, ...] = (), excluded: tuple[str, ...] = (), minimum: int = MINIMUM_SCORE, classify: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The candidates with status, reason, score, approval_required, organizer_trust, concise_summary and ai_provenance.

    ``id`` is unique. ``classify`` gets ``prompts`` of the ambiguous candidates that no earlier rule has decided, and returns
    answers for ``verdicts``; a candidate without a valid answer is left for review. A positive verdict adds topics and
    the event type where it is unknown, never other facts.
    """
    c = F.col
    who = organizer_match(candidates.select("id", "organizer", "source_name", U.host(c("canonical_url")).alias("host")), organizers, aliases, domains, profiles)
    local = X.in_city(c("city"), c("venue"))
    trusted = c("online_allowed") & c("explicit_identity")
    topic = X.any_phrase(X.joined(c("title"), c("description"), F.array_join("topics", " ")), topics)
    rows = candidates.join(who.drop("name").withColumnRenamed("trust", "organizer_trust"), "id").withColumns({
        "paid": F.coalesce("is_explicitly_paid", F.lit(False)) | X.is_paid(c("price_text")), "excluded": X.excluded(c("title"), c("description"), excluded),
        "ineligible": X.ineligible(c("eligibility_text"), c("description")), "approval": X.needs_approval(c("eligibility_text"), c("description")),
        "in_window": within_window(c("starts_at"), c("ends_at"), c("registration_opened_at"), c("first_observed_open_at"), now), "local": local,
        "place_ok": local | (c("format").isin("online", "hybrid") & trusted), "topic": topic,
    })
    rows = rows.withColumn("ambiguous", ~c("topic") | (F.coalesce("event_type", F.lit("unknown")) == "unknown"))
    if classify is None:
        rows = rows.withColumn("said", F.lit(None).cast("struct<fits: boolean, event_type: string, topics: array<string>, concise_summary: string, ai_provenance: map<string, string>>")).withColumn("verdict", F.lit(None).cast("string"))
    else:
        open_ = assess(rows.withColumns({"score": F.lit(0), "verdict": F.lit(None).cast("string")}), now, minimum).filter("status = 'needs_review' AND reason = 'Ambiguous technical fit'")
        rows = rows.join(verdicts(classify(prompts(open_))).withColumnRenamed("verdict", "said"), "id", "left")
        rows = rows.withColumn("verdict", F.when(c("said").isNull(), "unavailable").when(c("said.fits"), "yes").otherwise("no"))
    yes = F.coalesce(c("ambiguous") & (c("verdict") == "yes"), F.lit(False))
    more = F.array_sort(F.array_union(F.coalesce("topics", F.array().cast("array<string>")), F.coalesce("said.topics", F.array().cast("array<string>"))))
    rows = rows.withColumns({
        "topics": F.when(yes, more).otherwise(c("topics")), "event_type": F.when(yes & (F.coalesce("event_type", F.lit("unknown")) == "unknown"), c("said.event_type")).otherwise(F.coalesce("event_type", F.lit("unknown"))),
        "topic": c("topic") | yes, "concise_summary": F.when(yes, c("said.concise_summary")), "ai_provenance": F.when(yes, c("said.ai_provenance")),
    })
    points = score(c("topic"), c("event_type"), c("organizer_trust"), c("local"), c("format"), c("registration_state"), F.size(F.coalesce("speakers", F.array().cast("array<string>"))), c("registration_deadline"), F.coalesce("registration_opened_at", "first_observed_open_at"), now)
    out = assess(rows.withColumn("score", points), now, minimum)
    return out.drop("paid", "excluded", "ineligible", "approval", "in_window", "local", "place_ok", "topic", "ambiguous", "said", "verdict", "online_allowed", "explicit_identity")


def expire(events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(events with those eligible ones expired that are over, one change for each of them)"""
    over = F.coalesce((F.col("status") == "eligible") & (F.coalesce("ends_at", "starts_at") < now), F.lit(False))
    gone = events.filter(over).select("event_key", now.cast("timestamp").alias("observed_at"), F.lit("expired").alias("change_type"), F.lit("eligible").alias("old_value"), F.lit("expired").alias("new_value"))
    return events.withColumn("status", F.when(over, "expired").otherwise(F.col("status"))), gone


def ingest(candidates: DataFrame, events: DataFrame, now: Column, organizers: DataFrame, aliases: DataFrame, domains: DataFrame, **policy) -> Ingested:
    """A batch of candidates (``id`` in order of arrival, ``observed_at`` and facts) meets the events.

    Each candidate gets the time at which registration was first seen open where its event was not, and is assessed; then
    candidates are matched and merged one after another, as they arrive (see ``arrival``). ``policy`` goes to
    ``assess_candidates``. The state that a candidate is compared with before its assessment is that of the events as
    given, not of earlier rows of the batch. The assessed rows are stored under ``spark.checkpoint.dir``, so a classifier is asked
    once about each.
    """
    marks = ("identity", "webinar", "normalized_key")
    rows = identities(candidates)
    known = identities(events).select(F.col("event_key").alias("id"), "canonical_url", *marks, survivor_rank().alias("rank"))
    hits = identity_resolve(rows.select(F.col("id").alias("seq"), "canonical_url", *marks), known).select(F.col("seq").alias("id"), "event_id")
    met = rows.join(hits, "id").join(events.select(F.col("event_key").alias("event_id"), F.col("registration_state").alias("was")), "event_id", "left")
    opened = F.coalesce(F.col("was").isin("unknown", "closed") & (F.col("registration_state") == "open"), F.lit(False))
    met = met.withColumn("first_observed_open_at", F.coalesce("first_observed_open_at", F.when(opened, F.col("observed_at")))).drop("was")
    assessed = assess_candidates(met, organizers, aliases, domains, now, **policy).checkpoint()
    arrived = assessed.withColumn("seq", F.col("id"))
    guess = arrived.select("seq", F.coalesce("event_id", "identity", "canonical_url").alias("event_key"))
    keyed = arrived.join(resolve_in_order(arrived, events, now, guess), "seq").drop("event_id", *marks)
    return Ingested(*merge_observations(events, keyed, now, ("seq",)), assessed.drop("event_id", *marks))
