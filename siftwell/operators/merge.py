"""Observations merged into events: an ordered, trust-aware fold written as running windows.

Nothing that the fold keeps depends on more than the order of rows: the trust of an event is a running maximum; a fact is the
last one told by a row trusted as much, else the first one told at all; a state is the last one that a row trusted as
much has set, and where that is not terminal, what others have set since. So each field is a running last, first or maximum,
and no group of rows is ever held. Rows are dealt over ranges of events; an event with more rows than a range is cut by its
order. Such an event is summed up range by range, and what the ranges before leave is carried into the next, so one event
with a third of all observations is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.constants import MATERIAL_FIELDS, TERMINAL_STATES, TRUST_RANK
from siftwell.functions import text as X
from siftwell.functions import url as U
from siftwell.functions.time import iso_text

FACTS = {
    "title": "string", "organizer": "string", "description": "string", "venue": "string", "city": "string", "country": "string", "registration_url": "string",
    "registration_deadline": "timestamp", "registration_opened_at": "timestamp", "first_observed_open_at": "timestamp",
}
GUARDED = {"starts_at": "timestamp", "ends_at": "timestamp", "price_text": "string", "eligibility_text": "string"}
KNOWN = {"format": "string", "event_type": "string"}
ASSESSED = {"organizer_trust": "string", "score": "long", "status": "string", "approval_required": "boolean", "concise_summary": "string", "ai_provenance": "map<string, string>"}
LISTS = {"speakers": "array<string>", "topics": "array<string>"}
OBSERVED = FACTS | GUARDED | KNOWN | ASSESSED | LISTS | {"registration_state": "string", "price_status": "string", "reason": "string", "source_url": "string"}
KEPT = FACTS | GUARDED | KNOWN | ASSESSED | LISTS | {"registration_state": "string", "price_status": "string", "relevance_reason": "string", "source_urls": "array<string>"}
EVENT = {"event_key": "string", "canonical_url": "string"} | KEPT

_HOW = {"last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True), "max": F.max, "sum": F.sum}


def rank(c: Column, table: dict[str, int] = TRUST_RANK) -> Column:
    """Place of a value in a table, 0 for others."""
    out = F.lit(0)
    for name, n in table.items():
        out = F.when(c == name, n).otherwise(out)
    return out


def with_columns(rows: DataFrame, kinds: dict[str, str]) -> list[Column]:
    """The columns, null where the rows lack one."""
    have = set(rows.columns)
    return [(F.col(f) if f in have else F.lit(None)).cast(kind).alias(f) for f, kind in kinds.items()]


def said(v: Column, kind: str) -> Column:
    return iso_text(v) if kind == "timestamp" else v.cast("string")


class Ranges:
    """Rows of events in an order, dealt over ranges and stored; running values over the rows of each event."""

    def __init__(self, rows: DataFrame, order: list[str], key: str = "event_key"):
        """Stores the rows under ``spark.checkpoint.dir``, as ranges that are made again might be cut elsewhere."""
        self.key, self.order = key, order
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).checkpoint()
        whole = sizes.agg(F.sum("n")).first()[0] or 0
        # only an event with more rows than a range is cut; there are fewer of them than ranges
        large = sizes.filter(F.col("n") * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) > whole).select(F.col(key).alias("large"))
        dealt = rows.join(F.broadcast(large), F.col(key) == F.col("large"), "left")
        cut = [F.when(F.col("large").isNotNull(), F.col(o)) for o in order]
        self.rows = dealt.repartitionByRange(key, *cut).drop("large").withColumn("range", F.spark_partition_id()).checkpoint()
        ends = self.rows.groupBy(key).agg(F.min("range").alias("a"), F.max("range").alias("b"))
        self.split = not ends.filter("a < b").isEmpty()

    def running(self, rows: DataFrame, columns: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
        """Adds the running ``last`` or ``first`` value that is not null, ``max`` or ``sum``, up to each row; before: without the row."""
        spot = Window.partitionBy(self.key, "range").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
        inputs = rows.withColumns({f"in_{n}": c for n, (_, c) in columns.items()})
        gone = [f"in_{n}" for n in columns]
        if not self.split:
            return inputs.withColumns({n: _HOW[how](F.col(f"in_{n}")).over(spot) for n, (how, _) in columns.items()}).drop(*gone)
        place = F.struct(*self.order)
        of_range = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), place)), "first": lambda c: F.min_by(c, F.when(c.isNotNull(), place)), "max": F.max, "sum": F.sum}
        ranges = inputs.groupBy(self.key, "range").agg(*(of_range[how](F.col(f"in_{n}")).alias(n) for n, (how, _) in columns.items()))
        earlier = Window.partitionBy(self.key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        first = F.row_number().over(Window.partitionBy(self.key).orderBy("range"))
        carried = ranges.select(self.key, "range", first.alias("nth"), *(_HOW[how](F.col(n)).over(earlier).alias(f"on_{n}") for n, (how, _) in columns.items())).filter("nth > 1").drop("nth")
        out = inputs.withColumns({f"at_{n}": _HOW[how](F.col(f"in_{n}")).over(spot) for n, (how, _) in columns.items()}).join(carried, [self.key, "range"], "left")
        both = {"last": lambda a, b: F.coalesce(a, b), "first": lambda a, b: F.coalesce(b, a), "max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a + b, a, b)}
        values = {n: both[how](F.col(f"at_{n}"), F.col(f"on_{n}")) for n, (how, _) in columns.items()}
        return out.withColumns(values).drop(*gone, *(f"{p}_{n}" for n in columns for p in ("at", "on")))


def _there(v: Column, unknown: bool = False) -> Column:
    t = v.cast("string")
    return v.isNotNull() & (t != "") & (t != "unknown") if unknown else v.isNotNull() & (t != "")


def _told(ok: dict[str, Column]) -> dict[str, tuple[str, Column]]:
    """For each field, told where ``ok``: the last value from a row trusted as much and the first value; and what the event began with."""
    c = F.col
    return {
        f"{p}_{f}": (how, F.when(cond, c(f)))
        for f, here in ok.items()
        for p, how, cond in (("won", "last", here & c("wins")), ("any", "first", here))
    } | {"old": ("first", F.when(c("base"), F.struct(*ok)))}


def merged_rows(ranges: Ranges, now: Column) -> DataFrame:
    """The rows that take part, each with the values of its event afterwards (``e_`` before their names).

    Rows: base (what is known of the event before; one for each event), known (it exists), and the fields of OBSERVED.
    """
    c, run = F.col, ranges.running
    heard_of = F.when(c("base"), c("known")).otherwise(c("status") != "rejected")
    rows = run(ranges.rows, {"made": ("max", heard_of)})
    rows = run(rows, {"made_before": ("max", heard_of)}, before=True).filter("base OR made")
    rows = rows.withColumn("born", ~c("base") & ~F.coalesce("made_before", F.lit(False)))
    rows = run(rows, {"top": ("max", rank(c("organizer_trust")))}, before=True)
    rows = rows.withColumn("wins", c("base") | (rank(c("organizer_trust")) >= c("top"))).withColumn("heard", (c("status") != "rejected") | c("wins"))

    ok = {f: _there(c(f)) for f in FACTS if f != "first_observed_open_at"} | {f: (c("heard") | c("base")) & _there(c(f)) for f in GUARDED}
    ok |= {f: _there(c(f), unknown=True) for f in KNOWN} | {"price_status": (c("heard") | c("base")) & (c("price_status") != "not_stated")}
    new = c("registration_state")
    told, lasting = F.coalesce(new != "unknown", F.lit(False)), F.coalesce(new.isin(*TERMINAL_STATES), F.lit(False))
    rows = run(rows, _told(ok) | {
        "won_state": ("last", F.when(told & c("wins"), new)), "any_state": ("last", F.when(told & (c("wins") | ~lasting), new)), "old_state": ("first", F.when(c("base"), new)),
        "e_concise_summary": ("last", F.when(c("base") | _there(c("concise_summary")), c("concise_summary"))),
        "e_ai_provenance": ("last", F.when(c("base") | (F.size(F.coalesce("ai_provenance", F.create_map().cast("map<string, string>"))) > 0), c("ai_provenance"))),
        "e_organizer_trust": ("last", F.when(c("wins"), c("organizer_trust"))), "e_approval_required": ("max", F.coalesce("approval_required", F.lit(False))),
        "e_reason": ("last", F.when(c("base") | c("heard"), F.struct("reason"))), "e_score": ("max", c("score")),
    })
    rows = rows.withColumns({f"e_{f}": F.coalesce(f"won_{f}", f"any_{f}", f"old.{f}") for f in ok}).drop("old", *(f"{p}_{f}" for f in ok for p in ("won", "any")))
    state = F.coalesce(F.when(c("won_state").isin(*TERMINAL_STATES), c("won_state")).otherwise(c("any_state")), c("old_state"))
    rows = rows.withColumns({"e_registration_state": state, "e_relevance_reason": c("e_reason.reason")}).drop("won_state", "any_state", "old_state", "e_reason")

    rows = run(rows, {"was": ("last", c("e_registration_state"))}, before=True)
    refused = told & ~c("wins") & (lasting | F.coalesce(c("was").isin(*TERMINAL_STATES), F.lit(False)))
    reopened = ~c("base") & ~c("born") & c("was").isin("unknown", "closed") & (c("e_registration_state") == "open")
    seen = c("first_observed_open_at")
    over = ~c("base") & F.coalesce(F.coalesce("e_ends_at", "e_starts_at") < now, F.lit(False))
    says = F.when(over, "expired").when(c("base") | ~(refused | ~c("heard")), c("status"))
    rows = rows.withColumn("says", says)
    rows = run(rows, {
        "won_seen": ("last", F.when(c("wins"), seen)), "any_seen": ("first", F.coalesce(seen, F.when(reopened, c("at")))),
        "firm": ("last", F.when(c("says") != "needs_review", c("says"))), "latest": ("last", c("says")),
    })
    # a review does not demote an eligible event
    status = F.when(c("firm") == "eligible", c("firm")).otherwise(c("latest"))
    return rows.withColumns({"e_first_observed_open_at": F.coalesce("won_seen", "any_seen"), "e_status": status}).drop("won_seen", "any_seen", "firm", "latest", "says", "was")


def stacked(events: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations below what is known of their events, as ``merged_rows`` takes them; ``turn`` is 0 for the latter."""
    c = F.col
    extra = {"canonical_url": "string", "seq": "long", "source_name": "string", "raw_id": "string", "is_explicitly_paid": "boolean"}
    seen = observations.filter("event_key IS NOT NULL").select(c("event_key").cast("string").alias("event_key"), *with_columns(observations, {"observed_at": "timestamp", **extra, **OBSERVED}))
    seen = seen.withColumns({
        "price_status": X.price_status(c("price_text"), c("is_explicitly_paid")), "registration_state": F.coalesce("registration_state", F.lit("unknown")), "status": F.coalesce("status", F.lit("needs_review")),
        "base": F.lit(False), "known": F.lit(False), "source_urls": F.array("source_url"),
    }).withColumnRenamed("observed_at", "at")
    have = events.select(c("event_key").cast("string").alias("event_key"), "canonical_url", *with_columns(events, KEPT)).withColumnsRenamed({"relevance_reason": "reason"})
    blank = {"registration_state": "unknown", "price_status": "not_stated", "organizer_trust": "low", "format": "unknown", "event_type": "unknown"}
    fresh = seen.select("event_key").distinct().join(have.select("event_key"), "event_key", "left_anti").withColumns({k: F.lit(v) for k, v in blank.items()} | {"score": F.lit(0).cast("long")})
    both = seen.unionByName(have.withColumns({"base": F.lit(True), "known": F.lit(True)}), allowMissingColumns=True).unionByName(fresh.withColumns({"base": F.lit(True), "known": F.lit(False)}), allowMissingColumns=True)
    return both.withColumn("turn", F.when(c("base"), 0).otherwise(1))


def merge_observations(events: DataFrame, observations: DataFrame, now: Column, order: tuple[str, ...] = ("observed_at", "seq")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assessed observations, each with ``event_key``, ``observed_at`` and ``seq``, folded into the events in the order given.

    Returns (events, changes, sources). A fact is taken if it is there and the event lacks it or trusts the observation as
    much. A weaker observation neither sets nor clears a terminal state. Evidence that is rejected and weaker fills no gap
    in times, price and eligibility, and what it said is kept with its source as ``unmerged_facts``. An event that is not
    known yet is made by the first observation that is not rejected, with one change ``new_event``; later ones give a
    change for every material field that differs, but for a registration url that leads to the same place.

    Columns that the rows lack are null; a null state is unknown, a null status needs_review, and a row without a key takes
    no part. The rows are stored under ``spark.checkpoint.dir`` once; no group of rows is held, however often an event was seen.
    """
    c = F.col
    both = stacked(events, observations)
    keys = ["at" if k == "observed_at" else k for k in order]
    ranges = Ranges(both, ["turn", *keys])
    rows = merged_rows(ranges, now)

    place, none = F.struct("turn", *keys), F.array().cast("array<string>")
    plain = [f for f in KEPT if f not in (*LISTS, "source_urls")]
    union = lambda f: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(f, none)))))
    last = rows.groupBy("event_key").agg(
        F.max("made").alias("made"), F.max_by(F.struct(*(c(f"e_{f}").cast(KEPT[f]).alias(f) for f in plain)), place).alias("e"),
        F.min_by("canonical_url", F.when(c("canonical_url").isNotNull(), place)).alias("canonical_url"), *(union(f).alias(f) for f in (*LISTS, "source_urls")),
    ).filter("made")
    out = last.select("event_key", "canonical_url", *(c(f"e.{f}") if f in plain else F.filter(f, lambda x: x.isNotNull()).alias(f) if f == "source_urls" else c(f) for f in KEPT))

    before = ranges.running(rows, {"prior": ("last", F.struct(*(c(f"e_{f}").alias(f) for f in MATERIAL_FIELDS)))}, before=True).filter("NOT base")
    change = lambda kind, a, b: F.struct(F.lit(kind).alias("change_type"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"))
    diffs = []
    for f, kind in MATERIAL_FIELDS.items():
        old, new = said(c(f"prior.{f}"), KEPT[f]), said(c(f"e_{f}"), KEPT[f])
        diffs.append(F.when(~old.eqNullSafe(new), change(kind, old, new)))
    told = F.when(c("born"), F.array(change("new_event", F.lit(None), F.lit("qualified")))).otherwise(F.filter(F.array(*diffs), lambda d: d.isNotNull()))
    changes = before.select("event_key", "seq", c("at").alias("observed_at"), F.explode(told).alias("c")).select("event_key", "seq", "observed_at", "c.*")
    changes = changes.filter(~((c("change_type") == "registration_url") & F.coalesce(U.same_destination(c("old_value"), c("new_value")), F.lit(False))))

    kept = F.struct(iso_text(c("starts_at")).alias("starts_at"), iso_text(c("ends_at")).alias("ends_at"), F.nullif("price_text", F.lit("")).alias("price_text"), F.when(c("is_explicitly_paid"), True).alias("is_explicitly_paid"), F.nullif("eligibility_text", F.lit("")).alias("eligibility_text"))
    lost = F.when((c("status") == "rejected") & ~c("wins"), F.nullif(F.to_json(kept), F.lit("{}")))
    row = F.struct("source_name", "raw_id", c("at").alias("observed_at"), "organizer_trust", lost.alias("unmerged_facts"))
    sources = rows.filter("NOT base").groupBy("event_key", "source_url").agg(F.max_by(row, place).alias("s")).select("event_key", "source_url", "s.*")
    return out, changes, sources


def trust_merge(existing: DataFrame, incoming: DataFrame, now: Column, fields: tuple[str, ...] = ("title", "venue")) -> DataFrame:
    """Existing events and incoming observations of the same ``event_key``, merged by (observed_at, seq) where only some fields
    are known: event_key, fields, registration_state, trust, score, status, ends_at. An event that does not exist
    yet begins with its first observation."""
    cols = [*fields, "registration_state", "trust", "score", "status", "ends_at"]
    kinds = {f.name: f.dataType for f in incoming.schema.fields}
    order = Window.partitionBy("event_key").orderBy("observed_at", "seq")
    numbered = incoming.join(existing.select("event_key").distinct().withColumn("there", F.lit(True)), "event_key", "left").withColumn("no", F.row_number().over(order))
    first = F.col("there").isNull() & (F.col("no") == 1)
    begun = existing.select("event_key", *cols).unionByName(numbered.filter(first).select("event_key", *cols)).withColumnRenamed("trust", "organizer_trust").withColumn("canonical_url", F.lit(None).cast("string"))
    out, _, _ = merge_observations(begun, numbered.filter(~first).withColumnRenamed("trust", "organizer_trust"), now)
    return out.withColumnRenamed("organizer_trust", "trust").select(*(F.col(c).cast(kinds[c]).alias(c) for c in ("event_key", *cols)))
