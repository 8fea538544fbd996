"""Events as keyed state: each observation is merged into the state of its own event, and a timer expires it.

A micro-batch costs what its own events cost; nothing else is read or written. The rules are those of ``merge``; tests
hold the two against each other for any split into batches. State is kept by the RocksDB store of Spark, so set
``spark.sql.streaming.stateStore.providerClass`` to ``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftwell.constants import MATERIAL_FIELDS, TERMINAL_STATES, TRUST_RANK
from siftwell.functions import text as X
from siftwell.functions import url as U
from siftwell.functions.time import iso_text
from siftwell.operators.merge import EVENT, FACTS, GUARDED, KEPT, KNOWN, LISTS, OBSERVED, with_columns

#: In state, instants are microseconds and maps are JSON, so no time zone of a Python process matters.
_KINDS = {"timestamp": "long", "map<string, string>": "string"}
STATE = {"canonical_url": "string"} | {f: _KINDS.get(k, k) for f, k in KEPT.items()}
SEEN = {f: _KINDS.get(k, k) for f, k in OBSERVED.items()} | {"canonical_url": "string", "seq": "long", "at": "long"}
OUT = "event_key string, seq long, at long, field string, change_type string, old_value string, new_value string, event struct<" + ", ".join(f"{f}: {k}" for f, k in STATE.items()) + ">"
_INSTANTS = [f for f, k in KEPT.items() if k == "timestamp"]
BLANK = dict.fromkeys(STATE) | {"registration_state": "unknown", "price_status": "not_stated", "organizer_trust": "low", "score": 0, "format": "unknown", "event_type": "unknown", "speakers": [], "topics": [], "source_urls": [], "approval_required": False}


def advance(event: dict | None, x: dict, now: int) -> dict | None:
    """The event after an observation; None where a rejected one would have made it. now: in microseconds."""
    born = event is None
    if born and x["status"] == "rejected":
        return None
    old = event or BLANK
    e = dict(old)
    wins = TRUST_RANK.get(x["organizer_trust"], 0) >= TRUST_RANK.get(old["organizer_trust"], 0)
    heard = wins or x["status"] != "rejected"
    # (fields, values that say nothing)
    for fields, silent in ((FACTS, (None, "")), (GUARDED if heard else (), (None, "")), (KNOWN, (None, "", "unknown")), (("price_status",) if heard else (), (None, "not_stated"))):
        e |= {f: x[f] for f in fields if x[f] not in silent and (wins or old[f] in silent)}
    told = x["registration_state"]
    refused = told != "unknown" and not wins and bool({told, old["registration_state"]} & set(TERMINAL_STATES))
    if told != "unknown" and not refused:
        e["registration_state"] = told
    if not born and old["registration_state"] in ("unknown", "closed") and e["registration_state"] == "open" and e["first_observed_open_at"] is None:
        e["first_observed_open_at"] = x["at"]
    e |= {f: sorted({*(old[f] or ()), *(x[f] or ())}) for f in LISTS} | {f: x[f] for f in ("concise_summary", "ai_provenance") if x[f]}
    e["source_urls"] = sorted({*(old["source_urls"] or ()), *([x["source_url"]] if x["source_url"] is not None else ())})
    e["canonical_url"] = old["canonical_url"] if old["canonical_url"] is not None else x["canonical_url"]
    e["approval_required"] = bool(old["approval_required"] or x["approval_required"])
    e["score"] = max((s for s in (old["score"], x["score"]) if s is not None), default=None)
    if wins:
        e["organizer_trust"] = x["organizer_trust"]
    if heard:
        e["relevance_reason"] = x["reason"]
    end = e["ends_at"] if e["ends_at"] is not None else e["starts_at"]
    if end is not None and end < now:
        e["status"] = "expired"
    elif heard and not refused and not (old["status"] == "eligible" and x["status"] == "needs_review"):
        e["status"] = x["status"]
    return e


class EventProcessor(StatefulProcessor):
    """One event for each key. ``clock``: microseconds that count as now; the time of processing where it is None."""

    def __init__(self, clock: int | None = None):
        self.clock = clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", ", ".join(f"{f} {k}" for f, k in STATE.items()))

    def _load(self) -> dict | None:
        if not self.event.exists():
            return None
        e = dict(zip(STATE, self.event.get(), strict=True))
        return e | {f: None if e[f] is None else list(e[f]) for f in (*LISTS, "source_urls")}

    def _store(self, e: dict, timers) -> None:
        self.event.update(tuple(e[f] for f in STATE))
        if self.clock is not None:
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        end = e["ends_at"] if e["ends_at"] is not None else e["starts_at"]
        if e["status"] == "eligible" and end is not None:
            self.handle.registerTimer(max(end // 1000 + 1, timers.getCurrentProcessingTimeInMs() + 1))

    @staticmethod
    def _change(key: str, seq: int | None, at: int | None, field: str | None, kind: str, old, new) -> Row:
        text = lambda v: None if v is None else str(v)
        return Row(event_key=key, seq=seq, at=at, field=field, change_type=kind, old_value=text(old), new_value=text(new), event=None)

    def _event(self, key: str, e: dict) -> Row:
        return Row(event_key=key, seq=None, at=None, field=None, change_type=None, old_value=None, new_value=None, event=Row(**e))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.clock is None else self.clock
        before = e = self._load()
        for x in sorted((r.asDict() for r in rows), key=lambda r: (r["at"] is not None, r["at"] or 0, r["seq"] or 0)):
            after = advance(e, x, now)
            if after is None:
                continue
            if e is None:
                yield self._change(key[0], x["seq"], x["at"], None, "new_event", None, "qualified")
            else:
                for f, kind in MATERIAL_FIELDS.items():
                    if e[f] != after[f]:
                        yield self._change(key[0], x["seq"], x["at"], f, kind, e[f], after[f])
            e = after
        if e is not None and e != before:
            self._store(e, timerValues)
            yield self._event(key[0], e)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        e, now = self._load(), timerValues.getCurrentProcessingTimeInMs() * 1000
        end = e and (e["ends_at"] if e["ends_at"] is not None else e["starts_at"])
        if e and e["status"] == "eligible" and end is not None and end < now:
            e["status"] = "expired"
            self._store(e, timerValues)
            yield self._change(key[0], None, now, "status", "expired", "eligible", "expired")
            yield self._event(key[0], e)

    def close(self) -> None:
        pass


def event_stream(observations: DataFrame, clock: int | None = None) -> DataFrame:
    """A stream of assessed observations (see ``merge_observations``) -> changes, and each event that they touched as it is
    after the micro-batch: kind (change or event), event_key, seq, observed_at, change_type, old_value, new_value, event.

    A micro-batch is merged by (observed_at, seq); what has been merged stays, so an observation that comes in a later batch
    counts after those of earlier ones, whatever its time. Eligible events expire by a timer, with a change of their own; timers make
    batches of their own, so such a query runs until it is stopped. With a ``clock`` there are no timers. The observations
    of one event in one micro-batch are sorted in memory: bound the batches by the source's options.
    """
    c = F.col
    kinds = {"observed_at": "timestamp", "canonical_url": "string", "seq": "long", "is_explicitly_paid": "boolean"} | OBSERVED
    x = observations.filter("event_key IS NOT NULL").select(c("event_key").cast("string").alias("event_key"), *with_columns(observations, kinds))
    x = x.withColumns({"price_status": X.price_status(c("price_text"), c("is_explicitly_paid")), "registration_state": F.coalesce("registration_state", F.lit("unknown")), "status": F.coalesce("status", F.lit("needs_review"))})
    flat = {f: F.unix_micros(f) for f, k in OBSERVED.items() if k == "timestamp"} | {"ai_provenance": F.when(F.size("ai_provenance") > 0, F.to_json("ai_provenance")), "at": F.unix_micros("observed_at")}
    out = x.withColumns(flat).select("event_key", *SEEN).groupBy("event_key").transformWithState(EventProcessor(clock), OUT, "Update", "ProcessingTime" if clock is None else "None")
    value = lambda v: F.when(c("field").isin(*_INSTANTS), iso_text(F.timestamp_micros(c(v).try_cast("long")))).otherwise(c(v))
    back = {"timestamp": F.timestamp_micros, "map<string, string>": lambda v: F.from_json(v, "map<string, string>")}
    event = F.when(c("event").isNotNull(), F.struct(c("event_key"), *(back.get(EVENT[f], lambda v: v)(c(f"event.{f}")).alias(f) for f in STATE)))
    told = out.select(F.when(c("event").isNull(), "change").otherwise("event").alias("kind"), "event_key", "seq", F.timestamp_micros("at").alias("observed_at"), "change_type", value("old_value").alias("old_value"), value("new_value").alias("new_value"), event.alias("event"))
    return told.filter(~((c("kind") == "change") & (F.coalesce("change_type", F.lit("")) == "registration_url") & F.coalesce(U.same_destination(c("old_value"), c("new_value")), F.lit(False))))
