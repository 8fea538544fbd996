"""Identity of candidates in the order of their arrival.

A candidate meets an event by its identity, else by its url, else by its normalized key, as these are at that moment: events
that earlier candidates of the batch have made count, and keys change with every merge. This is one loop over all rows by
nature; here it is a fixed point of joins. From an assignment of candidates to events follow all versions of all events, by
the running windows of ``merge``; against these each candidate is looked up again, as of its arrival. An assignment that
this gives back is that of the loop: if it is right for all rows before a row, it is right for that row too. Each round settles one
more link of the longest chain of candidates that depend on each other, so a few rounds do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions import url as U
from siftwell.operators.merge import Ranges, merged_rows, stacked


def key_of(c) -> Column:
    """The normalized key of a row whose fields ``c`` gives."""
    return X.normalized_key(*(c(f) for f in ("title", "organizer", "starts_at", "venue", "city")), F.coalesce(c("format"), F.lit("unknown")))


def identities(rows: DataFrame) -> DataFrame:
    """The rows with identity, webinar and normalized_key."""
    url = F.col("canonical_url")
    return rows.withColumns({"identity": U.meetup_identity(url), "webinar": U.webinar_identity(url), "normalized_key": key_of(F.col)})


def _holders(held: DataFrame) -> DataFrame:
    """(normalized_key, start, end, created, event_key): which event has a key from ``start`` on, before ``end``, without the
    spans in which an event made before always has it too, as only the first event of a key counts."""
    c = F.col
    later = F.lead("time").over(Window.partitionBy("event_key").orderBy("time"))
    spans = held.filter(c("prior").isNull() | (c("prior") != c("normalized_key"))).select("normalized_key", c("time").alias("start"), later.alias("end"), F.struct("created", "event_key").alias("who"))
    lasting = lambda x: F.when(c("end").isNull(), x)
    # the first event that has the key for good is summed up without moving rows; it hides nearly all
    top = spans.groupBy("normalized_key").agg(F.min(lasting(F.struct("start", "who"))).alias("top"))
    hidden = F.coalesce((c("top.start") <= c("start")) & (c("top.who") < c("who")), F.lit(False))
    spans = spans.join(top, "normalized_key").filter(~hidden).drop("top")
    so_far = Window.partitionBy("normalized_key").orderBy("start", "who").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("least", F.min(lasting(c("who"))).over(so_far)).filter("least IS NULL OR who <= least")
    return spans.select("normalized_key", "start", "end", "who.created", "who.event_key")


def survivor_rank(c=F.col) -> Column:
    """Orders events that share an identity: eligible ones, then those with more known facts, then by score."""
    facts = [c(f).isNotNull() for f in ("starts_at", "ends_at", "registration_deadline")] + [F.coalesce(c(f), F.lit("")) != "" for f in ("venue", "city", "organizer", "description")]
    facts += [F.coalesce(c(f), F.lit("unknown")) != "unknown" for f in ("format", "registration_state")]
    return F.struct(F.coalesce(c("status") == "eligible", F.lit(False)).alias("eligible"), sum((f.cast("int") for f in facts), F.lit(0)).alias("facts"), F.coalesce(c("score"), F.lit(0)).cast("long").alias("score"))


def versions(events: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """(event_key, time, created, canonical_url, normalized_key, prior, rank): every event as it is from ``time`` on, -1 for events as
    given; prior: its key before. rows: candidates with event_key, in the order of ``seq``."""
    ranges = Ranges(stacked(events, rows), ["turn", "seq"])
    e = lambda f: F.col(f"e_{f}")
    out = merged_rows(ranges, now).filter("made").withColumn("time", F.when(F.col("base"), F.lit(-1)).otherwise(F.col("seq")))
    out = out.select("event_key", "time", "canonical_url", F.col("range"), F.col("turn"), F.col("seq"), key_of(e).alias("normalized_key"), survivor_rank(e).alias("rank"))
    out = ranges.running(out, {"created": ("first", F.col("time")), "url": ("first", F.col("canonical_url"))})
    out = ranges.running(out, {"prior": ("last", F.col("normalized_key"))}, before=True)
    return out.select("event_key", "time", "created", F.col("url").alias("canonical_url"), "normalized_key", "prior", "rank")


def _look_up(rows: DataFrame, held: DataFrame, urls: DataFrame) -> DataFrame:
    """(seq, event_key): the event that each candidate meets as of its arrival. held: ``versions``. urls: its_url,
    its_identity, its_webinar of all urls."""
    c = F.col
    fixed = held.groupBy("event_key").agg(F.min("created").alias("created"), F.first("canonical_url").alias("its_url")).join(urls, "its_url", "left")
    asked = rows.select("seq", "identity", "webinar", "canonical_url", "normalized_key")
    # by identity: the version of the event as of the candidate's arrival ranks it; a query comes before the version of the same time
    pairs = asked.join(fixed.select("event_key", c("its_identity").alias("identity")), "identity").select("seq", "event_key")
    line = held.join(pairs.select("event_key").distinct(), "event_key", "left_semi").select("event_key", "time", F.lit(1).alias("kind"), "rank")
    line = line.unionByName(pairs.select("event_key", c("seq").alias("time"), F.lit(0).alias("kind"), F.lit(None).cast(line.schema["rank"].dataType).alias("rank")))
    ranges = Ranges(line, ["time", "kind"])
    seen = ranges.running(ranges.rows, {"now": ("last", c("rank"))}).filter("kind = 0 AND now IS NOT NULL").select(c("time").alias("seq"), "event_key", "now")
    met = seen.join(fixed.select("event_key", "created"), "event_key").select("seq", F.lit(1).alias("tier"), "now", "created", "event_key")
    none = F.lit(None).cast(line.schema["rank"].dataType).alias("now")
    # by url
    same = asked.join(fixed.select("event_key", "created", c("its_url").alias("canonical_url")), "canonical_url").filter("created < seq")
    met = met.unionByName(same.select("seq", F.lit(2).alias("tier"), none, "created", "event_key"))
    # by key: the first event that has it then
    keyed = asked.join(_holders(held), "normalized_key").filter((c("start") < c("seq")) & (c("end").isNull() | (c("seq") <= c("end"))))
    keyed = keyed.groupBy("seq").agg(F.min(F.struct("created", "event_key")).alias("who"))
    met = met.unionByName(keyed.select("seq", F.lit(3).alias("tier"), none, "who.created", "who.event_key"))
    best = Window.partitionBy("seq").orderBy("tier", c("now").desc(), "created", "event_key")
    met = met.withColumn("no", F.row_number().over(best)).filter("no = 1").select("seq", "tier", "event_key")
    met = met.join(fixed.select("event_key", "its_identity", "its_webinar"), "event_key").join(asked.select("seq", "identity", "webinar"), "seq")
    apart = lambda n: F.coalesce(c(f"its_{n}") != c(n), F.lit(False))
    return met.filter(~((c("tier") == 3) & (apart("identity") | apart("webinar")))).select("seq", "event_key")


def resolve_in_order(rows: DataFrame, events: DataFrame, now: Column, guess: DataFrame | None = None) -> DataFrame:
    """(seq, event_key) for assessed candidates in the order of ``seq``, which is unique; without an event where a rejected
    candidate meets none.

    rows: seq, canonical_url, identity, webinar, normalized_key (see ``identities``), status, organizer_trust and facts. A candidate that meets
    no event makes one, named by its identity or else its url. Of several events of an identity the best of that moment
    counts; the first event of a key counts, unless it has another identity or is another webinar. guess: where to begin.
    """
    c = F.col
    own = F.coalesce("identity", "canonical_url")
    # the identity of a url is read once, not in each round
    rows = rows.withColumn("own", own).checkpoint()
    told = rows.select(c("canonical_url").alias("its_url"), c("identity").alias("its_identity"), c("webinar").alias("its_webinar"))
    known = events.select(c("canonical_url").alias("its_url"), U.meetup_identity(c("canonical_url")).alias("its_identity"), U.webinar_identity(c("canonical_url")).alias("its_webinar"))
    urls = told.unionByName(known).dropna(subset=["its_url"]).dropDuplicates(["its_url"]).checkpoint()
    assigned = (rows.select("seq", own.alias("event_key")) if guess is None else guess.select("seq", "event_key")).checkpoint()
    while True:
        held = versions(events, rows.join(assigned, "seq"), now).checkpoint()
        found = rows.select("seq", "own", "status").join(_look_up(rows, held, urls), "seq", "left")
        again = found.select("seq", F.coalesce("event_key", F.when(c("status") != "rejected", c("own"))).alias("event_key")).checkpoint()
        if again.join(assigned.withColumnRenamed("event_key", "before"), "seq").filter(~c("event_key").eqNullSafe(c("before"))).isEmpty():
            return again
        assigned = again
