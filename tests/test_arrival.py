"""Candidates in the order of arrival against a loop that finds, merges and makes events one after another; hot events."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.operators import ingest as G
from siftwell.operators.arrival import _holders, identities, resolve_in_order
from siftwell.operators.merge import Ranges, merge_observations
from test_ingest import KINDS, NOW, frame, model, some


@pytest.fixture
def ranges(spark):
    """Small ranges, so that one event lies in several of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_events_in_several_ranges(spark, ranges):
    rng = random.Random(13)
    known = model({}, [some(rng, "hot", 0) | {"status": "eligible"}])[0]["hot"]
    seen = [some(rng, rng.choice(["hot", "hot", "warm", "cold"]), i + 1) for i in range(400)]
    df = frame(spark, seen, KINDS)
    assert Ranges(df.select("event_key", "observed_at", "seq"), ["observed_at", "seq"]).split
    events, changes, sources = merge_observations(frame(spark, [known], G.EVENT), df, F.lit(NOW))
    want = model({"hot": known}, seen)
    assert {r.event_key: r.asDict() for r in events.collect()} == {k: {f: e[f] for f in G.EVENT} for k, e in want[0].items()}
    told = [tuple(r) for r in changes.select("event_key", "seq", "change_type", "old_value", "new_value").collect()]
    assert sorted(told, key=str) == sorted(want[1], key=str)
    assert {(r.event_key, r.source_url): (r.raw_id, r.observed_at) for r in sources.collect()} == {k: v[:2] for k, v in want[2].items()}


def test_an_event_with_very_many_observations(spark, ranges):
    rng = random.Random(5)
    seen = [some(rng, "hot", i) | {"observed_at": dt.datetime(2026, 5, 1) + dt.timedelta(seconds=i)} for i in range(20_000)]
    events, changes, _ = merge_observations(frame(spark, [], G.EVENT), frame(spark, seen, KINDS), F.lit(NOW))
    want = model({}, seen)
    assert events.first().asDict() == {f: want[0]["hot"][f] for f in G.EVENT}
    assert changes.count() == len(want[1])


def key(e):
    norm = lambda x: re.sub("[^a-z0-9]+", "", (x or "").lower())
    return ":".join((norm(e["title"]), norm(e["organizer"]), e["starts_at"].strftime("%Y%m%d%H%M") if e["starts_at"] else "unknown", norm(e["venue"] or e["city"]), e["format"] or "unknown"))


def identity(url):
    m = re.match(r"https://www\.meetup\.com/g/events/\d+", url)
    return m and m.group()


def survivor(e):
    facts = sum(bool(e[f]) for f in ("starts_at", "ends_at", "registration_deadline", "venue", "city", "organizer", "description")) + sum(e[f] != "unknown" for f in ("format", "registration_state"))
    return e["status"] == "eligible", facts, e["score"]


def loop(known: list[dict], rows: list[dict]) -> tuple[dict, dict, list]:
    """Find, then merge or make, one candidate after another. Events keep the order in which they were made."""
    events, told, met = {e["event_key"]: dict(e) for e in sorted(known, key=lambda e: e["event_key"])}, [], {}
    for x in sorted(rows, key=lambda r: r["seq"]):
        own, hit = identity(x["canonical_url"]), None
        same = [e for e in events.values() if own and identity(e["canonical_url"]) == own]
        if same:
            hit = max(same, key=survivor)["event_key"]
        if hit is None:
            hit = next((k for k, e in events.items() if e["canonical_url"] == x["canonical_url"]), None)
        if hit is None:
            hit = next((k for k, e in events.items() if key(e) == key(x)), None)
            if hit and own and (identity(events[hit]["canonical_url"]) or own) != own:
                hit = None
        hit = hit or (None if x["status"] == "rejected" else own or x["canonical_url"])
        met[x["seq"]] = hit
        if hit:
            events, changes, _ = model(events, [x | {"event_key": hit}])
            told += changes
    return events, met, told


def arrivals(rng, n):
    urls = [f"https://a.org/{i}" for i in range(12)] + [f"https://www.meetup.com/g/events/{i}{tail}" for i in range(4) for tail in ("", "/?recid=1")]
    out = []
    for i in range(n):
        x = some(rng, None, i) | {"canonical_url": rng.choice(urls), "title": rng.choice(["Talk A", "Talk B", "Talk-C!"]), "organizer": rng.choice([None, "Club"]), "venue": rng.choice([None, "Hall"]), "starts_at": rng.choice([None, dt.datetime(2026, 7, 3, 9)])}
        out.append(x | {"format": rng.choice(["unknown", "online"]), "city": rng.choice([None, "Hall"])})
    return out


@pytest.mark.parametrize("seed", [1])
def test_batches_in_any_order(spark, seed):
    rng = random.Random(seed)
    first = arrivals(rng, 40)
    known = list(loop([], first)[0].values())
    twin = dict(known[0]) | {"event_key": "zz twin", "canonical_url": "https://www.meetup.com/g/events/1"}  # two events of one identity
    known = [*known, twin]
    batch = arrivals(rng, 60)
    for i, x in enumerate(rng.sample(batch, len(batch))):
        x["seq"] = i
    df = identities(frame(spark, batch, KINDS).drop("event_key"))
    events = frame(spark, known, G.EVENT)
    found = {r.seq: r.event_key for r in resolve_in_order(df, events, F.lit(NOW)).collect()}
    want = loop(known, batch)
    assert found == want[1]
    merged, changes, _ = merge_observations(events, df.join(spark.createDataFrame(list(found.items()), "seq long, event_key string"), "seq"), F.lit(NOW), ("seq",))
    assert {r.event_key: r.asDict() for r in merged.collect()} == {k: {f: e[f] for f in G.EVENT} for k, e in want[0].items()}
    assert sorted((tuple(r) for r in changes.select("event_key", "seq", "change_type", "old_value", "new_value").collect()), key=str) == sorted(want[2], key=str)


def test_a_chain_is_one_event(spark):
    """The second row gives the first event its title, and the third meets it by that."""
    base = some(random.Random(1), None, 0) | {"organizer": "Club", "venue": "Hall", "city": None, "starts_at": dt.datetime(2026, 7, 3), "format": "online", "organizer_trust": "low", "status": "eligible"}
    rows = [base | {"seq": i, "canonical_url": f"https://a.org/{u}", "title": t} for i, (t, u) in enumerate([("Talk A", 1), ("Talk B", 1), ("Talk B", 2), ("Talk A", 3)])]
    df = identities(frame(spark, rows, KINDS).drop("event_key"))
    got = {r.seq: r.event_key for r in resolve_in_order(df, frame(spark, [], G.EVENT), F.lit(NOW)).collect()}
    assert got == {0: "https://a.org/1", 1: "https://a.org/1", 2: "https://a.org/1", 3: "https://a.org/3"}
    assert resolve_in_order(df.limit(0), frame(spark, [], G.EVENT), F.lit(NOW)).count() == 0


def test_one_holder_of_a_key_that_all_events_have(spark):
    """Candidates meet only events that can be the first with their key, not all that ever had it."""
    rows = [(f"e{i}", i, i, "u", "k", None, 0) for i in range(50)] + [("e0", 60, 0, "u", "l", "k", 0)]
    held = spark.createDataFrame(rows, "event_key string, time long, created long, canonical_url string, normalized_key string, prior string, rank int")
    spans = sorted(tuple(r) for r in _holders(held).collect())
    assert spans == [("k", 0, 60, 0, "e0"), ("k", 1, None, 1, "e1"), ("l", 60, None, 0, "e0")]


def test_small_events_are_not_cut(spark, ranges):
    df = spark.range(4000).select((F.col("id") % 40).cast("string").alias("event_key"), F.col("id").alias("seq"))
    assert not Ranges(df, ["seq"]).split
    assert Ranges(df.unionByName(df.select(F.lit("7").alias("event_key"), "seq")), ["seq"]).split
