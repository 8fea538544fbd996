"""Merging, identity, policy and the batch flow against a model that takes one observation after another."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from siftwell.constants import MATERIAL_FIELDS
from siftwell.operators import ingest as G
from siftwell.operators.folds import identity_resolve, organizer_match

NOW = dt.datetime(2026, 6, 1)
RANK = {"low": 1, "medium": 2, "high": 3}
TERMINAL = ("cancelled", "sold_out", "closed", "postponed")
KINDS = G.OBSERVED | {"event_key": "string", "canonical_url": "string", "observed_at": "timestamp", "seq": "long", "source_name": "string", "raw_id": "string", "is_explicitly_paid": "boolean"}


def frame(spark, rows, kinds):
    kinds = {k: v for k, v in kinds.items() if k != "price_status" or any("price_status" in r for r in rows)}
    return spark.createDataFrame([tuple(r.get(k) for k in kinds) for r in rows], ", ".join(f"{k} {v}" for k, v in kinds.items()))


def text(v):
    return v.isoformat() + "+00:00" if isinstance(v, dt.datetime) else None if v is None else str(v)


def some(rng, key, seq):
    day = lambda *d: rng.choice([None, *(dt.datetime(2026, m, n) for m, n in d)])
    return {
        "event_key": key, "canonical_url": f"https://a.org/{key}", "seq": seq, "observed_at": dt.datetime(2026, 5, rng.randint(1, 4)), "source_name": "s", "raw_id": str(seq), "source_url": rng.choice(["https://x.org", "https://y.org"]),
        "title": rng.choice(["T", "U"]), "organizer": rng.choice([None, "", "O"]), "description": rng.choice([None, "d"]), "venue": rng.choice([None, "v", "w"]), "city": None, "country": rng.choice([None, "IN"]),
        "registration_url": rng.choice([None, "https://r.org/1", "https://r.org/1?utm_source=z", "https://r.org/2"]), "registration_deadline": day((7, 1), (7, 2)), "registration_opened_at": day((5, 1)), "first_observed_open_at": None,
        "starts_at": day((7, 3), (7, 4), (5, 20)), "ends_at": day((7, 5)), "price_text": rng.choice([None, "INR 5", "Free"]), "eligibility_text": rng.choice([None, "all"]), "is_explicitly_paid": rng.choice([False, None, True]),
        "format": rng.choice(["unknown", "online", "hybrid"]), "event_type": rng.choice(["unknown", "talk"]), "organizer_trust": rng.choice(list(RANK)), "score": rng.randint(0, 15), "status": rng.choice(["eligible", "needs_review", "rejected"]),
        "approval_required": rng.choice([True, False]), "concise_summary": rng.choice([None, "sum"]), "ai_provenance": rng.choice([None, {"provider": "p"}]), "speakers": rng.choice([[], ["b"], ["a"]]), "topics": rng.choice([[], ["t"]]),
        "registration_state": rng.choice(["unknown", "open", "waitlist", *TERMINAL]), "reason": rng.choice(["r1", "r2"]),
    }


def price(x):
    return "paid" if x["is_explicitly_paid"] or x["price_text"] == "INR 5" else "free" if x["price_text"] == "Free" else "not_stated"


def model(events, observed):
    """One after the other, as a loop over rows would."""
    events, changes, sources = {k: dict(e) for k, e in events.items()}, [], {}
    for x in sorted(observed, key=lambda x: (x["observed_at"], x["seq"])):
        e = events.get(x["event_key"])
        born = e is None
        if born:
            if x["status"] == "rejected":
                continue
            e = events[x["event_key"]] = dict.fromkeys(G.EVENT) | {"event_key": x["event_key"], "canonical_url": x["canonical_url"], "registration_state": "unknown", "price_status": "not_stated", "organizer_trust": "low", "score": 0, "format": "unknown", "event_type": "unknown"}
        old = dict(e)
        wins = RANK[x["organizer_trust"]] >= RANK[e["organizer_trust"]]
        heard = wins or x["status"] != "rejected"
        names = [*G.FACTS, *G.KNOWN, *(G.GUARDED if heard else ())]
        for f in names:
            gone = (None, "") + (("unknown",) if f in G.KNOWN else ())
            if x[f] not in gone and (e[f] in gone or wins):
                e[f] = x[f]
        conflict = x["registration_state"] != "unknown" and not wins and (x["registration_state"] in TERMINAL or e["registration_state"] in TERMINAL)
        if x["registration_state"] != "unknown" and not conflict:
            e["registration_state"] = x["registration_state"]
        if not born and old["registration_state"] in ("unknown", "closed") and e["registration_state"] == "open" and e["first_observed_open_at"] is None:
            e["first_observed_open_at"] = x["observed_at"]
        if heard and price(x) != "not_stated" and (e["price_status"] == "not_stated" or wins):
            e["price_status"] = price(x)
        for f in G.LISTS:
            e[f] = sorted({*(e[f] or []), *x[f]})
        e["source_urls"] = sorted({*(e["source_urls"] or []), x["source_url"]})
        for f in ("concise_summary", "ai_provenance"):
            e[f] = x[f] or e[f]
        e["organizer_trust"] = max(e["organizer_trust"], x["organizer_trust"], key=RANK.get)
        e["approval_required"] = bool(e["approval_required"] or x["approval_required"])
        e["relevance_reason"] = x["reason"] if heard else e["relevance_reason"]
        e["score"] = max(e["score"], x["score"])
        end = e["ends_at"] or e["starts_at"]
        if end and end < NOW:
            e["status"] = "expired"
        elif not conflict and heard and not (not born and e["status"] == "eligible" and x["status"] == "needs_review"):
            e["status"] = x["status"]
        key = (x["event_key"], x["seq"])
        if born:
            changes.append((*key, "new_event", None, "qualified"))
        else:
            strip = lambda u: u and u.split("?")[0]
            changes += [(*key, kind, text(old[f]), text(e[f])) for f, kind in MATERIAL_FIELDS.items() if text(old[f]) != text(e[f]) and not (f == "registration_url" and old[f] and strip(old[f]) == strip(e[f]))]
        lost = {} if heard else {f: v for f, v in (("starts_at", text(x["starts_at"])), ("ends_at", text(x["ends_at"])), ("price_text", x["price_text"]), ("is_explicitly_paid", x["is_explicitly_paid"] or None), ("eligibility_text", x["eligibility_text"])) if v}
        sources[x["event_key"], x["source_url"]] = (x["raw_id"], x["observed_at"], lost)
    return events, changes, sources


def test_observations_against_a_loop(spark):
    rng = random.Random(3)
    known = [model({}, [some(rng, f"k{i}", 0) | {"status": "eligible"}])[0][f"k{i}"] for i in range(20)]
    seen = [some(rng, f"k{rng.randrange(40)}", i + 1) for i in range(500)]
    seen += [x | {"seq": x["seq"] + 1000, "observed_at": x["observed_at"] + dt.timedelta(days=rng.choice([0, 0, 9]))} for x in seen[:60]]  # seen again
    events, changes, sources = G.merge_observations(frame(spark, known, G.EVENT), frame(spark, seen, KINDS), F.lit(NOW))
    want = model({e["event_key"]: e for e in known}, seen)
    got = {r.event_key: r.asDict() for r in events.collect()}
    assert got.keys() == want[0].keys()
    for k, e in want[0].items():
        assert got[k] == {f: e[f] for f in G.EVENT}, k
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r) for r in changes.select("event_key", "seq", "change_type", "old_value", "new_value").collect()) == order(want[1])
    assert {(r.event_key, r.source_url): (r.raw_id, r.observed_at, json.loads(r.unmerged_facts or "{}")) for r in sources.collect()} == want[2]


def test_no_rows(spark):
    none, nothing = frame(spark, [], G.EVENT), frame(spark, [], KINDS)
    assert [d.count() for d in G.merge_observations(none, nothing, F.lit(NOW))] == [0, 0, 0]
    one = model({}, [some(random.Random(1), "k", 0) | {"status": "eligible"}])[0]["k"]
    events, changes, _ = G.merge_observations(frame(spark, [one], G.EVENT), nothing, F.lit(NOW))
    assert (events.first().asDict(), changes.count()) == ({f: one[f] for f in G.EVENT}, 0)


def test_survivors_and_vetoes(spark):
    kinds = "id long, identity string, webinar string, canonical_url string, normalized_key string, rank long"
    known = spark.createDataFrame([(1, "m", None, "u1", "k1", 2), (2, "m", None, "u2", "k2", 5), (3, "m", None, "u3", "k3", 5), (4, None, "w4", "u4", "k4", 0), (5, None, None, "u5", "k4", 0)], kinds)
    seen = spark.createDataFrame([(1, "m", None, "u1", "x"), (2, None, None, "u1", "k9"), (3, "n", None, "z", "k1"), (4, None, "w9", "z", "k4"), (5, None, "w4", "z", "k4"), (6, None, None, None, None), (7, None, None, "z", "k1")], "seq long, identity string, webinar string, canonical_url string, normalized_key string")
    assert {r.seq: (r.event_id, r.tier) for r in identity_resolve(seen, known).collect()} == {1: (2, 1), 2: (1, 2), 3: (None, None), 4: (None, None), 5: (4, 3), 6: (None, None), 7: (1, 3)}


CONFIG = "position int, name string, trust string, online_allowed boolean"


def registry(spark):
    o = spark.createDataFrame([(1, "Big Club", "high", True), (2, "Net", "medium", True)], CONFIG)
    return o, o.select("position", F.col("name").alias("alias")), spark.createDataFrame([(1, "club.org")], "position int, domain string"), spark.createDataFrame([(2, "net_feed")], "position int, source_name string")


def test_organizers(spark):
    o, aliases, domains, profiles = registry(spark)
    rows = [(1, "the BIG CLUB", "www.club.org", "x"), (2, "Net", "a.org", "net_feed"), (3, "Net", "a.org", "x"), (4, None, "a.org", "net_feed"), (5, "Net", "club.org", "x"), (6, "Network", "notclub.org", None), (7, None, None, None)]
    got = organizer_match(spark.createDataFrame(rows, "id long, organizer string, host string, source_name string"), o, aliases, domains, profiles)
    assert {r.id: tuple(r)[1:] for r in got.collect()} == {
        1: ("Big Club", "high", True, True), 2: ("Net", "medium", True, True), 3: ("Net", "low", False, False), 4: ("Net", "low", False, False),
        5: ("Big Club", "high", True, True), 6: (None, "low", False, False), 7: (None, "low", False, False),
    }


def candidate(i, **more):
    base = {f: None for f in G.FACTS | G.GUARDED | G.LISTS} | {"id": i, "canonical_url": f"https://a.org/{i}", "source_url": "https://a.org", "source_name": "s", "raw_id": None, "observed_at": dt.datetime(2026, 5, 30), "is_explicitly_paid": False}
    return base | {"title": "Python evening", "starts_at": dt.datetime(2026, 6, 10), "city": "Bengaluru", "format": "in_person", "event_type": "talk", "registration_state": "open", "organizer": f"O{i}"} | more


CANDIDATE = G.FACTS | G.GUARDED | G.KNOWN | G.LISTS | {"registration_state": "string", "id": "long", "canonical_url": "string", "source_url": "string", "source_name": "string", "raw_id": "string", "observed_at": "timestamp", "is_explicitly_paid": "boolean"}


def test_flow_with_a_classifier(spark):
    o, aliases, domains, profiles = registry(spark)
    asked = []

    def classify(rows):
        asked.append(rows)
        good = '```json\n{"is_technical": true, "compatible_eligibility": true, "event_type": "meetup", "topics": ["ml"], "concise_summary": "s", "rationale": "r"}\n```'
        bad = '{"is_technical": "yes", "compatible_eligibility": true, "concise_summary": "s", "rationale": "r"}'
        no = '{"is_technical": false, "compatible_eligibility": true, "concise_summary": "s", "rationale": "r"}'
        return rows.select("id", F.explode(F.array(*(F.struct(F.lit(p).alias("place"), F.lit(n).alias("provider"), F.lit("m").alias("model"), F.when(F.col("id") == 2, a).when(F.col("id") == 3, b).otherwise(c).alias("content")) for p, n, a, b, c in ((0, "one", bad, no, bad), (1, "two", good, good, "{cut")))))).select("id", "col.*")

    rows = [
        candidate(1), candidate(2, title="Evening", event_type="unknown"), candidate(3, title="Evening"), candidate(4, title="Evening"), candidate(5, price_text="INR 500"), candidate(6, registration_state="closed", canonical_url="https://old.org/e"),
        candidate(7, city=None, format="online", organizer="Big Club", canonical_url="https://club.org/7"), candidate(8, city=None, format="online", organizer="Big Club"), candidate(9, canonical_url="https://a.org/1"), candidate(10, organizer="O1", eligibility_text="Subject to approval"),
    ]
    old = dict.fromkeys(G.EVENT) | {"event_key": "old", "canonical_url": "https://old.org/e", "title": "Old", "format": "unknown", "event_type": "talk", "registration_state": "open", "price_status": "not_stated", "organizer_trust": "high", "score": 3, "status": "eligible"}
    got = G.ingest(frame(spark, rows, CANDIDATE), frame(spark, [old], G.EVENT), F.lit(NOW), o, aliases, domains, profiles=profiles, topics=("python",), classify=classify)
    assessed = {r.id: (r.status, r.score, r.reason) for r in got.assessed.collect()}
    fit = "Technical event matching location and time policy"
    assert assessed == {
        1: ("eligible", 9, fit), 2: ("eligible", 9, fit), 3: ("rejected", 0, "AI classification rejected ambiguous candidate"), 4: ("needs_review", 0, "Ambiguous candidate; AI classification unavailable"), 5: ("rejected", 0, "Explicitly paid admission"),
        6: ("rejected", 0, "Registration is closed"), 7: ("eligible", 10, fit), 8: ("rejected", 0, "Not Bengaluru or trusted global online"), 9: ("eligible", 9, fit), 10: ("eligible", 9, fit),
    }
    assert sorted(r.id for r in asked[0].collect()) == [2, 3, 4]
    assert set(json.loads(asked[0].first().record)) == set(G.PROMPT)
    events = {r.event_key: r for r in got.events.collect()}
    # candidate 9 gives the first event its organizer, so candidate 10 has the key that this event had before, and is one of its own
    assert set(events) == {"old", "https://a.org/1", "https://a.org/2", "https://a.org/4", "https://club.org/7", "https://a.org/10"}
    assert (events["https://a.org/2"].event_type, events["https://a.org/2"].topics, events["https://a.org/2"].ai_provenance) == ("meetup", ["ml"], {"provider": "two", "model": "m", "rationale": "r"})
    assert events["https://a.org/10"].approval_required and (events["https://a.org/1"].organizer, events["https://a.org/1"].approval_required) == ("O9", False)
    assert (events["old"].registration_state, events["old"].status, events["old"].title) == ("open", "eligible", "Old")  # weaker
    assert sorted(r.event_key for r in got.changes.filter("change_type = 'new_event'").collect()) == sorted(set(events) - {"old"})
    unmerged = got.sources.filter("event_key = 'old'").first().unmerged_facts
    assert json.loads(unmerged) == {"starts_at": "2026-06-10T00:00:00+00:00"}


def test_expiry(spark):
    rows = [("a", "eligible", dt.datetime(2026, 5, 1), None), ("b", "eligible", dt.datetime(2026, 5, 1), dt.datetime(2026, 7, 1)), ("c", "rejected", dt.datetime(2026, 5, 1), None), ("d", "eligible", None, None)]
    events, changes = G.expire(spark.createDataFrame(rows, "event_key string, status string, starts_at timestamp, ends_at timestamp"), F.lit(NOW))
    assert {r.event_key: r.status for r in events.collect()} == {"a": "expired", "b": "eligible", "c": "rejected", "d": "eligible"}
    assert [(r.event_key, r.change_type, r.old_value, r.new_value) for r in changes.collect()] == [("a", "expired", "eligible", "expired")]


def test_structured_data_come_first(spark):
    from siftwell.operators.folds import dedupe_fold

    at = lambda n: dt.datetime(2026, 6, n)
    kinds = "identity string, seq int, title string, organizer string, venue string, city string, registration_url string, format string, event_type string, registration_state string, registration_deadline timestamp, registration_opened_at timestamp, starts_at timestamp, ends_at timestamp, is_explicitly_paid boolean, description string, price_text string, eligibility_text string, speakers array<string>, topics array<string>, source_url string, country string, first_observed_open_at timestamp, schema_format string, schema_starts_at timestamp, schema_ends_at timestamp"
    row = lambda i, form, start, end, source, country, seen, *schema: ("e", i, "t", None, None, None, None, form, "unknown", "open", None, None, start, end, False, None, None, None, [], [], source, country, seen, *schema)
    rows = [row(1, "online", at(1), at(2), "s1", "IN", at(9), "online", at(1), None), row(2, "hybrid", at(3), at(4), "s2", "", at(8), "unknown", None, None)]
    r = dedupe_fold(spark.createDataFrame(rows, kinds)).first()
    assert (r.format, r.starts_at, r.ends_at, r.source_url, r.country, r.first_observed_open_at) == ("online", at(1), at(4), "s2", "IN", at(8))
