"""Pages to typed candidates, and from there to events."""

from __future__ import annotations

import datetime as dt
import json

from dateutil.parser import isoparse
from pyspark.sql import functions as F

from siftwell.functions.time import iso_parse
from siftwell.operators import ingest
from siftwell.sources import extract as E

SEEN = dt.datetime(2026, 6, 1)
LD = {
    "@graph": [
        {
            "@type": "Event", "@id": "e1", "name": " Python  night ", "url": "/e/1", "description": "A talk", "startDate": "2026-06-10T18:30", "endDate": "2026-06-10", "location": {"name": "Hall", "address": {"addressLocality": "Bengaluru", "addressCountry": "IN"}},
            "offers": [{"price": 0, "priceCurrency": "INR", "url": "/buy"}, {"price": 499.0, "priceCurrency": "INR", "availability": "https://schema.org/InStock", "validFrom": "2026-05-01"}, {"price": 0, "priceCurrency": "INR"}],
            "eventAttendanceMode": "https://schema.org/OfflineEventAttendanceMode", "performer": [{"name": "Ann"}, "Bo"], "keywords": "x", "topics": ["python", 3], "organizer": {"name": "Club"},
        },
        {"@type": "Person", "name": "Nobody"}, {"name": "No time", "start": "soon"}, {"title": "Local", "local_date": "2026-07-01", "local_time": "10:00", "is_online": True, "fee": 10.0, "isRegistrationOpen": True, "link": "https://b.org/l"},
    ]
}
CARD = """<div class="x hackathon-card" data-start="2026-08-01" data-price="Free" data-registration-state="closed" data-city="Pune" data-venue="Lab"><h3>Build</h3><a href="/h">go</a></div>
<div class="hackathon-card"><h3>No link</h3></div><article><h2>Not a card here</h2><a href="/n">x</a></article>"""
SEMANTIC = """<title>Site</title><h1>Go meetup</h1><dl><dt>Date &amp; time:</dt><dd>11/10/2026 6:00 PM</dd><dt>Ends</dt><dd>October 2026</dd><dt>Venue</dt><dd>Loft, Bangalore</dd><dt>Hosted by</dt><dd>Gophers</dd>
<dt>Registration</dt><dd>Waitlist only</dd><dt>Apply by</dt><dd>1 Oct 2026</dd><dt>Eligibility</dt><dd>Students only</dd><dt>Mode</dt><dd>Hybrid</dd><dt>Speaker</dt><dd>Cy</dd></dl><p>Free of cost</p><a href="/r">Register now</a>"""
HEAD = """<meta property="og:title" content=" Only  a head "><meta property="og:description" content="about a workshop"><link rel="canonical" href="/c"><p>Sold out</p>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, *r, "feed", SEEN) for i, r in enumerate(rows)], "page_id long, html string, url string, platform string, source_name string, observed_at timestamp")


def script(x):
    return f'<script type="application/ld+json">{json.dumps(x)}</script>'


def test_all_fields_of_all_kinds(spark):
    df = pages(spark, [(script(LD), "https://a.org/p", None), (CARD, "https://d.org/", "devfolio"), (SEMANTIC, "https://g.org/go", None), (HEAD, "https://h.org/x", None), (None, "https://n.org", None), ("", None, None)])
    got = {r.title: r for r in E.candidates(df).collect()}
    assert set(got) == {"Python night", "Local", "Build", "Go meetup", "Only a head"}
    a = got["Python night"]
    assert (a.canonical_url, a.registration_url, a.source_url, a.raw_id) == ("https://a.org/e/1", "https://a.org/buy", "https://a.org/p", "e1")
    assert (a.starts_at, a.ends_at, a.registration_opened_at) == (dt.datetime(2026, 6, 10, 13), dt.datetime(2026, 6, 9, 18, 30), dt.datetime(2026, 4, 30, 18, 30))
    assert (a.venue, a.city, a.country, a.organizer, a.price_text, a.is_explicitly_paid) == ("Hall", "Bengaluru", "IN", "Club", "INR 0; INR 499", True)
    assert (a.format, a.event_type, a.registration_state, a.speakers, a.topics) == ("in_person", "talk", "open", ["Ann", "Bo"], ["python"])
    b = got["Local"]
    assert (b.canonical_url, b.starts_at, b.price_text, b.is_explicitly_paid, b.registration_state, b.format) == ("https://b.org/l", dt.datetime(2026, 7, 1, 4, 30), "10", True, "open", "online")
    c = got["Build"]
    assert (c.canonical_url, c.starts_at, c.price_text, c.registration_state, c.venue, c.city) == ("https://d.org/h", dt.datetime(2026, 7, 31, 18, 30), "Free", "closed", "Lab", "Pune")
    d = got["Go meetup"]
    assert (d.starts_at, d.ends_at, d.registration_deadline, d.venue, d.city, d.organizer) == (dt.datetime(2026, 10, 11, 12, 30), None, dt.datetime(2026, 9, 30, 18, 30), "Loft, Bangalore", "Bengaluru", "Gophers")
    assert (d.registration_state, d.format, d.eligibility_text, d.price_text, d.registration_url, d.speakers, d.event_type) == ("waitlist", "hybrid", "Students only", "Free", "https://g.org/r", ["Cy"], "meetup")
    e = got["Only a head"]
    assert (e.canonical_url, e.description, e.event_type, e.registration_state, e.format, e.starts_at) == ("https://h.org/c", "about a workshop", "workshop", "sold_out", "unknown", None)


def test_listing_and_detail_are_one_candidate(spark):
    listing = script([{"@type": "Event", "name": "T", "url": "https://a.org/e?utm_source=x", "startDate": "2026-06-10", "eventAttendanceMode": "OnlineEventAttendanceMode"}])
    detail = script({"@type": "Event", "name": "T two", "url": "https://a.org/e", "startDate": "2026-06-10T10:00Z"}) + "<h1>T two</h1><dl><dt>Date</dt><dd>12 June 2026</dd><dt>Venue</dt><dd>Hall</dd></dl>"
    rows = E.candidates(pages(spark, [(listing, "https://a.org/", None), (detail, "https://a.org/e", None), (listing, "https://a.org/", None)])).collect()
    assert len(rows) == 1 and (rows[0].title, rows[0].venue, rows[0].format, rows[0].starts_at) == ("T", "Hall", "online", dt.datetime(2026, 6, 10, 10))


def test_pages_reach_the_events(spark):
    found = E.candidates(pages(spark, [(script(LD), "https://a.org/p", None), (SEMANTIC, "https://g.org/go", None)]))
    orgs = spark.createDataFrame([(1, "Club", "high", True)], "position int, name string, trust string, online_allowed boolean")
    out = ingest.ingest(found, spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ingest.EVENT.items())), F.lit(SEEN).cast("timestamp"), orgs, orgs.select("position", F.col("name").alias("alias")), spark.createDataFrame([(1, "a.org")], "position int, domain string"), topics=("python",))
    assert {r.title: (r.status, r.reason) for r in out.assessed.select("title", "status", "reason").collect()} == {
        "Python night": ("rejected", "Explicitly paid admission"), "Local": ("rejected", "Explicitly paid admission"), "Go meetup": ("rejected", "Explicitly incompatible eligibility"),
    }


def test_iso_forms_as_a_parser_reads_them(spark):
    texts = ["2026", "2026-10", "20261010", "2026-10-10", "2026-W01", "2020-W53-7", "2026W411", "2026-001", "2024366", "2026366", "2026-10-10 10", "2026-10-10T1030", "20261010T103059.5", "2026-10-10T10:30:59.123456789Z", "2026-10-10T24:00", "2026-10-10t10:30z", "2026-10-10T10:30+0530", "2026-10-10T10:30-08", "2026-10-10T10:00Z", "2026-10-10T10:00+01:00", "2026-10-10T23:59:59+14:00", "2026-13-01", "2026-10-10T10:60", "soon", "", "2026-10-1"]

    def want(t):
        try:
            w = isoparse(t)
        except ValueError:
            return None
        return (w if w.tzinfo else w.replace(tzinfo=dt.UTC)).astimezone(dt.UTC).replace(tzinfo=None)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [(r.t, r.w) for r in df.select("i", "t", iso_parse(F.col("t")).alias("w")).orderBy("i").collect()] == [(t, want(t)) for t in texts]


def test_a_feed_of_webinars(spark):
    item = {"type": "Upcoming", "title": "Talk", "liveStartTimeInUTC": 1791200000000, "liveEndTimeInUTC": 1791203600000}
    feed = [
        item | {"eventId": 11, "mediaType": "Webcast", "eventAbstract": "<p>About <b>x</b></p>"}, item | {"eventId": "12", "eventStartDate": "Oct 11, 2026 6:00 PM CET"}, item | {"eventId": 13, "eventStartDate": "Oct 11, 2026 6:00 PM"}, item | {"eventId": 14, "liveEndTimeInUTC": 5},
        item | {"eventId": True}, item | {"eventId": "00"}, item | {"eventId": 15, "type": "On Demand"}, item | {"eventId": 16, "title": " "}, item | {"eventId": 17, "liveStartTimeInUTC": True}, "x",
    ]
    df = pages(spark, [(json.dumps({"data": feed}), E.PORTAL, E.FEED), ("{bad", E.PORTAL, E.FEED), ("[]", E.PORTAL, E.FEED), (None, None, E.FEED)])
    got = {r.raw_id: r for r in E.candidates(df).collect()}
    live, end = dt.datetime(2026, 10, 5, 11, 33, 20), dt.datetime(2026, 10, 5, 12, 33, 20)
    assert {k: (r.starts_at, r.ends_at) for k, r in got.items()} == {"11": (live, end), "12": (dt.datetime(2026, 10, 11, 17), None), "13": (None, None), "14": (live, None), "17": (None, None)}
    a = got["11"]
    assert (a.canonical_url, a.description, a.format, a.event_type, a.registration_state, got["12"].format) == (f"{E.PORTAL}#/webinar/11", "About x", "online", "talk", "unknown", "unknown")


def test_pages_are_read_in_parts(spark, monkeypatch):
    """A batch is not held whole as Python objects; its order and its nulls stay."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from siftwell.sources import html

    monkeypatch.setattr(html, "PART", 3)
    rows = spark.createDataFrame([(i, None if i % 4 == 1 else f"<title>t{i}</title>") for i in range(10)], "i int, h string").coalesce(1)
    got = rows.select("i", html.page_title(F.col("h")).alias("t"), html.column(lambda h: [{"a": h}], T.ArrayType(T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])), F.col("h")).alias("x")).collect()
    assert [(r.i, r.t, r.x[0].a, r.x[0].b) for r in got] == [(i, None if i % 4 == 1 else f"t{i}", None if i % 4 == 1 else f"<title>t{i}</title>", None) for i in range(10)]
