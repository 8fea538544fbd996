"""Schedules, site rules, spans and hydration against plain loops; values that were wrong before."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions import url as U
from siftwell.operators.digest import pending
from siftwell.operators.fetching import overlapping, robots_verdicts, scheduled
from siftwell.operators.folds import alias_hits
from siftwell.sources.extract import displayed_time
from siftwell.sources.html import label_date, parse
from siftwell.sources.hydrate import hydrate

T0 = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("small", [False, True])
def test_schedule(spark, small):
    rng = random.Random(1)
    rows = [(i, rng.choice("hhhk"), T0 + dt.timedelta(milliseconds=rng.randrange(60_000))) for i in range(300)] + [(900 + i, "four", T0 + dt.timedelta(seconds=i)) for i in range(4)] + [(999, "h", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not small).lower())
    try:
        got = {r.id: r.wait_us for r in scheduled(spark.createDataFrame(rows, "id long, host string, at timestamp"), F.lit(3_000_000)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, free = {999: 0}, {}
    for i, h, at in sorted((r for r in rows if r[2]), key=lambda r: (r[1], r[2], r[0])):
        start = max(at, free.get(h, at))
        want[i], free[h] = (start - at) // dt.timedelta(microseconds=1), start + dt.timedelta(seconds=3)
    assert got == want and [got[900 + i] for i in range(4)] == [0, 2_000_000, 4_000_000, 6_000_000]


def test_site_rules(spark):
    rng = random.Random(2)
    origins, paths = ["https://a.org", "https://b.org:8080", "https://c.org"], ["/", "/en", "/en/x", "/en/x?q=1", "/de/y", "/private/z"]
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    files = [(o, minute(rng.randrange(2000)), rng.random() < 0.7) for o in origins[:2] for _ in range(8)]
    rules = list({(o, at, p): (o, at, p, rng.random() < 0.5) for o, at, ok in files for p in rng.sample(["/", "/en", "/en/x?", "/private", "/de/y", ""], 3) if ok}.values())
    asked = [(i, rng.choice(origins) + rng.choice(paths), minute(rng.randrange(2400))) for i in range(400)] + [(500, None, minute(1)), (501, "nonsense", minute(1))]
    got = robots_verdicts(
        spark.createDataFrame(asked, "id long, url string, at timestamp"), spark.createDataFrame(files, "origin string, fetched_at timestamp, readable boolean"), spark.createDataFrame(rules, "origin string, fetched_at timestamp, prefix string, allow boolean")
    )

    def judged(url, at):
        if not url or "://" not in url:
            return "deny"
        origin = next(o for o in origins if url.startswith(o))
        last = max(((f, ok) for o, f, ok in files if o == origin and f <= at), default=None)
        if last is None or at - last[0] >= dt.timedelta(minutes=360 if last[1] else 15):
            return "unknown"
        hits = [(len(p), allow) for o, f, p, allow in rules if o == origin and f == last[0] and p and url[len(origin) :].startswith(p)]
        return "allow" if last[1] and max(hits, default=(0, True))[1] else "deny"

    found = {r.id: r.verdict for r in got.collect()}
    assert found == {i: judged(u, at) for i, u, at in asked} and set(found.values()) == {"allow", "deny", "unknown"}


@pytest.mark.parametrize(("before", "after"), [(-5, 5), (0, 0), (3, -2)])
def test_spans(spark, before, after):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, lo := rng.randrange(500), lo + rng.choice([0, 1, 7, 40, 300])) for i in range(200)] + [(0, 500, None, 4), (0, 501, 4, None)]
    got = sorted(tuple(r) for r in overlapping(spark.createDataFrame(rows, "conv_id long, turn long, lo long, hi long"), 20, before, after).collect())
    full = [r for r in rows if None not in r]
    assert got == sorted((a[0], a[1], b[1]) for a in full for b in full if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] + before and a[3] > b[2] - after)


def test_one_long_conversation_of_spans(spark):
    spans = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 12).alias("hi"))
    assert overlapping(spans, 12).count() == 2 * 99_999


def test_aliases(spark):
    rng = random.Random(4)
    pieces = ["club", "Net", "A.I.", "@home", "é", "C++", "big", "!!", "x_y", "99", " ", "-", "\\E"]
    labels = list({"".join(rng.choice([p, p + " ", " " + p]) for p in rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(300)})
    aliases = list(enumerate({" ".join(rng.choices(pieces, k=rng.randint(1, 2))).strip() for _ in range(60)}))
    got = {tuple(r) for r in alias_hits(spark.createDataFrame([(x,) for x in labels], "organizer string"), spark.createDataFrame(aliases, "position int, alias string")).collect()}
    word = lambda c: c.isalnum() or c == "_"

    def holds(label, alias):
        low, a = label.lower(), alias.lower()
        spots = [i for i in range(len(low) - len(a) + 1) if low.startswith(a, i)]
        return any(not (i and word(low[i - 1])) and not (i + len(a) < len(low) and word(low[i + len(a)])) for i in spots)

    assert got == {(x, p) for x in labels for p, a in aliases if holds(x, a)} and len(got) > 100


def test_many_aliases_meet_by_equality(spark):
    labels = spark.range(2000).select(F.concat(F.lit("The Club "), "id").alias("organizer"))
    hits = alias_hits(labels, spark.range(30_000).select(F.col("id").cast("int").alias("position"), F.concat(F.lit("club "), "id").alias("alias")))
    assert hits.count() == 2000
    assert "NestedLoop" not in hits._jdf.queryExecution().executedPlan().toString()


def test_terminal_changes_are_told(spark):
    kinds = "event_id long, status string, starts_at timestamp, ends_at timestamp, registration_state string"
    day = lambda n: T0 + dt.timedelta(days=n)
    events = spark.createDataFrame([(1, "rejected", day(5), None, "cancelled"), (2, "eligible", day(-1), day(1), "open"), (3, "eligible", day(-2), day(-1), "open"), (4, "expired", day(-3), None, "closed"), (5, "eligible", None, None, None)], kinds)
    changes = spark.createDataFrame([(10 * e + i, e, kind, None, T0) for e in range(1, 6) for i, kind in enumerate(("registration_state", "venue", "lifecycle"))], "id long, event_id long, change_type string, digested_at timestamp, observed_at timestamp")
    assert [r.id for r in pending(changes, events, F.lit(T0)).collect()] == [10, 12, 20, 21, 22, 40, 42, 50, 51, 52]


def test_addresses(spark):
    public = ["2606:4700:4700::1111", "2001:4860:4860::8888", "2001:1::1", "2001:20::5", "2001:4:112::9", "2a00:1450::1.2.3.4", "8.8.8.8"]
    closed = ["::1", "::", "::ffff:10.0.0.1", "2001:db8::1", "ff02::1", "fe80::1", "fc00::1", "2001:1::3", "2002:1::", "64:ff9b::8.8.8.8", "100::1", "2001:0:1::", "1:2:3:4:5:6:7:8", "10.0.0.1"]
    none = ["1::2::3", "12345::", "g::1", "", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::ffff:300.1.1.1", ":::", "1.2.3", None]
    df = spark.createDataFrame([(x,) for x in [*public, *closed, *none]], "ip string")
    got = {r.ip: r.ok for r in df.select("ip", U.is_public_ip(F.col("ip")).alias("ok")).collect()}
    assert got == dict.fromkeys(public, True) | dict.fromkeys(closed, False) | dict.fromkeys(none)
    urls = spark.createDataFrame([("http://[::ffff:10.0.0.1]/",), ("http://[2001:db8::1]/",), ("http://[2606:4700::1]:80/a",), ("http://[x]/",)], "u string")
    assert [r.ok for r in urls.select(U.is_valid(F.col("u")).alias("ok")).collect()] == [False, False, True, False]


def test_dates_are_whole_or_none():
    for bad in ("Marathon 12 2026", "Maybe 5, 2026", "Marketing 3 2026 6 PM", "October 2026", "11 October", "30 February 2026", "11 October 1999", "", None, "2026", "25:99 11 October 2026"):
        assert label_date(bad) is None, bad
    at = lambda *x: dt.datetime(*x) - dt.timedelta(minutes=330)
    for good, when in (("Sept 3, 2026 · 7:30 p.m.", at(2026, 9, 3, 19, 30)), ("Sunday, 11th of October 2026 at 6pm", at(2026, 10, 11, 18)), ("31/12/2026 18:00 - 20:00", at(2026, 12, 31, 18)), ("12/31/2026", at(2026, 12, 31)), ("03/04/2026", at(2026, 4, 3)), ("2026-10-11T18:00+05:30", at(2026, 10, 11, 18)), ("3 Sep 2026, 12 AM", at(2026, 9, 3)), ("11 Oct 2026 6 PM UTC", dt.datetime(2026, 10, 11, 18))):
        assert label_date(good) == when, good
    assert label_date("03/04/2026", dayfirst=False) == at(2026, 3, 4) and label_date("2026-03-04") == at(2026, 3, 4)
    assert displayed_time("October 11, 2026 10:00 AM PST") == "2026-10-11T18:00:00Z" and displayed_time("2026-10-11 CET") is None and displayed_time("October 11, 2026 10:00 AM EST") is None


def test_price_and_state(spark):
    paid = {"INR 500": True, "500 - 700": True, "10to20": True, "from ₹99": True, "free for students, paid 5 others": True, "5 cad": True, "rs200": True, "₹0": False, "0.00": False, "$0 onwards": False, "INR 0 - 100": False, "12 seats": False, "decade 5": False, "prepaid": False, "nada": False, None: False}
    got = {r.p: r.v for r in spark.createDataFrame([(x,) for x in paid], "p string").select("p", X.is_paid(F.col("p")).alias("v")).collect()}
    assert got == paid
    states = {"Registration open": "open", "registrations are now opened": "open", "Cancellation policy": "cancelled", "join waitlist": "waitlist", "registration closed": "closed", "weekended": "closed", "almost full": "open", "SOLD OUT soon": "sold_out", "registering": "unknown", None: "unknown"}
    assert {r.p: r.v for r in spark.createDataFrame([(x,) for x in states], "p string").select("p", X.registration_state(F.col("p")).alias("v")).collect()} == states


def test_very_deep_pages_are_read_whole():
    n = 30_000
    root = parse("<div class=a>" * n + "<nav><p><a href=x>deep</a></p></nav>" + "</x>" * n + "</div>" * n + "<a href=y>out</a>")
    assert [a.attrs["href"] for a in root.select("div.a nav a")] == ["x"] and [a.attrs["href"] for a in root.select("nav a, a[href=y]")] == ["x", "y"]
    assert len(root.first("nav").select("div nav a")) == 1 and not root.select("nav div") and root.text() == "deep out"


def page(title, day):
    return f"<title>{title}</title><h1>{title}</h1><dl><dt>Date</dt><dd>{day} October 2026 18:00</dd></dl>"


def test_hydration(spark):
    links = lambda *xs: "<nav>" + "".join(f"<a href='{x}'>x</a>" for x in xs) + "</nav>"
    store = [
        ("https://a.org/list", links("/e/1", "/e/2#top", "/other", "/e/1", "https://a.org/list"), 1), ("https://a.org/list?page=2", links("/e/2", "/e/3", "/e/4", "/e/5"), 1),
        ("https://a.org/e/1", page("Old", 1), 1), ("https://a.org/e/1", page("One", 1), 2), ("https://a.org/e/2", page("Two", 2), 1), ("https://a.org/e/3", "<p>Verify you are human</p>", 1), ("https://a.org/e/5", page("Five", 5), 1),
        ("https://b.org/", "<h1>CAPTCHA</h1>", 1), ("https://b.org/2", links("/e/9"), 1), ("https://b.org/e/9", page("Nine", 9), 1), ("https://s.org/hit", page("Found", 7), 1), ("https://s.org/no", None, 1),
    ]
    pages = spark.createDataFrame([(u, h, T0 + dt.timedelta(days=d)) for u, h, d in store], "url string, html string, observed_at timestamp")
    kinds = "source_name string, urls array<string>, detail_selector string, detail_prefixes array<string>, max_detail_pages int"
    sources = spark.createDataFrame([("a", ["https://a.org/list", "https://a.org/list?page=2"], "nav a", ["/e/", "/list"], 4), ("b", ["https://b.org/2", "https://b.org/"], "nav a", ["/e/"], 9), ("find", None, None, None, None), ("gone", ["https://gone.org"], None, None, None)], kinds)
    seeds = spark.createDataFrame([("find", f"https://s.org/{p}", i) for i, p in enumerate(["hit", "no", "missing", "hit#x"])] + [("a", "https://s.org/hit", 0)], "source_name string, url string, place int")
    got = hydrate(sources, pages, seeds)
    visits = [tuple(r) for r in got.visits.select("source_name", "hop", "place", "url", "status").orderBy("source_name", "hop", "place").collect()]
    assert visits == [
        ("a", 0, 0, "https://a.org/list", "ok"), ("a", 0, 1, "https://a.org/list?page=2", "ok"), ("a", 1, 0, "https://a.org/e/1", "ok"), ("a", 1, 1, "https://a.org/e/2", "ok"), ("a", 1, 2, "https://a.org/e/3", "challenge"), ("a", 1, 3, "https://a.org/e/4", "missing"),
        ("b", 0, 0, "https://b.org/2", "skipped"), ("b", 0, 1, "https://b.org/", "challenge"), ("find", 0, 0, "https://s.org/hit", "ok"), ("find", 0, 1, "https://s.org/no", "unreadable"), ("find", 0, 2, "https://s.org/missing", "missing"), ("gone", 0, 0, "https://gone.org", "missing"),
    ]
    assert sorted((r.source_name, r.title) for r in got.candidates.collect()) == [("a", "One"), ("a", "Two"), ("find", "Found")]
    empty = hydrate(sources.limit(0), pages.limit(0))
    assert empty.visits.count() == 0 and empty.candidates.count() == 0
