"""Every registered query of the event library against its SQL twin, and operators against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwell import catalog
from siftwell.functions.time import day_bound
from siftwell.operators.folds import dedupe_fold, pack_chunks, reverted_schedules, trust_merge
from siftwell.functions import text
from siftwell.sources import extract, html
from siftwell.sources.html import parse

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name in catalog.ORACLE:
        result = duck.execute(catalog.ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert rows == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())


def test_trust_merge_against_a_loop(spark):
    rng = random.Random(6)
    rank = {"low": 1, "medium": 2, "high": 3}
    terminal = ("cancelled", "sold_out", "closed", "postponed")

    def row(key):
        return {"event_key": key, "title": rng.choice(["a", "b", None, ""]), "venue": rng.choice([None, "x", "y"]), "registration_state": rng.choice(["unknown", "open", "waitlist", *terminal]), "trust": rng.choice(list(rank)), "score": rng.randint(0, 15), "status": rng.choice(["eligible", "needs_review", "rejected"]), "ends_at": rng.choice([None, dt.datetime(2020, 1, 1), dt.datetime(2030, 1, 1)])}

    events = [row(k) for k in range(60)]
    seen = [row(rng.randrange(60)) | {"observed_at": dt.datetime(2024, 1, rng.randint(1, 5)), "seq": i} for i in range(400)]
    now = dt.datetime(2025, 1, 1)
    want = {e["event_key"]: dict(e) for e in events}
    for x in sorted(seen, key=lambda x: (x["observed_at"], x["seq"])):
        e = want[x["event_key"]]
        wins = rank[x["trust"]] >= rank[e["trust"]]
        for f in ("title", "venue"):
            if x[f] and (not e[f] or wins):
                e[f] = x[f]
        trusted = x["status"] != "rejected" or wins
        if trusted and x["ends_at"] and (not e["ends_at"] or wins):
            e["ends_at"] = x["ends_at"]
        refused = x["registration_state"] != "unknown" and not wins and (x["registration_state"] in terminal or e["registration_state"] in terminal)
        if x["registration_state"] != "unknown" and not refused:
            e["registration_state"] = x["registration_state"]
        if e["ends_at"] and e["ends_at"] < now:
            e["status"] = "expired"
        elif not refused and trusted and not (e["status"] == "eligible" and x["status"] == "needs_review"):
            e["status"] = x["status"]
        e["trust"] = max(e["trust"], x["trust"], key=rank.get)
        e["score"] = max(e["score"], x["score"])
    kinds = "event_key long, title string, venue string, registration_state string, trust string, score long, status string, ends_at timestamp_ntz"
    names = [k.split()[0] for k in kinds.split(", ")]
    a = spark.createDataFrame([tuple(e[n] for n in names) for e in events], kinds)
    b = spark.createDataFrame([tuple(x[n] for n in [*names, "observed_at", "seq"]) for x in seen], kinds + ", observed_at timestamp_ntz, seq long")
    found = {r.event_key: r.asDict() for r in trust_merge(a, b, F.lit(now).cast("timestamp_ntz")).collect()}
    assert found == want


def test_texts_are_combined_in_order(spark):
    names = "identity string, seq int, title string, organizer string, venue string, city string, registration_url string, format string, event_type string, registration_state string, registration_deadline timestamp, registration_opened_at timestamp, starts_at timestamp, is_explicitly_paid boolean, description string, price_text string, eligibility_text string, speakers array<string>, topics array<string>"
    rows = [("e", i, f"t{i}", None, "", None, None, f, "unknown", s, None, None, None, False, d, p, None, sp, None) for i, (f, s, d, p, sp) in enumerate([("online", "open", "A", None, ["x"]), ("unknown", "cancelled", "B", "INR 5", ["y", "x"]), ("hybrid", "open", "A", None, None)])]
    r = dedupe_fold(spark.createDataFrame(rows, names)).first()
    assert (r.title, r.format, r.registration_state, r.description, r.is_explicitly_paid, r.speakers, r.topics) == ("t2", "hybrid", "cancelled", "A; B; A", True, ["x", "y"], [])


def test_chunks(spark):
    df = spark.createDataFrame([(["a" * 5, "b" * 5, "c" * 12, "d"],), ([],), (["e" * 25],)], "blocks array<string>")
    assert [r[0] for r in df.select(pack_chunks(F.col("blocks"), 12)).collect()] == [["aaaaa\n\nbbbbb", "c" * 12, "d"], [], ["e" * 12, "e" * 12, "e"]]
    df = spark.createDataFrame([(["ab", "one\ntwo three\n\nfour five six", "z"],), (["\n" + "x" * 14],)], "blocks array<string>")
    assert [r[0] for r in df.select(pack_chunks(F.col("blocks"), 12)).collect()] == [["ab", "one", "two three\n", "four five si", "x\n\nz"], ["\n" + "x" * 11, "xxx"]]


def test_reverted_schedules(spark):
    rows = [(1, 1, "a", "b", 1, "a", None), (1, 2, "b", "a", 2, "a", None), (2, 3, "a", "b", 1, "b", None), (3, 4, None, "b", 1, "b", None), (3, 5, "b", None, 2, "b", None), (4, 6, "a", "b", 1, "a", "b"), (4, 7, "b", "a", 2, "a", "b")]
    df = spark.createDataFrame(rows, "event_id long, id long, old_value string, new_value string, observed_at int, starts_at string, ends_at string")
    assert {(r.event_id, r.id) for r in reverted_schedules(df).collect()} == {(1, 1), (1, 2)}


def test_revert_schedule_reads_all_changes(spark):
    events = {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect(), key=lambda r: (r.ts, r.event_id)):
        events.setdefault(r.user_id, []).append((r.event_id, r.event_type))
    # the changes of an event are one path over its values, which returns where it began or not
    want = {(k, i) for k, v in events.items() if v[0][1] == v[-1][1] for i, _ in v[1:]}
    assert max(map(len, events.values())) > 5 and {(r.event_id, r.id) for r in catalog.QUERIES["revert_schedule"](spark, SF).collect()} == want


def test_stream_of_observations(spark, tmp_path):
    from siftwell.streaming.upsert import upsert_stream

    kinds = "event_key long, title string, venue string, registration_state string, trust string, score long, status string, ends_at timestamp_ntz, observed_at timestamp_ntz, seq long"
    source = tmp_path / "in"
    for i, state in enumerate(["unknown", "open"]):
        rows = [(k, f"t{i}", None, state, "high", i, "eligible", None, dt.datetime(2024, 1, 1 + i), i) for k in range(3)]
        spark.createDataFrame(rows, kinds).write.mode("append").parquet(str(source))
        query = upsert_stream(spark.readStream.schema(kinds).parquet(str(source)), str(tmp_path / "out"), str(tmp_path / "check"), lambda: dt.datetime(2024, 2, 1))
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out" / "v=1"))
    assert {(r.event_key, r.title, r.registration_state) for r in found.collect()} == {(k, "t1", "open") for k in range(3)}


def test_events_expire(spark, tmp_path):
    from siftwell.streaming.expiry import expiring

    source, kinds = str(tmp_path / "in"), "event_key long, status string, ends_at timestamp, observed_at timestamp"
    past, future, old, new = (dt.datetime(y, 1, 1) for y in (2020, 2090, 2018, 2019))
    rows = [(1, "eligible", past, old), (2, "eligible", future, old), (3, "rejected", past, old), (4, "eligible", None, new), (4, "rejected", None, old)]
    spark.createDataFrame(rows, kinds).write.parquet(source)
    query = expiring(spark.readStream.schema(kinds).parquet(source)).writeStream.outputMode("update").format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    want, found, until = {(1, "expired"), (2, "eligible"), (3, "rejected"), (4, "eligible")}, set(), time.time() + 120
    try:
        while found != want and time.time() < until:  # timers keep such a query going, so it is stopped here
            time.sleep(0.5)
            found = {(r.event_key, r.status) for r in spark.table("expiring").collect()}
    finally:
        query.stop()
    assert found == want


def test_day_bounds():
    assert day_bound("2026-10-12", False) == (dt.datetime(2026, 10, 11, 18, 30, tzinfo=dt.UTC), False)
    assert day_bound("2026-10-12", True) == (dt.datetime(2026, 10, 12, 18, 30, tzinfo=dt.UTC), True)
    for bad in ("2026-13-01", "2026-10-12T10:00", "soon", ""):
        with pytest.raises(ValueError):
            day_bound(bad, False)


def test_ordinary_pages_kill_no_job(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    pages = [("<p>" * 2000 + "end", "https://a.org"), ('<nav><a href="http://[bad">x</a><a href="/ok">y</a></nav>', "https://a.org"), (deep, "https://a.org"), ('<script type="application/ld+json">' + "[" * 100_000 + "</script>", "https://a.org"),
             ('<script type="application/ld+json">{"@type": "Event", "name": "E", "url": "http://[bad"}</script><article data-event><h2>Card</h2><a href="#c">x</a></article><article data-event><h2>No link</h2></article>', "https://a.org/p"), (None, None), ("", "")]
    df = spark.createDataFrame(pages, "html string, url string")
    rows = df.select(html.page_title(F.col("html")), extract.page_candidates(F.col("html"), F.col("url")).alias("c"), html.is_interstitial(F.col("html")), html.links(F.col("html"), F.col("url"), "nav a", ["/"], 4).alias("l"), html.labelled(F.col("html"), "venue").alias("v")).collect()
    assert rows[1].l == ["https://a.org/ok"] and [(c.title, c.url, c.parser) for c in rows[4].c] == [("E", "https://a.org/p", "json"), ("Card", "https://a.org/p#c", "card")]


def test_all_texts_of_an_order_are_combined(spark):
    texts = {}
    for r in sorted(spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").collect()):
        old = texts.get(r.l_orderkey)
        texts[r.l_orderkey] = r.l_returnflag if old is None or old == r.l_returnflag else f"{old}; {r.l_returnflag}"
    want = {}
    for t in texts.values():
        want[t] = want.get(t, 0) + 1
    assert {r.text: r.n for r in catalog.QUERIES["text_combine"](spark, SF).collect()} == want


def test_phrases_in_other_scripts(spark):
    df = spark.createDataFrame([("“ai” works",), ("aïai",), ("né ai",), ("ñai",), ("ai٣",), ("ai—x",), ("a\u0301ai",), (None,)], "t string")
    assert [r[0] for r in df.select(text.any_phrase(F.col("t"), ["ai"])).collect()] == [True, False, True, False, False, True, False, False]


def test_selectors():
    root = parse("<div id=a class='x y'><p data-k='12'>t</p></div><p>u</p>")
    assert [n.text() for n in root.select("div.x p[data-k*='1'], p")] == ["t", "u"] and root.first("#a") and not root.first("div.z")
