"""Registered queries: extraction, folds, identity, merge and digest text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions import url as U
from siftwell.functions.time import epoch_millis, ist_display
from siftwell.operators import folds, ingest
from siftwell.operators.arrival import identities, resolve_in_order
from siftwell.operators.delivery import suppressed
from siftwell.operators.fetching import overlapping, robots_verdicts
from siftwell.plans import scalars
from siftwell.plans.relational import read
from siftwell.sources import extract as E
from siftwell.sources import html as H
from siftwell.sources import registry
from siftwell.sources.hydrate import hydrate

QUERIES, ORACLE = {}, {}


def add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


def cases(name: str, *how) -> None:
    scalars.cases(name, *how)
    QUERIES[name], ORACLE[name] = scalars.QUERIES.pop(name), scalars.ORACLE.pop(name)


# pages
add("html_title", lambda spark, sf: read(spark, sf, "pages").select("page_id", H.page_title(F.col("html")).alias("title")))
add("page_extract", lambda spark, sf: read(spark, sf, "pages").select("page_id", F.explode(E.page_candidates(F.col("html"), F.col("url"))).alias("c")).select("page_id", "c.title", "c.url", "c.parser"))
add("page_facts", lambda spark, sf: E.candidates(read(spark, sf, "pages").select("page_id", "html", "url", F.lit("pages").alias("source_name"), F.lit(dt.datetime(2026, 6, 1)).cast("timestamp").alias("observed_at"))).select("id", "title", "canonical_url", "description", "starts_at", "price_text", "is_explicitly_paid", "registration_state", "event_type", "format"))
add("detail_links", lambda spark, sf: read(spark, sf, "pages").select("page_id", F.posexplode(H.links(F.col("html"), F.col("url"), "nav a", ["/"], 4)).alias("no", "link")))
add("interstitial", lambda spark, sf: read(spark, sf, "pages").filter(H.is_interstitial(F.col("html"))).select("page_id"), "SELECT page_id FROM pages AS p WHERE contains(html, 'g-recaptcha')")
cases("interstitial_cases", "h string", [("<h1>CAPTCHA</h1>", True), ("<p>Please complete the CAPTCHA</p>", True), ("<p>Access denied</p>", True), ("<iframe src='https://www.google.com/recaptcha/api2'></iframe>", True), ("<div hidden>Verify you are human</div><h1>Calendar</h1>", False), ("<div style='display: none'><span style='color: red'>Access denied</span></div><h1>Calendar</h1>", False), ("<h1>Engineering CAPTCHA systems</h1><p>Workshop on bot detection.</p>", False), ("Checking your browser before accessing", True), ("<p>Verify you are human</p>", True), ("<div class='g-recaptcha'></div>", True), ("<script>verify you are human</script><h1>Meetup</h1>", False), ("<h1>Security check workshop</h1>", False), (None, False)], H.is_interstitial, "boolean")
cases("html_title_cases", "h string", [("<title>a</title><h1> B  c </h1>", "a"), ("<h1>only a heading</h1>", None), ("<meta property='og:title' content='O'><h1>x</h1>", "O"), ("<title>T &amp; U</title>", "T & U"), ("<p>x</p>", None), (None, None)], H.page_title, "string")
cases("html_labels", "h string", [("<dl><dt>Venue</dt><dd>Hall <b>3</b></dd></dl>", "Hall 3"), ("<table><tr><th>Venue:</th><td>Room</td></tr></table>", "Room"), ("<p><b>Venue</b> The Loft</p>", "The Loft"), ("<p>Venue unknown</p>", None), (None, None)], lambda h: H.labelled(h, "venue"), "string")
cases("html_semantic", "h string", [("<title>Site</title><h1>Talk</h1><dl><dt>Date</dt><dd>2026-10-11 18:00</dd><dt>Host</dt><dd>Club</dd></dl>", "Talk|2026-10-11T12:30:00Z|Club|label")], lambda h: F.concat_ws("|", *(E.page_candidates(h, F.lit("https://a.org/e"))[0][n] for n in ("title", "starts_at", "organizer", "parser"))), "string")
cases("html_cards", "h string", [("<article data-event data-start='2026-01-02'><h2>One</h2></article><article data-event><h3>Two</h3></article>", "One|Two"), ("<article><h2>No</h2></article>", "")], lambda h: F.array_join(H.card_titles(h, "article[data-event]"), "|"), "string")
cases("json_map", "h string", [
    ('<script type="application/ld+json">{"@graph": [{"@type": "Event", "name": " A  b ", "startDate": "2026-10-10", "location": {"name": "Hall", "address": {"addressLocality": "Pune"}}, "offers": [{"price": 0, "availability": "InStock"}], "url": "/x"}]}</script>', "A b|https://a.org/x|2026-10-10|Hall|Pune|0|InStock|json"),
    ('<script type="application/json">{bad}</script><title>T</title>', "T|https://a.org/e|title"), ('<script type="application/json">{"events": [{"title": "E", "local_date": "2026-01-01", "local_time": "10:00"}]}</script>', "E|https://a.org/e|2026-01-01T10:00|json"),
], lambda h: F.concat_ws("|", *(E.page_candidates(h, F.lit("https://a.org/e"))[0][n] for n in ("title", "url", "starts_at", "venue", "city", "price", "state", "parser"))), "string")
cases("json_nodes", "t string", [('{"events": [{"a": 1}, {"data": {"b": 2}}]}', 4), ("[]", 0), ("{bad}", 0), ('{"x": {"y": 1}}', 1), (None, 0)], H.node_count, "int")
cases("url_join", "b string, u string", [("https://a.org/x/y", "../z", "https://a.org/z"), ("https://a.org/x", "https://b.org", "https://b.org"), ("https://a.org/x", "/q?r=1", "https://a.org/q?r=1"), ("https://a.org", None, None)], H.joined_url, "string")
day = dt.datetime(2026, 10, 10, 18, 30)
cases("label_date", "t string", [("11 October 2026", day), ("Oct 11th, 2026", day), ("2026-10-11", day), ("11/10/2026", day), ("11 Oct 2026 6:00 PM IST", dt.datetime(2026, 10, 11, 12, 30)), ("October 2026", None), ("11 October", None), ("2026", None), ("tomorrow", None), (None, None)], H.labelled_date, "timestamp_ntz")
cases("location_split", "j string", [('{"name": "Hall", "address": {"addressLocality": "Pune", "addressCountry": "IN"}}', "Hall|Pune|IN"), ('{"name": "Hall"}', "Hall"), ('"Somewhere"', "Somewhere"), ("bad", "")], lambda j: F.when(F.try_parse_json(j).isNull(), "").otherwise(F.concat_ws("|", F.coalesce(F.get_json_object(j, "$.name"), F.regexp_extract(j, '^"(.*)"$', 1)), F.get_json_object(j, "$.address.addressLocality"), F.get_json_object(j, "$.address.addressCountry"))), "string")


def offers(j):
    """Price texts of an offer list, and whether any is paid."""
    items = F.from_json(j, "array<struct<price: string, priceCurrency: string, availability: string>>")
    texts = F.transform(items, lambda o: X.clean(F.concat_ws(" ", o["priceCurrency"], o["price"])))
    return F.concat(F.array_join(texts, "; "), F.lit("|"), F.exists(texts, X.is_paid).cast("string"))


cases("offers_reduce", "j string", [('[{"price": "0", "priceCurrency": "INR"}, {"price": 499, "priceCurrency": "INR"}]', "INR 0; INR 499|true"), ('[{"price": "Free"}]', "Free|false"), ("[]", "|false")], offers, "string")


def json_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A feed of webinars: upcoming ones with a number as id, a title and a start."""
    feed = '{"data": [{"eventId": 11, "title": "One", "type": "Upcoming", "liveStartTimeInUTC": 1791200000000}, {"eventId": "12", "title": "One", "type": "Upcoming", "liveStartTimeInUTC": 1791300000000}, {"eventId": 13, "title": "Old", "type": "On Demand", "liveStartTimeInUTC": 1}, {"eventId": true, "title": "Bad", "type": "Upcoming", "liveStartTimeInUTC": 5}, {"eventId": 15, "title": "", "type": "Upcoming", "liveStartTimeInUTC": 5}]}'
    rows = spark.createDataFrame([(feed,), ("{bad}",), ("[]",), ('{"data": {}}',)], "body string")
    item = "array<struct<eventId: string, title: string, type: string, liveStartTimeInUTC: string>>"
    items = rows.select(F.explode(F.from_json(F.get_json_object("body", "$.data"), item)).alias("x")).select("x.*")
    ok = items.filter((F.col("type") == "Upcoming") & (F.col("eventId").try_cast("long") > 0) & (X.clean(F.col("title")).isNotNull()))
    return ok.select(F.col("eventId").cast("long").alias("id"), "title", epoch_millis(F.col("liveStartTimeInUTC")).cast("timestamp_ntz").alias("starts_at"))


add("json_feed", json_feed, "SELECT * FROM (VALUES (CAST(11 AS BIGINT), 'One', TIMESTAMP '2026-10-05 11:33:20'), (CAST(12 AS BIGINT), 'One', TIMESTAMP '2026-10-06 15:20:00')) AS t(id, title, starts_at)")
add("error_isolation", lambda spark, sf: read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.when(F.get_json_object("props", "$.k").try_cast("int") > 50, "too large").alias("error")), "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 THEN 'too large' END AS error FROM events AS e")


# folds
def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as cross-postings."""
    c = read(spark, sf, "conversations")
    states = F.array(*map(F.lit, ("unknown", "open", "waitlist", "closed")))
    return c.select(
        F.col("conv_id").alias("identity"), F.col("turn").alias("seq"), F.col("text").alias("title"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("organizer"), F.col("role").alias("venue"),
        F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("registration_url"), F.when(F.col("turn") == 1, "online").otherwise("unknown").alias("format"), F.lit("unknown").alias("event_type"),
        F.element_at(states, (F.col("turn") % 4 + 1).cast("int")).alias("registration_state"), F.lit(None).cast("timestamp").alias("registration_deadline"), F.lit(None).cast("timestamp").alias("registration_opened_at"),
        F.lit(None).cast("timestamp").alias("starts_at"), (F.col("turn") == 3).alias("is_explicitly_paid"), F.col("role").alias("description"), F.lit(None).cast("string").alias("price_text"), F.lit(None).cast("string").alias("eligibility_text"),
        F.array("role").alias("speakers"), F.array(F.col("turn").cast("string")).alias("topics"),
    )


add("dedupe_fold", lambda spark, sf: folds.dedupe_fold(postings(spark, sf)).select("identity", "title", "organizer", "venue", "format", "registration_state", "is_explicitly_paid", F.array_join("speakers", ",").alias("speakers"), F.array_join("topics", ",").alias("topics")), """
WITH p AS (SELECT conv_id, turn, text AS title, CASE WHEN turn % 2 = 0 THEN role END AS organizer, role FROM conversations AS c)
SELECT conv_id AS identity, last(title ORDER BY turn) FILTER (WHERE title <> '') AS title, last(organizer ORDER BY turn) FILTER (WHERE organizer IS NOT NULL) AS organizer, last(role ORDER BY turn) AS venue,
  CASE WHEN bool_or(turn = 1) THEN 'online' ELSE 'unknown' END AS format, CASE max(turn % 4) WHEN 0 THEN 'unknown' WHEN 1 THEN 'open' WHEN 2 THEN 'waitlist' ELSE 'closed' END AS registration_state,
  bool_or(turn = 3) AS is_explicitly_paid, (SELECT string_agg(role, ',' ORDER BY f) FROM (SELECT role, min(turn) AS f FROM conversations AS i WHERE i.conv_id = p.conv_id GROUP BY role) AS r) AS speakers,
  string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS topics
FROM p GROUP BY conv_id""")  # fmt: skip


def observations(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % len(v) + 1).cast("int"))
    return e.select(F.col("user_id").alias("event_key"), F.col("event_type").alias("title"), F.when(F.col("value") > 50, F.col("event_type")).alias("venue"), pick("event_id", "open", "unknown", "closed", "waitlist", "cancelled").alias("registration_state"), pick("event_id", "low", "medium", "high").alias("trust"), (F.col("event_id") % 16).alias("score"), pick("event_id", "eligible", "needs_review", "rejected").alias("status"), F.lit(None).cast("timestamp_ntz").alias("ends_at"), F.col("ts").alias("observed_at"), F.col("event_id").alias("seq"))


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    o = observations(spark, sf)
    split = F.lit(dt.datetime(2024, 1, 16)).cast("timestamp_ntz")
    order = Window.partitionBy("event_key").orderBy("observed_at", "seq")
    first = o.filter(F.col("observed_at") < split).withColumn("no", F.row_number().over(order)).filter("no = 1").drop("no")
    return folds.trust_merge(first, o.filter(F.col("observed_at") >= split), F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz")).drop("ends_at")


add("upsert_merge", upsert_merge)
def material_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The change log of all observations, merged by what is known of each event."""
    o = observations(spark, sf).withColumns({"canonical_url": F.concat(F.lit("https://a.org/"), F.col("event_key").cast("string")), "source_url": F.lit("https://a.org"), "reason": F.lit("r"), "price_text": F.when(F.col("seq") % 4 == 0, "Free"), "starts_at": F.date_trunc("week", "observed_at") + F.make_dt_interval(F.lit(90))})
    _, changes, _ = ingest.merge_observations(spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ingest.EVENT.items())), o.withColumnRenamed("trust", "organizer_trust"), F.lit(dt.datetime(2024, 1, 31)).cast("timestamp"))
    return changes.select("event_key", "seq", "change_type", "old_value", "new_value")


add("material_changes", material_changes)


def assess_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as candidates of two organizers, assessed without a classifier."""
    now, k = dt.datetime(2026, 6, 1), F.col("page_id")
    none = {c: F.lit(None).cast(t) for c, t in (ingest.FACTS | ingest.GUARDED | ingest.LISTS).items()}
    c = read(spark, sf, "pages").select(k.alias("id"), F.col("url").alias("canonical_url"), F.lit("feed").alias("source_name"), F.lit(False).alias("is_explicitly_paid")).withColumns(none)
    k = F.col("id")
    c = c.withColumns({"title": F.when(k % 3 == 0, "Python talk").otherwise("Evening"), "city": F.when(k % 2 == 0, "Bangalore"), "format": F.lit("online"), "registration_state": F.when(k % 5 == 0, "closed").otherwise("open"), "event_type": F.when(k % 7 == 0, "unknown").otherwise("talk"), "starts_at": F.lit(now + dt.timedelta(days=10)).cast("timestamp")})
    o = spark.createDataFrame([(1, "Example", "high", True), (2, "Net", "medium", False)], "position int, name string, trust string, online_allowed boolean")
    out = ingest.assess_candidates(c, o, o.select("position", F.col("name").alias("alias")), spark.createDataFrame([(1, "example.org"), (2, "example.net")], "position int, domain string"), F.lit(now).cast("timestamp"), topics=("python",))
    return out.select(F.col("id").alias("page_id"), "status", "reason", "score", "organizer_trust")


add("assess_pages", assess_pages, f"""WITH c AS (SELECT page_id AS k, {scalars._HOST} AS h FROM pages AS p0), t AS (SELECT k, CASE WHEN h = 'example.org' OR ends_with(h, '.example.org') THEN 'high' WHEN h = 'example.net' OR ends_with(h, '.example.net') THEN 'medium' ELSE 'low' END AS trust FROM c AS x),
 s AS (SELECT k, trust, CASE WHEN k % 5 = 0 THEN 'rejected|Registration is closed' WHEN k % 2 <> 0 AND trust <> 'high' THEN 'rejected|Not Bengaluru or trusted global online' WHEN k % 3 <> 0 OR k % 7 = 0 THEN 'needs_review|Ambiguous technical fit' ELSE 'eligible|Technical event matching location and time policy' END AS s FROM t AS y)
 SELECT k AS page_id, split_part(s, '|', 1) AS status, split_part(s, '|', 2) AS reason, CAST(CASE WHEN s LIKE 'eligible|%' THEN 7 + CASE trust WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS score, trust AS organizer_trust FROM s AS z""")
add("provenance_upsert", lambda spark, sf: observations(spark, sf).groupBy("event_key", F.col("title").alias("source_url")).agg(F.max_by("registration_state", F.struct("observed_at", "seq")).alias("state"), F.max("observed_at").alias("observed_at")), "SELECT user_id AS event_key, event_type AS source_url, last(CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'unknown' WHEN 2 THEN 'closed' WHEN 3 THEN 'waitlist' ELSE 'cancelled' END ORDER BY ts, event_id) AS state, max(ts) AS observed_at FROM events AS e GROUP BY 1, 2")
add("provenance_ok", lambda spark, sf: read(spark, sf, "events").filter(F.col("event_type").isin("view", "purchase") & (F.get_json_object("props", "$.k").cast("int") > 10)).select("event_id"), "SELECT event_id FROM events AS e WHERE event_type IN ('view', 'purchase') AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 10")
add("refresh_pick_source", lambda spark, sf: observations(spark, sf).filter("status <> 'rejected'").groupBy("event_key").agg(F.max_by("seq", F.struct(F.when(F.col("trust") == "high", 3).when(F.col("trust") == "medium", 2).otherwise(1), "observed_at", "seq")).alias("seq")), "SELECT event_key, seq FROM (SELECT user_id AS event_key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, ts DESC, event_id DESC) AS no FROM events AS e WHERE event_id % 3 <> 2) AS t WHERE no = 1")
def refresh_match(spark: SparkSession, sf: str) -> DataFrame:
    """Pages met again and the event each identity is known by, its smallest id."""
    pages = read(spark, sf, "pages")
    known = pages.groupBy(U.identity(F.col("url")).alias("i")).agg(F.min("page_id").alias("b"))
    return pages.select(F.col("page_id").alias("a"), U.identity(F.concat("url", F.lit("#x"))).alias("i")).join(known, "i").select("a", "b")


add("refresh_match", refresh_match, f"WITH n AS (SELECT page_id, {scalars._PLAIN} AS i FROM pages AS p) SELECT page_id AS a, min(page_id) OVER (PARTITION BY i) AS b FROM n AS x")
add("revert_url", lambda spark, sf: read(spark, sf, "pages").filter(~U.same_destination(F.col("url"), F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("page_id") % 2 == 0, "#again").otherwise("/other")))).select("page_id"), "SELECT page_id FROM pages AS p WHERE page_id % 2 <> 0 AND NOT contains(url, 'utm_')")


def identity_query(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages").select("page_id", U.normalize(F.col("url")).alias("canonical_url"), U.host(F.col("url")).alias("normalized_key"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("m"), (F.col("page_id") % 50).cast("string"))).alias("identity"))
    return folds.identity_resolve(p.withColumnRenamed("page_id", "seq"), p.filter("page_id % 2 = 0").withColumnRenamed("page_id", "id"))


add("identity_resolve", identity_query, f"""WITH p AS (SELECT page_id, {scalars._PLAIN} AS u, {scalars._HOST} AS k, CASE WHEN page_id % 3 = 0 THEN 'm' || CAST(page_id % 50 AS VARCHAR) END AS i FROM pages AS p0),
 k AS (SELECT k, min(page_id) AS id, arg_min(coalesce(i, ''), page_id) AS i FROM p WHERE page_id % 2 = 0 GROUP BY k),
 h AS (SELECT a.page_id AS seq, b.id, 1 AS tier FROM p AS a JOIN (SELECT i, min(page_id) AS id FROM p WHERE page_id % 2 = 0 GROUP BY i) AS b ON a.i = b.i
  UNION ALL SELECT a.page_id, b.id, 2 FROM p AS a JOIN (SELECT u, min(page_id) AS id FROM p WHERE page_id % 2 = 0 GROUP BY u) AS b ON a.u = b.u
  UNION ALL SELECT a.page_id, k.id, 3 FROM p AS a JOIN k ON a.k = k.k AND (a.i IS NULL OR k.i = '' OR a.i = k.i)),
 r AS (SELECT seq, id, tier, row_number() OVER (PARTITION BY seq ORDER BY tier, id) AS no FROM h AS x)
 SELECT p.page_id AS seq, r.id AS event_id, CAST(r.tier AS INTEGER) AS tier FROM p LEFT JOIN r ON r.seq = p.page_id AND r.no = 1""")


def arrival_query(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as candidates in the order of their ids; those of one host share titles, so that merges change keys."""
    k = F.col("page_id")
    none = {f: F.lit(None).cast(t) for f, t in ingest.OBSERVED.items()}
    p = read(spark, sf, "pages").select(k.alias("seq"), F.col("url").alias("canonical_url")).withColumns(none)
    k = F.col("seq")
    p = p.withColumns({"title": F.concat(F.lit("Talk "), (k % 40).cast("string")), "organizer": U.host(F.col("canonical_url")), "format": F.lit("online"), "status": F.when(k % 11 == 0, "rejected").otherwise("eligible"), "organizer_trust": F.when(k % 3 == 0, "high").otherwise("low"), "registration_state": F.lit("open"), "source_url": F.col("canonical_url"), "observed_at": F.timestamp_seconds(k), "score": k % 16})
    events = spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in ingest.EVENT.items()))
    return resolve_in_order(identities(p), events, F.lit(dt.datetime(2026, 6, 1)).cast("timestamp")).select(F.col("seq").alias("page_id"), "event_key")


add("identity_in_order", arrival_query)


def robots_query(spark: SparkSession, sf: str) -> DataFrame:
    """All pages against rules that are read at each full hour, with every fifth page's path denied."""
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", F.timestamp_seconds(F.col("page_id") * 60).alias("at"))
    net = F.concat(U.scheme(F.col("url")), F.lit("://"), U.host(F.col("url")))
    files = pages.filter("id % 60 = 0").select(net.alias("origin"), F.col("at").alias("fetched_at"), (F.col("id") % 120 == 0).alias("readable")).distinct()
    paths = pages.filter("id % 5 = 0").select(net.alias("origin"), U.path(F.col("url")).alias("prefix")).distinct()
    rules = files.filter("readable").join(paths, "origin").select("origin", "fetched_at", "prefix", F.lit(False).alias("allow"))
    rules = rules.unionByName(files.select("origin", "fetched_at", F.lit("/en/").alias("prefix"), F.lit(True).alias("allow")))
    return robots_verdicts(pages, files, rules).withColumnRenamed("id", "page_id")


add("robots_verdicts", robots_query)


def hydrate_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each host is a source whose listing is its first page; the visits that its links lead to."""
    pages = read(spark, sf, "pages").select("url", "html", F.timestamp_seconds("page_id").alias("observed_at"))
    sources = pages.filter(U.host(F.col("url")) != "").groupBy(U.host(F.col("url")).alias("source_name")).agg(F.array(F.min_by("url", "observed_at")).alias("urls"))
    sources = sources.withColumns({"detail_selector": F.lit("a"), "detail_prefixes": F.array(F.lit("/")), "max_detail_pages": F.lit(50)})
    return hydrate(sources, pages).visits


add("hydrate_pages", hydrate_query)


def suppressed_query(spark: SparkSession, sf: str) -> DataFrame:
    """Event types of users as formats that change: the changes of those who are back where they began."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("old_value", F.lag("event_type").over(order))
    changes = e.filter("old_value IS NOT NULL").select(F.col("event_id").alias("id"), F.col("user_id").alias("event_id"), F.lit("format").alias("change_type"), "old_value", F.col("event_type").alias("new_value"), F.col("ts").cast("timestamp").alias("observed_at"))
    none = F.lit(None).cast("timestamp")
    now = e.groupBy(F.col("user_id").alias("event_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("format")).withColumns({"starts_at": none, "ends_at": none})
    return suppressed(changes, now)


add("suppressed_changes", suppressed_query, "WITH t AS (SELECT event_id, user_id, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events AS e), u AS (SELECT user_id, first(event_type ORDER BY ts, event_id) AS a, last(event_type ORDER BY ts, event_id) AS b FROM events AS e GROUP BY user_id) SELECT t.event_id AS id, 'format reverted' AS why FROM t JOIN u ON t.user_id = u.user_id WHERE t.old IS NOT NULL AND u.a = u.b")


def organizer_query(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "pages").select(F.col("page_id").alias("id"), U.host(F.col("url")).alias("host"), F.element_at(F.array(F.lit("Example Club"), F.lit("the Net group"), F.lit(None).cast("string"), F.lit("Exampled")), (F.col("page_id") % 4 + 1).cast("int")).alias("organizer"))
    o = spark.createDataFrame([(1, "Example", "high"), (2, "Net", "medium")], "position int, name string, trust string")
    return folds.organizer_match(c, o, o.select("position", F.col("name").alias("alias")), spark.createDataFrame([(1, "example.org"), (2, "example.net")], "position int, domain string"))


_ORG = """WITH c AS (SELECT page_id AS id, {h} AS h, page_id % 4 AS m FROM pages AS p0), f AS (SELECT id, m = 0 AS a1, m = 1 AS a2, h = 'example.org' OR ends_with(h, '.example.org') AS d1, h = 'example.net' OR ends_with(h, '.example.net') AS d2 FROM c AS x)
 SELECT id, CASE WHEN a1 AND d1 THEN 'Example' WHEN a2 AND d2 THEN 'Net' WHEN d1 THEN 'Example' WHEN d2 THEN 'Net' WHEN a1 THEN 'Example' WHEN a2 THEN 'Net' END AS name,
 CASE WHEN d1 THEN 'high' WHEN d2 THEN 'medium' ELSE 'low' END AS trust, d1 OR d2 AS explicit_identity, false AS online_allowed FROM f AS y"""
add("organizer_match", organizer_query, _ORG.replace("{h}", scalars._HOST))


# digest text
def digest_render(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select("o_orderkey", F.concat_ws("\n", F.concat(F.lit("• "), "c_name"), ist_display(F.col("o_orderdate")), F.when(F.col("o_orderkey") % 2 == 0, X.label(F.lower("c_mktsegment"))), F.concat(F.lit("Score "), F.floor(F.col("o_totalprice") / 1000).cast("string"))).alias("block"))


add("digest_render", digest_render, "SELECT o_orderkey, concat_ws(chr(10), '• ' || c_name, strftime(o_orderdate + INTERVAL 330 MINUTE, '%a, %d %b · %-I:%M %p IST'), CASE WHEN o_orderkey % 2 = 0 THEN replace(lower(c_mktsegment), '_', ' ') END, 'Score ' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR)) AS block FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey")
add("chunk_pack", lambda spark, sf: read(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("blocks")).select("conv_id", F.posexplode(folds.pack_chunks(F.col("blocks"))).alias("chunk_index", "body")))
def span_query(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as spans of their conversation's characters, with five characters between or more in common."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    c = read(spark, sf, "conversations").withColumn("lo", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    return overlapping(c.withColumn("hi", F.col("lo") + F.length("text")), 1000, -5, 5)


add("span_overlap", span_query, "WITH c AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, length(text) AS n FROM conversations AS c0) SELECT a.conv_id, a.turn, b.turn AS other FROM c AS a JOIN c AS b ON a.conv_id = b.conv_id AND a.lo < b.lo + b.n - 5 AND a.lo + a.n > b.lo - 5 AND a.turn <> b.turn")
add("event_payload", lambda spark, sf: read(spark, sf, "pages").select("page_id", F.to_json(F.struct("page_id", U.safe_outbound(F.col("url")).alias("url"))).alias("payload")), f"SELECT page_id, '{{\"page_id\":' || CAST(page_id AS VARCHAR) || ',\"url\":\"' || {scalars._PLAIN} || '\"}}' AS payload FROM pages AS p")


def revert_schedule(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    c = e.select(F.col("user_id").alias("event_id"), F.col("event_id").alias("id"), F.lag("event_type").over(order).alias("old_value"), F.col("event_type").alias("new_value"), F.col("ts").alias("observed_at"), F.row_number().over(order).alias("no")).filter("no >= 2")
    now = c.groupBy("event_id").agg(F.max_by("new_value", F.struct("observed_at", "id")).alias("starts_at"))
    return folds.reverted_schedules(c.drop("no").join(now, "event_id").withColumn("ends_at", F.lit(None).cast("string")))


add("revert_schedule", revert_schedule)


def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rules between the fields of a source's definition; one row per rule that fails."""
    rows = [("good", "public_page", "https://a.org", None, 1, None, [], None), ("s", "public_page", "http://localhost/x", None, 3, None, [], None), ("feed", "search", None, " ", 1, None, ["b.org", "B.org."], None), ("page", "public_page", None, None, 9, "p", [], "Nowhere/City"), ("find", "search", None, "ai", 1, None, ["-bad"], "UTC")]
    df = spark.createDataFrame(rows, "name string, adapter string, url string, query string, max_pages int, pagination_param string, allowed_domains array<string>, source_timezone string")
    have = set(df.columns)
    kinds = dict(f.split(" ") for f in registry.SOURCE.split(", "))
    return registry.source_violations(df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in have)))


add("contract_violations", contract_violations, """SELECT * FROM (VALUES ('s', 'the name is malformed'), ('s', 'url is not public'), ('s', 'paging needs a parameter'), ('feed', 'a search source needs a query'), ('feed', 'allowed_domains repeat'),
 ('page', 'a page source needs a url'), ('page', 'max_pages is out of range'), ('page', 'the time zone is unknown'), ('find', 'allowed_domains are malformed')) AS t(name, violation)""")
