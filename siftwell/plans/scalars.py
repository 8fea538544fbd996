"""Registered queries: scalar functions on documents, pages and orders, and on fixed cases."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions import time as Z
from siftwell.functions import url as U
from siftwell.operators.events import assess, score
from siftwell.plans.relational import read

QUERIES, ORACLE = {}, {}


def add(name: str, make, sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql:
        ORACLE[name] = sql


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S.%f}'"
    return str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"


def cases(name: str, columns: str, rows: list[tuple], result, kind: str) -> None:
    """A query over fixed cases: the last value of a row is what ``result``, given the other columns, must be."""
    names = [c.split()[0] for c in columns.split(", ")]

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], f"case_no int, {columns}")
        return df.select("case_no", result(*(F.col(n) for n in names)).cast(kind).alias("result"))

    sql_kind = {"string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER", "long": "BIGINT"}[kind]
    add(name, make, "SELECT CAST(case_no AS INTEGER) AS case_no, CAST(result AS " + sql_kind + ") AS result FROM (VALUES " + ", ".join(f"({i}, {_sql(r[-1])})" for i, r in enumerate(rows)) + ") AS t(case_no, result)")


# URLs
_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])utm_[^=&]*=[^&]*', '\1'), '[?&]+$', '')"
add("url_normalize", lambda spark, sf: read(spark, sf, "pages").select("page_id", U.normalize(F.col("url")).alias("url")), f"SELECT page_id, {_PLAIN} AS url FROM pages AS p")
add("url_identity", lambda spark, sf: read(spark, sf, "pages").select(U.identity(F.col("url")).alias("identity")).groupBy("identity").agg(F.count("*").alias("n")), f"SELECT {_PLAIN} AS identity, count(*) AS n FROM pages AS p GROUP BY 1")
add("url_prefix", lambda spark, sf: read(spark, sf, "pages").filter(F.col("url").startswith("https://blog.")).select("page_id", "url"), "SELECT page_id, url FROM pages AS p WHERE starts_with(url, 'https://blog.')")
add("url_join_absolute", lambda spark, sf: read(spark, sf, "pages").select("page_id", F.concat(U.scheme(F.col("url")), F.lit("://"), U.host(F.col("url")), F.lit("/events")).alias("link")), r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/events' AS link FROM pages AS p")


def domain_allow(spark: SparkSession, sf: str) -> DataFrame:
    """An equi-join on the suffixes of the host; the list of domains is short."""
    allowed = spark.createDataFrame([("example.org",), ("m.example.com",), ("therha.example.com",)], "domain string")
    pages = read(spark, sf, "pages").select("page_id", F.explode(U.host_suffixes(U.host(F.col("url")))).alias("domain"))
    return pages.join(allowed, "domain", "left_semi").select("page_id").distinct()


_HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
add("domain_allow", domain_allow, f"SELECT page_id FROM (SELECT page_id, {_HOST} AS h FROM pages AS p) AS t WHERE " + " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in ("example.org", "m.example.com", "therha.example.com")))
add("boundary_validate", lambda spark, sf: read(spark, sf, "pages").filter(U.is_valid(F.col("url"))).select("page_id", F.when(U.host(F.col("url")).endswith(".example.org"), F.col("url")).alias("registration_url")), f"SELECT page_id, CASE WHEN ends_with({_HOST}, '.example.org') THEN url END AS registration_url FROM pages AS p")
add("listing_pages", lambda spark, sf: read(spark, sf, "pages").select("page_id", F.explode(U.pages_of(F.col("url"), F.lit("p"), F.lit(3))).alias("url")), "SELECT page_id, CASE WHEN i = 1 THEN u ELSE u || CASE WHEN contains(u, '?') THEN '&' ELSE '?' END || 'p=' || CAST(i AS VARCHAR) END AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages AS p) AS t, (VALUES (1), (2), (3)) AS n(i)")
cases("url_valid", "url string", [
    ("https://example.org", True), ("http://user:pw@example.org/", False), ("ftp://example.org", False), ("https://localhost/x", False), ("https://a.localhost", False), ("http://10.0.0.1/", False),
    ("http://8.8.8.8/x", True), ("http://192.168.1.4", False), ("http://169.254.1.1", False), ("http://100.64.0.1", False), ("https://", False), ("nothing", False), (None, False), ("https://example.org:8443/a?b#c", True), ("https://[::1]/", False),
], U.is_valid, "boolean")
cases("url_normal_cases", "url string", [
    ("HTTPS://Example.ORG", "https://example.org/"), ("https://example.org/a?utm_source=x&b=1&UTM_Medium=y&a=", "https://example.org/a?b=1&a="), ("https://example.org/a?q=x%20y&fbclid=1#top", "https://example.org/a?q=x+y"),
    ("http://example.org:8080/p", "http://example.org:8080/p"), ("ftp://example.org", None), ("https://www.nvidia.com/en-us/about-nvidia/webinar-portal/#/webinar/123", "https://www.nvidia.com/en-us/about-nvidia/webinar-portal/#/webinar/123"),
    ("https://www.nvidia.com/en-us/about-nvidia/webinar-portal/#/webinar/x", "https://www.nvidia.com/en-us/about-nvidia/webinar-portal/"),
], U.normalize, "string")
cases("url_identity_cases", "url string", [
    ("https://www.meetup.com/group/events/123/?recId=a&eventOrigin=b&x=1", "https://www.meetup.com/group/events/123?x=1"), ("https://meetup.com/events/9/", "https://meetup.com/events/9"), ("https://www.meetup.com/group/", "https://www.meetup.com/group/"), ("not a url", "not a url"),
], U.identity, "string")
cases("url_same_dest", "a string, b string", [("https://A.org/?utm_x=1", "https://a.org", True), ("https://a.org/x", "https://a.org/y", False), (None, None, False), ("", "", False)], U.same_destination, "boolean")
cases("ip_public", "ip string", [("10.1.2.3", False), ("8.8.4.4", True), ("172.16.0.1", False), ("172.32.0.1", True), ("127.0.0.1", False), ("224.0.0.1", False), ("192.0.2.9", False), ("198.51.100.7", False), ("300.1.1.1", None), ("x", None)], U.is_public_ipv4, "boolean")
cases("domain_valid", "d string", [("Example.ORG.", True), ("a-b.example.com", True), ("-a.com", False), ("com", False), ("a..com", False), ("ex ample.com", False), ("", False)], U.domain_ok, "boolean")

# text
def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text")


#: A character of a word, in both engines: letters, marks, digits and connectors of Unicode.
_NO_WORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"


def _has(words: str) -> str:
    return f"regexp_matches(lower(coalesce(text, '')), '(^|{_NO_WORD})({words})($|{_NO_WORD})')"


add("phrase_match", lambda spark, sf: documents(spark, sf).filter(X.phrase(F.col("text"), "the")).select("doc_id"), f"SELECT doc_id FROM documents AS d WHERE {_has('the')}")
add("term_exclude", lambda spark, sf: documents(spark, sf).filter(~X.any_phrase(F.col("text"), ["license", "idiot", "scum"])).select("doc_id"), f"SELECT doc_id FROM documents AS d WHERE NOT {_has('license|idiot|scum')}")
add("term_include", lambda spark, sf: documents(spark, sf).filter(X.any_phrase(F.col("text"), ["ai", "license"])).select("doc_id"), f"SELECT doc_id FROM documents AS d WHERE {_has('ai|license')}")
add("term_substring", lambda spark, sf: read(spark, sf, "documents").filter(X.contains_any(F.col("text"), ["free", "ended"])).select("doc_id"), "SELECT doc_id FROM documents AS d WHERE contains(lower(text), 'free') OR contains(lower(text), 'ended')")
add("text_clean", lambda spark, sf: read(spark, sf, "conversations").select("conv_id", "turn", F.md5(X.clean(F.col("text")).cast("binary")).alias("digest")), r"SELECT conv_id, turn, md5(nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '')) AS digest FROM conversations AS c")
add("truncate_ellipsis", lambda spark, sf: documents(spark, sf).select("doc_id", X.capped(F.col("text"), 40).alias("short")), "SELECT doc_id, CASE WHEN length(text) > 40 THEN rtrim(left(text, 39), ' ') || '…' ELSE text END AS short FROM documents AS d")
add("normalized_key", lambda spark, sf: read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", X.normalized_key(F.col("c_name"), F.col("c_mktsegment"), F.col("o_orderdate"), F.lit(None).cast("string"), F.col("o_orderpriority"), F.lit("online")).alias("key")), "SELECT o_orderkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') || ':' || regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '', 'g') || ':' || strftime(o_orderdate, '%Y%m%d%H%M') || ':' || regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g') || ':online' AS key FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey")
add("text_combine", lambda spark, sf: read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("x")).select("l_orderkey", X.combine_all(F.transform("x", lambda s: s["l_returnflag"])).alias("text")).groupBy("text").agg(F.count("*").alias("n")))  # a fold of three texts and more is beyond SQL
cases("term_words", "t string", [("Salesforce AI Engineering Workshop", False), ("AI sales workshop", True), ("Founder's evening", True), ("cofounders", False), (None, False), ("Job fair for all", True)], lambda t: X.excluded(t, F.lit(None).cast("string")), "boolean")
cases("location_word", "city string, venue string", [("Bengaluru", None, True), (None, "Hall, BLR", True), ("Bangalored", None, False), ("Pune", "Old bangalore road", True), (None, None, False)], X.in_city, "boolean")
cases("classify_type", "t string", [("AI Buildathon", "buildathon"), ("Hackathon and workshop", "hackathon"), ("Coding Challenge", "competition"), ("Hands-on lab", "workshop"), ("Cloud Summit", "conference"), ("A webinar", "talk"), ("Dinner", "unknown"), ("Meetup: talk", "meetup")], X.event_type, "string")
cases("classify_registration", "t string", [(" Open ", "open"), ("Event cancelled", "cancelled"), ("postponed to May", "postponed"), ("SOLD OUT", "sold_out"), ("almost full, join waitlist", "open"), ("Join the waitlist", "waitlist"), ("Registration closed", "closed"), ("recommended", "closed"), ("Register by Friday", "open"), ("registrations are now open", "open"), ("disclosed", "unknown"), (None, "unknown"), ("tickets available", "open")], X.registration_state, "string")
cases("classify_schema_state", "s string, a string", [("https://schema.org/EventCancelled", None, "cancelled"), ("EventPostponed", "InStock", "postponed"), (None, "https://schema.org/SoldOut", "sold_out"), ("EventScheduled", "InStock", "open"), ("EventScheduled", None, "unknown"), (None, "Discontinued", "closed")], X.schema_state, "string")
cases("classify_format", "m string, o string, v string", [("OfflineEventAttendanceMode", None, None, "in_person"), ("OnlineEventAttendanceMode", None, "Hall", "online"), ("MixedEventAttendanceMode", None, None, "hybrid"), ("in person and online", None, None, "hybrid"), (None, "true", None, "online"), (None, None, "Virtual room", "online"), (None, None, "Hall 3", "in_person"), (None, None, None, "unknown")], X.attendance, "string")
cases("price_paid", "p string", [("499", True), ("0", False), (" 499 INR ", True), ("EUR50", True), ("INR 499–999", True), ("₹499 onwards", True), ("Nada", False), ("Free entry", False), ("free for members, Rs. 200 others", True), ("paid admission", True), ("₹0", False), ("from 10", True), ("10 to 20", True), ("see website", False), (None, False), ("0.00", False)], X.is_paid, "boolean")
cases("price_status", "p string, f boolean", [("499", None, "paid"), ("0", None, "free"), ("INR 0", False, "free"), ("No cost", None, "free"), ("nada", None, "not_stated"), (None, True, "paid"), (None, None, "not_stated")], X.price_status, "string")
cases("price_normalize", "p string", [("  499   INR ", "499 INR"), ("", None), (None, None), ("Free", "Free")], X.normalize_price, "string")
cases("html_escape", "t string", [("<a href=\"x\">'&'</a>", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;"), (None, None)], X.escape_html, "string")
cases("json_fenced", "t string", [("```json\n{\"a\": 1}\n```", "1"), ("{\"a\": 2}", "2"), ("no json", None), ("```\n{\"a\": 3}```", "3")], lambda t: F.get_json_object(X.unfenced_json(t), "$.a"), "string")

# time
at = dt.datetime
cases("iso_parse", "t string", [("2026-10-10T18:30:00+05:30", at(2026, 10, 10, 13)), ("2026-10-10T18:30", at(2026, 10, 10, 13)), ("2026-10-10", at(2026, 10, 9, 18, 30)), ("2026-10-10T10:00:00Z", at(2026, 10, 10, 10)), ("12:30", None), ("soon", None), (None, None), ("2026-13-10", None), ("20261010T1830", at(2026, 10, 10, 13)), ("2026-W41-6", at(2026, 10, 9, 18, 30)), ("2026W41", at(2026, 10, 4, 18, 30)), ("2026-283T10Z", at(2026, 10, 10, 10)), ("2026-10-10T24:00Z", at(2026, 10, 11)), ("2026-10-10T24:01Z", None), ("2026-10-10T10:00:00,25+0530", at(2026, 10, 10, 4, 30, 0, 250000)), ("2026-10", at(2026, 9, 30, 18, 30)), ("2026-02-30", None), ("2026-10-10T25:00", None), ("2026-10-10T10:00-08", at(2026, 10, 10, 18))], lambda t: Z.iso_parse(t, "Asia/Kolkata"), "timestamp_ntz")
cases("epoch_ms", "t string", [("1700000000000", at(2023, 11, 14, 22, 13, 20)), ("0", None), ("-5", None), ("true", None), ("nan", None), ("inf", None), (None, None)], Z.epoch_millis, "timestamp_ntz")
add("ist_format", lambda spark, sf: read(spark, sf, "events").select("event_id", Z.ist_display(F.col("ts")).alias("shown")), "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%a, %d %b · %-I:%M %p IST') AS shown FROM events AS e")
add("ist_date", lambda spark, sf: read(spark, sf, "events").groupBy(Z.ist_date(F.col("ts")).alias("day")).agg(F.count("*").alias("n")), "SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day, count(*) AS n FROM events AS e GROUP BY 1")


def ist_day_filter(spark: SparkSession, sf: str) -> DataFrame:
    low, high = (Z.day_bound("2024-01-10", end)[0].replace(tzinfo=None) for end in (False, True))
    return read(spark, sf, "events").filter((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).select("event_id", "ts")


add("ist_day_filter", ist_day_filter, "SELECT event_id, ts FROM events AS e WHERE ts >= TIMESTAMP '2024-01-09 18:30:00' AND ts < TIMESTAMP '2024-01-10 18:30:00'")
NOW = dt.datetime(2001, 6, 1)
add("urgency", lambda spark, sf: read(spark, sf, "orders").select("o_orderkey", Z.urgency(F.col("o_orderdate"), F.lit(NOW)).alias("urgency")), "SELECT o_orderkey, CAST(CASE WHEN o_orderdate < TIMESTAMP '2001-06-01' THEN 0 WHEN o_orderdate <= TIMESTAMP '2001-06-03' THEN 4 WHEN o_orderdate <= TIMESTAMP '2001-06-08' THEN 2 ELSE 0 END AS INTEGER) AS urgency FROM orders AS o")
add("within_window", lambda spark, sf: read(spark, sf, "orders").filter(Z.within_window(F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(dt.datetime(2001, 3, 30))).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), F.lit(dt.datetime(2001, 4, 1)).cast("timestamp_ntz"))).select("o_orderkey"), "SELECT o_orderkey FROM orders AS o WHERE o_orderdate >= TIMESTAMP '2001-03-31' AND (o_orderdate <= TIMESTAMP '2001-05-31' OR (o_orderkey % 2 = 0 AND o_orderdate <= TIMESTAMP '2001-09-28'))")
add("iso_text", lambda spark, sf: read(spark, sf, "orders").select("o_orderkey", Z.iso_text(F.col("o_orderdate")).alias("text")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS text FROM orders AS o")


# score and policy
def _flags(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", (k % 11 == 0).alias("paid"), (k % 7 == 0).alias("excluded"), (k % 13 == 0).alias("ineligible"), F.when(k % 5 == 0, "closed").otherwise("open").alias("registration_state"), F.when(k % 3 == 0, F.lit(dt.datetime(2001, 5, 1))).cast("timestamp_ntz").alias("registration_deadline"), (F.col("o_orderdate") > F.lit(dt.datetime(1996, 1, 1))).alias("in_window"), (k % 2 == 0).alias("place_ok"), ((k % 17 == 0) | (k % 19 == 0)).alias("ambiguous"), (k % 8 == 0).alias("approval"), F.when((k % 17 == 0) & (k % 4 == 0), "unavailable").when(k % 17 == 0, None).when(k % 4 == 0, "no").otherwise("yes").alias("verdict"), F.floor(F.col("o_totalprice") / 50000).cast("long").alias("score"))


add("policy_assess", lambda spark, sf: assess(_flags(spark, sf), F.lit(NOW).cast("timestamp_ntz"), 3).select("o_orderkey", "status", "reason", "score", "approval_required"), """WITH f AS (SELECT o_orderkey AS k, o_orderdate, CAST(floor(o_totalprice / 50000) AS BIGINT) AS score FROM orders AS o),
 g AS (SELECT k, score, CASE WHEN k % 11 = 0 THEN 'rejected|Explicitly paid admission' WHEN k % 7 = 0 THEN 'rejected|Excluded event category' WHEN k % 13 = 0 THEN 'rejected|Explicitly incompatible eligibility' WHEN k % 5 = 0 THEN 'rejected|Registration is closed'
 WHEN k % 3 = 0 THEN 'needs_review|Registration deadline has passed' WHEN NOT o_orderdate > TIMESTAMP '1996-01-01' THEN 'needs_review|Missing or out-of-window start time' WHEN k % 2 <> 0 THEN 'rejected|Not Bengaluru or trusted global online'
 WHEN k % 17 = 0 AND k % 4 = 0 THEN 'needs_review|Ambiguous candidate; AI classification unavailable' WHEN k % 17 = 0 THEN 'needs_review|Ambiguous technical fit'
 WHEN k % 19 = 0 AND k % 4 = 0 THEN 'rejected|AI classification rejected ambiguous candidate' WHEN score < 3 THEN 'needs_review|Below deterministic ranking threshold' ELSE 'eligible|Technical event matching location and time policy' END AS s FROM f AS x)
 SELECT k AS o_orderkey, split_part(s, '|', 1) AS status, split_part(s, '|', 2) AS reason, CASE WHEN s LIKE 'eligible|%' OR s LIKE '%threshold' THEN score ELSE 0 END AS score,
 k % 8 = 0 AND (s LIKE 'eligible|%' OR s LIKE '%threshold' OR s LIKE 'needs_review|Ambiguous%') AS approval_required FROM g AS y""")


def score_query(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k, now = F.col("o_orderkey"), F.lit(NOW).cast("timestamp_ntz")
    pick = lambda m, *v: F.element_at(F.array(*map(F.lit, v)), (k % m + 1).cast("int"))
    return o.select("o_orderkey", score(k % 2 == 0, pick(2, "talk", "unknown"), pick(3, "high", "medium", "low"), k % 4 == 0, pick(2, "online", "hybrid"), pick(3, "open", "waitlist", "closed"), k % 3, F.col("o_orderdate"), F.when(k % 5 == 0, F.col("o_orderdate")), now).cast("long").alias("score"))


add("score", score_query, """SELECT o_orderkey, CAST((CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END) + (CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END)
 + (CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 4 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + (CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)
 + (CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderdate BETWEEN TIMESTAMP '2001-06-01' AND TIMESTAMP '2001-06-08' THEN 2 ELSE 0 END) + (CASE WHEN o_orderkey % 5 = 0 AND o_orderdate >= TIMESTAMP '2001-05-25' THEN 1 ELSE 0 END) AS BIGINT) AS score FROM orders AS o""")
