"""From listing pages and search results to the detail pages they lead to: a frontier of urls met with stored pages, hop by hop.

A hop joins the frontier of every source with the pages that were fetched, reads the links of what it finds, leaves out what the
source has met before, and keeps the first so many by the order in which they were seen. Nothing is fetched here; a url
without a stored page is a visit that failed.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions import url as U
from siftwell.sources import extract as E
from siftwell.sources import html as H

#: Search results that are looked at, of one query.
MOST_RESULTS = 12


class Hydrated(NamedTuple):
    candidates: DataFrame
    visits: DataFrame


def _address(url: Column) -> Column:
    """What a url and a stored page meet by."""
    return F.coalesce(U.normalize(url), F.regexp_replace(F.trim(url), "#.*$", ""))


def hydrate(sources: DataFrame, pages: DataFrame, seeds: DataFrame | None = None, hops: int = 1) -> Hydrated:
    """Candidates of all sources, as ``ingest.ingest`` takes them, and one row for each visit.

    sources: source_name, urls (listing pages in order; null for a search), detail_selector, detail_prefixes, max_detail_pages,
    perhaps platform, zone and dayfirst. pages: url, html, observed_at; of several of one url the latest counts. seeds:
    source_name, url, place, the results of searches, MOST_RESULTS of each source.

    visits: source_name, hop, place, url, page_url, status, n_found. A status is ok, missing (no page is stored), unreadable (no html), or challenge
    (the page asks for a proof of being human). A source with a listing that is not ok has failed: its other pages are
    not visited and give no candidates (status ``skipped``). A search result or detail page that is not ok is left out alone.
    A search result is never an event by itself: only its page is read. Links without a selector lead nowhere. Empty
    tables give empty results; other columns are ignored.
    """
    c = F.col
    extra = {"platform": "string", "zone": "string", "dayfirst": "boolean", "detail_selector": "string", "detail_prefixes": "array<string>", "max_detail_pages": "int"}
    own = sources.select("source_name", "urls", *((c(n) if n in sources.columns else F.lit(None)).cast(t).alias(n) for n, t in extra.items()))
    stored = pages.withColumn("address", _address(c("url"))).filter("address IS NOT NULL").groupBy("address").agg(F.max_by(F.struct(c("url").alias("page_url"), "html", "observed_at"), F.struct("observed_at", "url")).alias("p")).select("address", "p.*")
    listed = own.select("source_name", F.posexplode("urls").alias("place", "url")).withColumn("listing", F.lit(True))
    if seeds is not None:
        order = Window.partitionBy("source_name").orderBy("place", "url")
        first = seeds.join(own.filter("urls IS NULL").select("source_name"), "source_name", "left_semi").withColumn("no", F.row_number().over(order)).filter(c("no") <= MOST_RESULTS)
        listed = listed.unionByName(first.select("source_name", (c("no") - 1).alias("place"), "url", F.lit(False).alias("listing")))
    frontier = _once(listed.withColumn("address", _address(c("url"))))
    met, parts, failed = None, [], None
    for hop in range(hops + 1):
        seen = frontier.join(stored, "address", "left").withColumn("hop", F.lit(hop))
        status = F.when(c("page_url").isNull(), "missing").when(c("html").isNull(), "unreadable").when(F.coalesce(H.is_interstitial(c("html")), F.lit(False)), "challenge").otherwise("ok")
        seen = seen.withColumn("status", status).checkpoint()
        if hop == 0:
            failed = seen.filter("listing AND status <> 'ok'").select("source_name").distinct()
            seen = seen.join(failed.withColumn("bad", F.lit(True)), "source_name", "left").withColumn("status", F.when(c("bad") & (c("status") == "ok"), "skipped").otherwise(c("status"))).drop("bad")
        parts.append(seen)
        if hop == hops:
            break
        addresses = frontier.select("source_name", "address")
        met = addresses if met is None else met.unionByName(addresses)
        links = H.column(lambda h, u, s, p: H.detail_links(h, u, s, list(p), 1 << 30), T.ArrayType(T.StringType()), c("html"), c("page_url"), c("detail_selector"), c("detail_prefixes"))
        leads = seen.filter("status = 'ok'").join(own.filter("detail_selector IS NOT NULL AND detail_prefixes IS NOT NULL"), "source_name").select("source_name", "max_detail_pages", "place", F.posexplode(links).alias("at", "url"))
        fresh = leads.withColumn("address", _address(c("url"))).groupBy("source_name", "address").agg(F.min_by(F.struct("url", "max_detail_pages"), F.struct("place", "at")).alias("x"), F.min(F.struct("place", "at")).alias("first")).join(met, ["source_name", "address"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("source_name").orderBy("first"))
        frontier = fresh.withColumn("no", rank).filter(c("no") <= F.coalesce("x.max_detail_pages", F.lit(0))).select("source_name", (c("no") - 1).alias("place"), "x.url", F.lit(False).alias("listing"), "address")
    visits = parts[0]
    for part in parts[1:]:
        visits = visits.unionByName(part)
    read = visits.filter("status = 'ok'").join(own.select("source_name", "platform", "zone", "dayfirst"), "source_name")
    rows = read.select((c("hop").cast("long") * (1 << 32) + c("place")).alias("page_id"), "html", c("page_url").alias("url"), "source_name", "observed_at", "platform", "zone", "dayfirst")
    found = F.when(c("status") == "ok", F.size(E.page_finds(c("html"), c("page_url"), *(c(n) for n in ("platform", "zone", "dayfirst")))))
    told = visits.join(own.select("source_name", "platform", "zone", "dayfirst"), "source_name").select("source_name", "hop", "place", "url", "page_url", "status", found.alias("n_found"))
    return Hydrated(E.candidates(rows), told)


def _once(frontier: DataFrame) -> DataFrame:
    """Each address of a source once, where it is seen first."""
    row = F.struct("place", "url", "listing")
    return frontier.groupBy("source_name", "address").agg(F.min(row).alias("x")).select("source_name", "address", "x.*")
