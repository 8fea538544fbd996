"""Registries of sources and organizers, and the rules that their rows must meet."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.constants import IST
from siftwell.functions.text import casefold
from siftwell.functions.url import domain_ok, is_valid

SOURCE = (
    "name string, adapter string, url string, query string, enabled boolean, priority boolean, cadence_hours int, rate_limit_seconds double, platform string, max_pages int, pagination_param string, profile_url string, "
    "allowed_domains array<string>, detail_link_prefixes array<string>, detail_link_selectors array<string>, max_detail_pages int, allowed_registration_domains array<string>, source_timezone string, date_dayfirst boolean"
)
ORGANIZER = "name string, aliases array<string>, domains array<string>, trust string, online_allowed boolean, source_profiles array<string>"
# Names, defaults and bounds of the registry format.
NAME = r"^[a-z][a-z0-9_]{1,63}$"
DEFAULTS = {"enabled": True, "priority": False, "cadence_hours": 3, "rate_limit_seconds": 3.0, "max_pages": 1, "max_detail_pages": 0, "source_timezone": IST, "date_dayfirst": True}
LISTS = ("allowed_domains", "detail_link_prefixes", "detail_link_selectors", "allowed_registration_domains")
BOUNDS = {"cadence_hours": (1, 24), "rate_limit_seconds": (0, None), "max_pages": (1, 5), "max_detail_pages": (0, 10)}
MOST_RULES, SELECTOR_CHARS = 8, 200


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sources, with defaults."""
    return with_defaults(spark.read.schema(SOURCE).json(path, multiLine=True))


def read_organizers(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of organizers; ``position`` is the place in it."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ORGANIZER.split(', '))}>>")).alias("position", "o"))
    return rows.select("position", "o.*").withColumns({"trust": F.coalesce("trust", F.lit("low")), "online_allowed": F.coalesce("online_allowed", F.lit(False))})


def with_defaults(sources: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    out = sources.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()} | {c: F.coalesce(c, none) for c in LISTS})
    tidy = lambda c: F.transform(c, lambda x: F.rtrim(F.lower(F.trim(x)), F.lit(".")))
    return out.withColumns({"query": F.trim("query"), "allowed_domains": tidy("allowed_domains"), "allowed_registration_domains": tidy("allowed_registration_domains"), "detail_link_prefixes": F.transform("detail_link_prefixes", _trim), "detail_link_selectors": F.transform("detail_link_selectors", _trim)})


def _trim(x: Column) -> Column:
    return F.trim(x)


def _repeated(c: str) -> Column:
    return F.size(F.array_distinct(c)) < F.size(c)


def _found(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    told = F.array(*(F.when(F.coalesce(bad, F.lit(False)), said) for said, bad in rules.items()))
    return rows.select("name", F.explode(F.array_compact(told)).alias("violation"))


def _shared_names(rows: DataFrame, name: Column) -> DataFrame:
    twice = rows.groupBy(name.alias("n")).agg(F.count("*").alias("c"), F.min("name").alias("name")).filter("c > 1")
    return twice.select("name", F.lit("the name is used more than once").alias("violation"))


def source_violations(sources: DataFrame) -> DataFrame:
    """(name, violation), one row for each rule that a source with its defaults breaks. A null list or value has its default."""
    c, rows = F.col, with_defaults(sources)
    page, search = c("adapter") == "public_page", c("adapter") == "search"
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    links = (F.size("detail_link_prefixes") > 0) | (F.size("detail_link_selectors") > 0)
    path = lambda p: p.startswith("/") & ~p.startswith("//")
    rules = {
        "the name is malformed": ~F.coalesce(c("name").rlike(NAME), F.lit(False)), "the adapter is unknown": ~F.coalesce(page | search, F.lit(False)),
        "a page source needs a url": page & blank("url"), "a page source has no query": page & ~blank("query"), "a search source needs a query": search & blank("query"),
        "a search source has no url": search & ~blank("url"), "a search source needs domains": search & (F.size("allowed_domains") == 0), "paging needs a parameter": (c("max_pages") > 1) & blank("pagination_param"),
        "only page sources read details": ~page & links, "details need a prefix or a selector": (c("max_detail_pages") > 0) & ~links, "detail rules need a number of pages": links & (c("max_detail_pages") == 0),
        "the time zone is unknown": ~c("source_timezone").isin(*sorted(available_timezones())),
    }
    rules |= {f"{u} is not public": c(u).isNotNull() & ~is_valid(c(u)) for u in ("url", "profile_url")}
    rules |= {f"{n} is out of range": (c(n) < low) | (c(n) > high if high is not None else F.lit(False)) for n, (low, high) in BOUNDS.items()}
    rules |= {f"{d} are malformed": F.exists(d, lambda x: ~F.coalesce(domain_ok(x), F.lit(False))) for d in ("allowed_domains", "allowed_registration_domains")}
    rules |= {f"{n} repeat": _repeated(n) for n in LISTS} | {f"{n} are too many": F.size(n) > MOST_RULES for n in ("detail_link_prefixes", "detail_link_selectors")}
    rules["detail_link_prefixes are malformed"] = F.exists("detail_link_prefixes", lambda p: ~F.coalesce(path(p) | (~p.startswith("/") & is_valid(p)), F.lit(False)))
    rules["detail_link_selectors are malformed"] = F.exists("detail_link_selectors", lambda s: ~F.coalesce(F.length(s).between(1, SELECTOR_CHARS), F.lit(False)))
    return _found(rows, rules).unionByName(_shared_names(rows, c("name")))


def organizer_violations(organizers: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, violation) of organizers; a profile must be the name of a source."""
    none, c = F.array().cast("array<string>"), F.col
    rows = organizers.withColumns({"domains": F.transform(F.coalesce("domains", none), lambda d: F.rtrim(F.lower(F.trim(d)), F.lit("."))), "source_profiles": F.transform(F.coalesce("source_profiles", none), _trim), "trust": F.coalesce("trust", F.lit("low"))})
    rules = {
        "the name is missing": c("name").isNull(), "the trust is unknown": ~c("trust").isin("high", "medium", "low"), "domains are malformed": F.exists("domains", lambda d: ~F.coalesce(domain_ok(d), F.lit(False))),
        "domains repeat": _repeated("domains"), "source_profiles are malformed": F.exists("source_profiles", lambda p: ~F.coalesce(p.rlike(NAME), F.lit(False))), "source_profiles repeat": _repeated("source_profiles"),
    }
    unknown = rows.select("name", F.explode("source_profiles").alias("source")).join(sources.select(c("name").alias("source")), "source", "left_anti")
    unknown = unknown.select("name", F.lit("a profile names no source").alias("violation")).distinct()
    return _found(rows, rules).unionByName(_shared_names(rows.dropna(subset=["name"]), casefold(c("name")))).unionByName(unknown)


def profiles(organizers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Organizers with ``position`` -> (aliases, domains, profiles), as ``organizer_match`` takes them. The name is an alias."""
    none = F.array().cast("array<string>")
    names = F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", none)))
    each = lambda x, n: organizers.select("position", F.explode(x).alias(n)).distinct()
    return each(names, "alias"), each(F.transform("domains", lambda d: F.rtrim(F.lower(F.trim(d)), F.lit("."))), "domain"), each(F.transform("source_profiles", _trim), "source_name")
