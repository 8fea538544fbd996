"""Registries are read with defaults, and each broken rule is told once."""

from __future__ import annotations

import json

from siftwell.sources import registry as R


def test_registries(spark, tmp_path):
    sources = [
        {"name": "feed_one", "adapter": "public_page", "url": "https://a.org/events", "detail_link_prefixes": ["/e/"], "max_detail_pages": 2},
        {"name": "find", "adapter": "search", "query": " ai ", "allowed_domains": ["A.org."]},
        {"name": "feed_one", "adapter": "public_page", "url": "https://a.org", "query": "q", "detail_link_prefixes": ["//b.org", "ftp://x"], "detail_link_selectors": ["a", " a ", ""], "cadence_hours": 99},
        {"name": "other", "adapter": "search", "query": "q", "url": "https://a.org", "max_detail_pages": 1, "rate_limit_seconds": -1, "profile_url": "https://u:p@a.org"},
        {"adapter": None},
    ]
    organizers = [
        {"name": "Club", "aliases": ["The Club"], "domains": ["Club.org"], "trust": "high", "source_profiles": ["feed_one"]}, {"name": "CLUB", "source_profiles": ["gone", "gone"]}, {"name": "Bad", "trust": "some", "domains": ["https://x"], "source_profiles": ["No"]},
    ]
    for name, rows in (("s", sources), ("o", organizers)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
    s, o = R.read_sources(spark, str(tmp_path / "s.json")), R.read_organizers(spark, str(tmp_path / "o.json"))
    first = s.filter("name = 'find'").first()
    assert (first.query, first.allowed_domains, first.cadence_hours, first.source_timezone, first.enabled) == ("ai", ["a.org"], 3, "Asia/Kolkata", True)
    assert sorted(map(tuple, R.source_violations(s).collect()), key=str) == sorted([
        ("feed_one", "a page source has no query"), ("feed_one", "cadence_hours is out of range"), ("feed_one", "detail_link_prefixes are malformed"), ("feed_one", "detail_link_selectors are malformed"),
        ("feed_one", "detail_link_selectors repeat"), ("feed_one", "detail rules need a number of pages"), ("feed_one", "the name is used more than once"),
        ("other", "a search source has no url"), ("other", "a search source needs domains"), ("other", "details need a prefix or a selector"), ("other", "rate_limit_seconds is out of range"), ("other", "profile_url is not public"),
        (None, "the adapter is unknown"), (None, "the name is malformed"),
    ], key=str)
    assert sorted(map(tuple, R.organizer_violations(o, s).collect())) == sorted([
        ("CLUB", "the name is used more than once"), ("CLUB", "source_profiles repeat"), ("CLUB", "a profile names no source"),
        ("Bad", "the trust is unknown"), ("Bad", "domains are malformed"), ("Bad", "source_profiles are malformed"), ("Bad", "a profile names no source"),
    ])
    aliases, domains, profiles = R.profiles(o.filter("position = 0"))
    assert sorted(r.alias for r in aliases.collect()) == ["Club", "The Club"]
    assert (domains.first().domain, profiles.first().source_name) == ("club.org", "feed_one")


def test_empty_registries(spark):
    s, o = spark.createDataFrame([], R.SOURCE), spark.createDataFrame([], R.ORGANIZER)
    assert R.source_violations(s).count() == R.organizer_violations(o, s).count() == 0
