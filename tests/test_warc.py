"""Stored pages as a table and as a stream, against the records that were written."""

from __future__ import annotations

import datetime as dt
import gzip
import os
import random

import pytest

from siftwell.sources import warc

DAY = dt.datetime(2026, 5, 1, tzinfo=dt.timezone.utc)


def record(url, when, body: bytes, content_type="text/html; charset=utf-8", status=200, kind="response", head=True) -> bytes:
    http = (f"HTTP/1.1 {status} OK\r\n" + (f"Content-Type: {content_type}\r\n" if content_type else "") + "\r\n").encode() if head else b""
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}\r\nContent-Length: {len(http + body)}\r\n\r\n".encode() + http + body + b"\r\n\r\n"


def store(root, source, name, parts, changed=None):
    folder = root / source
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_bytes(b"".join(gzip.compress(p) for p in parts) if name.endswith(".gz") else b"".join(parts))
    if changed:
        os.utime(path, ns=(changed, changed))
    return path


@pytest.fixture(scope="module")
def pages(tmp_path_factory):
    root, rng, rows = tmp_path_factory.mktemp("stored"), random.Random(7), []
    for source in ("alpha", "beta", "gamma"):
        for k, name in enumerate(("a.warc", "b.warc.gz")):
            parts = []
            for i in range(20):
                url, when, status = f"https://{source}.org/{k}/{i}", DAY + dt.timedelta(hours=i), rng.choice([200, 200, 404])
                html = f"<h1>Talk {i} in Zürich</h1>" + "x" * rng.choice([0, 10, 3000])
                parts.append(record(url, when, html.encode(), status=status))
                rows.append((source, f"{source}/{name}", i, url, when.replace(tzinfo=None), status, html))
            store(root, source, name, parts)
    return str(root), rows


def told(df):
    return sorted((r.source_name, r.file, r.place, r.url, r.observed_at, r.status, r.html) for r in df.collect())


def test_rows_and_options(spark, pages):
    root, rows = pages
    warc.register(spark)

    def load(**options):
        return spark.read.format("warc").options(**options).load(root)

    table = load()
    assert told(table) == sorted(rows) and table.filter("error IS NOT NULL").count() == 0
    assert table.rdd.getNumPartitions() == 6
    assert told(table.filter("status = 404")) == sorted(r for r in rows if r[5] == 404) and table.count() == len(rows)
    one = load(sources="beta")
    assert told(one) == sorted(r for r in rows if r[0] == "beta") and one.rdd.getNumPartitions() == 2
    low, high = dt.datetime(2026, 5, 1, 5), dt.datetime(2026, 5, 1, 12)
    some = load(sources="alpha, gamma", status=200, since=f"{low}+00:00", until="2026-05-01T17:30:00+05:30")
    assert told(some) == sorted(r for r in rows if r[5] == 200 and low <= r[4] < high and r[0] != "beta")
    few = spark.read.format("warc").schema("url string, status int").load(root)
    assert few.columns == ["url", "status"] and sorted(map(tuple, few.collect())) == sorted((r[3], r[5]) for r in rows)


def test_what_cannot_be_a_page_is_told(spark, tmp_path):
    warc.register(spark)
    parts = [
        record("u0", DAY, b"x" * 2001), record("u1", DAY, b"\x89PNG", "image/png"), record("u2", DAY, b"a", "text/html; charset=klingon"),
        record("u3", DAY, b"dns answer", head=False), record("u4", DAY, b"ask", kind="request"), record("u5", DAY, "é".encode("latin-1"), "text/html; charset=ISO-8859-1"),
        record("u6", DAY, '<meta charset="windows-1251">Привет'.encode("cp1251"), "text/html"), record("u7", DAY, b"\xff\xfea\x00", "text/html"), record("u8", DAY, b"", None),
        record("u9", DAY, b"\xff ok", None),
    ]
    store(tmp_path, "s", "kinds.warc", parts)
    store(tmp_path, "s", "cut.warc", [record("c0", DAY, b"one"), record("c1", DAY, b"two two two")[:-10]])
    store(tmp_path, "s", "odd.warc.gz", [record("o0", DAY, b"one")])
    broken = gzip.compress(record("b0", DAY, b"one")) + gzip.compress(record("b1", DAY, os.urandom(500).hex().encode()))[:-200]
    (tmp_path / "s" / "broken.warc.gz").write_bytes(broken)
    (tmp_path / "s" / "no.warc").write_bytes(b"this is not a record\r\n")
    (tmp_path / "s" / "empty.warc").write_bytes(b"")
    (tmp_path / "loose.warc").write_bytes(parts[0])
    found = {(r.file.split("/")[1], r.url): (r.html, r.error) for r in spark.read.format("warc").option("max_bytes", 2000).load(str(tmp_path)).collect()}
    assert found == {
        ("kinds.warc", "u0"): (None, "too large"), ("kinds.warc", "u1"): (None, "no text"), ("kinds.warc", "u2"): (None, "no encoding"), ("kinds.warc", "u3"): (None, "no response"),
        ("kinds.warc", "u5"): ("é", None), ("kinds.warc", "u6"): ('<meta charset="windows-1251">Привет', None), ("kinds.warc", "u7"): ("a", None), ("kinds.warc", "u8"): ("", None), ("kinds.warc", "u9"): ("� ok", None),
        ("cut.warc", "c0"): ("one", None), ("cut.warc", "c1"): (None, "cut"), ("odd.warc.gz", "o0"): ("one", None),
        ("broken.warc.gz", "b0"): ("one", None), ("broken.warc.gz", None): (None, "broken file"), ("no.warc", None): (None, "broken file"),
    }


def test_a_stream_reads_each_page_once_over_restarts(spark, tmp_path):
    warc.register(spark)
    root, out, state = tmp_path / "stored", tmp_path / "out", tmp_path / "state"
    start, want = 1_700_000_000_000_000_000, []

    def run():
        stream = spark.readStream.format("warc").option("settle_seconds", 0).load(str(root))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(processingTime="0 seconds").start(str(out))
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r.url for r in spark.read.parquet(str(out)).collect())

    for step in range(3):
        for source in ("a", "b"):
            for n in range(2):
                urls = [f"https://{source}.org/{step}/{n}/{i}" for i in range(5)]
                want += urls
                store(root, source, f"{step}-{n}.warc.gz", [record(u, DAY, b"page") for u in urls], start + step * 10**9)
        assert run() == sorted(want)
    assert run() == sorted(want)
