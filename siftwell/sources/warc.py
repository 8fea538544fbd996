"""Stored pages as a table: ``spark.read.format("warc").load(root)`` over WARC files, and the same as a stream.

One folder for each source: ``root/<source_name>/**/*.warc`` or ``.warc.gz`` (a gzip member for each record, or one for all). A file is a
partition, read record by record, so a task holds one body of at most ``max_bytes`` at a time.

Columns: source_name, file, place (record in the file), url, observed_at, status, content_type, html, error. A record that
cannot be a page keeps its row, with a null html and the reason as ``error``: ``too large``, ``no text`` (another content
type), ``no encoding`` (a character set that is not known), ``cut`` (the file ends inside the record), ``no response`` (no HTTP head). A file
that is broken gives the rows before the break and one with ``error`` ``broken file``. Records of other types than response are passed over.

Columns left out by ``schema(...)`` are not made: without html and error no body is decoded. Options leave out folders
(``sources``, names with commas between) and records before their bodies are read (``status``; ``since`` and ``until``, ISO
times, since <= observed_at < until; a record without the value is left out). Filters are not pushed: Spark 4.1 keeps the
filters that a Python source has taken for one query in the table, and later queries on the same DataFrame lose rows by them.

As a stream, a file is read once, in the batch in which it is ``settle_seconds`` old: an offset is the newest (time of
change, path) read. Files must appear whole (be moved in) within that time of their time of change.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import re
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftwell.constants import PAGE_BYTES

SCHEMA = "source_name string, file string, place long, url string, observed_at timestamp, status int, content_type string, html string, error string"
TEXT_TYPES = ("text/html", "application/xhtml+xml", "text/plain", "application/json", "application/ld+json")
HEAD_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 10, 256, 16 << 20
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)
_BROKEN = (EOFError, zlib.error, gzip.BadGzipFile, ValueError)


class StoredFile(InputPartition):
    def __init__(self, source: str, path: str, changed: int):
        self.source, self.path, self.changed = source, path, changed


def stored_files(root: str) -> list[StoredFile]:
    """The files below a root of any file system that Arrow reads, by time of change and path."""
    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    base = base.rstrip("/")
    out = []
    for info in fs.get_file_info(pafs.FileSelector(base, recursive=True)):
        inner = info.path[len(base) + 1 :]
        if info.type == pafs.FileType.File and "/" in inner and inner.endswith((".warc", ".warc.gz")):
            out.append(StoredFile(inner.split("/", 1)[0], inner, info.mtime_ns or 0))
    return sorted(out, key=lambda f: (f.changed, f.path))


def _line(stream: Any) -> bytes:
    line = stream.readline(HEAD_BYTES)
    if len(line) >= HEAD_BYTES:
        raise ValueError("a header line is too long")
    return line


def _headers(stream: Any) -> tuple[dict[str, str], int]:
    """Headers up to a blank line, names in lower case, and how many bytes they took. The first of a name counts."""
    out: dict[str, str] = {}
    used = 0
    while line := _line(stream):
        used += len(line)
        if used > HEAD_BYTES:
            raise ValueError("a head is too long")
        if not line.strip():
            break
        name, _, value = line.decode("latin-1").partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out, used


def _skip(stream: Any, n: int) -> int:
    """How many of n bytes were there to be passed over."""
    left = n
    while left and (got := len(stream.read(min(left, 1 << 20)))):
        left -= got
    return n - left


def _time(value: str | None) -> dt.datetime | None:
    try:
        found = dt.datetime.fromisoformat(value or "")
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=dt.timezone.utc)


def body_text(body: bytes, content_type: str | None) -> str | None:
    """The text of a body: by its byte order mark, the charset of the header, the one that its first 1,024 bytes name, else
    UTF-8 with other bytes replaced; null where the named set is not known."""
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    told = _CHARSET.search(content_type or "") or _CHARSET.search(body[:1024].decode("latin-1"))
    name = next((n for mark, n in marks if body.startswith(mark)), told.group(1) if told else "utf-8")
    try:
        return body.decode(name, "replace")
    except (LookupError, ValueError):
        return None


def records(stream: Any, keep=lambda row: True, bodies: bool = True, max_bytes: int = PAGE_BYTES) -> Iterator[dict]:
    """The responses of a WARC stream as rows without source_name and file. keep sees url, observed_at and status before the body is read."""
    place = -1
    try:
        while line := _line(stream):
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no record starts here")
            head, _ = _headers(stream)
            size, place = int(head.get("content-length", "")), place + 1
            if size < 0:
                raise ValueError("a record has no length")
            if head.get("warc-type", "").lower() != "response":
                if _skip(stream, size) < size:
                    raise EOFError
                continue
            row = {"place": place, "url": head.get("warc-target-uri", "").strip("<>") or None, "observed_at": _time(head.get("warc-date")), "status": None, "content_type": None, "html": None, "error": None}
            first = stream.readline(min(size, HEAD_BYTES))
            used, code = len(first), re.match(rb"HTTP/\S+\s+(\d{3})\b", first)
            if not code:
                if not keep(row):
                    used += _skip(stream, size - used)
                    continue
                cut = used + _skip(stream, size - used) < size
                yield row | {"error": "cut" if cut else "no response"}
                continue
            fields, took = _headers(stream)
            used += took
            row |= {"status": int(code[1]), "content_type": fields.get("content-type")}
            if not keep(row):
                if _skip(stream, size - used) < size - used:
                    raise EOFError
                continue
            large, kind = size - used > max_bytes, (row["content_type"] or "text/html").split(";")[0].strip().lower()
            wanted = bodies and not large and kind in TEXT_TYPES
            body = stream.read(size - used) if wanted else b""
            there = len(body) if wanted else _skip(stream, size - used)
            if there < size - used:
                yield row | {"error": "cut"}
                return
            if large or kind not in TEXT_TYPES:
                row["error"] = "too large" if large else "no text"
            elif bodies:
                row["html"] = body_text(body, row["content_type"])
                row["error"] = "no encoding" if row["html"] is None else None
            yield row
    except _BROKEN:
        yield {"place": place + 1, "url": None, "observed_at": None, "status": None, "content_type": None, "html": None, "error": "broken file"}


class _Files:
    """What batches and streams share: how a file becomes Arrow batches."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.root = options.get("path")
        if not self.root:
            raise ValueError("load needs the folder of the stored pages")
        self.names, self.arrow = schema.names, to_arrow_schema(schema)
        if unknown := set(self.names) - {c.split()[0] for c in SCHEMA.split(", ")}:
            raise ValueError(f"there is no column {sorted(unknown)}")
        self.max_bytes = int(options.get("max_bytes", PAGE_BYTES))
        self.sources = {n.strip() for n in options["sources"].split(",")} if "sources" in options else None
        self.status = int(options["status"]) if "status" in options else None
        self.since, self.until = _time(options.get("since")), _time(options.get("until"))
        for name, value in (("since", self.since), ("until", self.until)):
            if name in options and value is None:
                raise ValueError(f"{name} is not an ISO time")

    def files(self) -> list[StoredFile]:
        return [f for f in stored_files(self.root) if self.sources is None or f.source in self.sources]

    def keeps(self, row: dict) -> bool:
        at = row["observed_at"]
        early = self.since is not None and (at is None or at < self.since)
        late = self.until is not None and (at is None or at >= self.until)
        return not early and not late and self.status in (None, row["status"])

    def read(self, partition: StoredFile) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root)
        bodies = "html" in self.names or "error" in self.names
        rows, size = [], 0
        with fs.open_input_stream(f"{base.rstrip('/')}/{partition.path}", compression=None) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
            for row in records(stream, self.keeps, bodies, self.max_bytes):
                rows.append(row | {"source_name": partition.source, "file": partition.path})
                size += len(row["html"] or "")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in self.arrow], schema=self.arrow)


class WarcReader(_Files, DataSourceReader):
    def partitions(self) -> list[StoredFile]:
        return self.files()


class WarcStream(_Files, DataSourceStreamReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.settle = float(options.get("settle_seconds", 10))
        self.newest = {"changed": -1, "path": ""}

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        before = (dt.datetime.now(dt.timezone.utc).timestamp() - self.settle) * 1e9
        for f in self.files():
            if f.changed <= before and (f.changed, f.path) > (self.newest["changed"], self.newest["path"]):
                self.newest = {"changed": f.changed, "path": f.path}
        return self.newest

    def partitions(self, start: dict, end: dict) -> list[StoredFile]:
        low, high = ((o["changed"], o["path"]) for o in (start, end))
        if high > (self.newest["changed"], self.newest["path"]):
            self.newest = dict(end)
        return [f for f in self.files() if low < (f.changed, f.path) <= high]

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def streamReader(self, schema: T.StructType) -> WarcStream:
        return WarcStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(WarcSource)
