"""Web pages as rows: a small document tree over the standard library's parser, and what is read from it.

The tree lives inside Arrow-batched functions; everything downstream is DataFrame expressions.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Keys below which nodes of JSON documents are looked for.
NODE_KEYS = ("@graph", "events", "data", "results", "items", "edges")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self):
        """Descendants in document order, without recursion."""
        todo = self.children[::-1]
        while todo:
            n = todo.pop()
            if isinstance(n, Node):
                yield n
                todo += n.children[::-1]

    def text(self, skip=lambda n: n.tag in ("script", "style")) -> str:
        parts, todo = [], self.children[::-1]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                parts.append(n)
            elif not skip(n):
                todo += n.children[::-1]
        return " ".join(" ".join(parts).split())

    def following(self) -> list[Node]:
        own = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        return own[own.index(self) + 1 :] if self in own else []

    def fits(self, selector: str) -> bool:
        """One compound: tag, .class, #id, [attr], [attr=x], [attr*=x], [attr^=x]."""
        m = re.match(r"[a-zA-Z][\w-]*|\*", selector)
        if m and m[0] not in ("*", self.tag):
            return False
        for kind, name, op, value in re.findall(r"([.#\[])([\w-]+)(?:([*^$]?=)[\"']?([^\]\"']*)[\"']?)?", selector[m.end() if m else 0 :]):
            have = self.attrs.get({".": "class", "#": "id"}.get(kind, name))
            ok = have is not None and (
                name in have.split() if kind == "." else name == have if kind == "#" else True if not op else {"=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value)}[op]
            )
            if not ok:
                return False
        return True

    def select(self, selectors: str) -> list[Node]:
        """Descendants that match any of the comma-separated selectors, in document order."""
        chains = [s.split() for s in selectors.split(",") if s.strip()]
        above = tuple(0 for _ in chains)
        for n in self._path():  # how much of each chain the ancestors match, from the top down, is the most that can be matched
            above = tuple(k + (k < len(c) - 1 and n.fits(c[k])) for k, c in zip(above, chains, strict=True))
        out, todo = [], [(n, above) for n in self.children[::-1] if isinstance(n, Node)]
        while todo:
            n, above = todo.pop()
            if any(k == len(c) - 1 and n.fits(c[-1]) for k, c in zip(above, chains, strict=True)):
                out.append(n)
            if n.children:
                below = tuple(k + (k < len(c) - 1 and n.fits(c[k])) for k, c in zip(above, chains, strict=True))
                todo += [(child, below) for child in n.children[::-1] if isinstance(child, Node)]
        return out

    def _path(self) -> list[Node]:
        """From the root to this node."""
        out, n = [], self
        while n is not None:
            out.append(n)
            n = n.parent
        return out[::-1]

    def first(self, selectors: str) -> Node | None:
        return next(iter(self.select(selectors)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")
        self.open: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        while True:  # every element is closed once, however deep
            n, self.at = self.at, self.at.parent
            self.open[n.tag] -= 1
            if n.tag == tag:
                return

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def title(root: Node) -> str | None:
    """What the page says in og:title, else in its title element."""
    said = next((m.attrs.get("content", "") for m in root.walk() if m.tag == "meta" and m.attrs.get("property") == "og:title"), None)
    if said is None:
        n = root.first("title")
        said = n.text() if n else ""
    return " ".join(said.split()) or None


def join_url(base: str | None, link: str | None) -> str | None:
    """The link as seen from base; null for links that are no urls."""
    try:
        return None if link is None else urljoin(base or "", link)
    except ValueError:
        return None


def canonical(root: Node, url: str) -> str:
    n = root.first("link[rel=canonical]")
    return (join_url(url, n.attrs.get("href", "")) if n else None) or url


def label_value(root: Node, *labels: str) -> str | None:
    """The value beside a label: the next sibling of the label's element, else what its container holds besides it."""
    wanted = {x.casefold() for x in labels}
    for n in root.walk():
        if not any(isinstance(c, str) and " ".join(c.split()).casefold().rstrip(": ") in wanted for c in n.children):
            continue
        beside = next((x.text() for x in n.following()[:1]), "")
        if not beside and n.parent is not None:
            beside = n.parent.text(lambda x: x is n or x.tag in ("script", "style")).lstrip(":- ")
        if beside:
            return beside
    return None


_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What challenge pages say. Fixed values.
_CHALLENGE = re.compile(
    r"\b(?:verify (?:that )?you are human|access denied|checking your browser|(?:complete|solve|enter) (?:(?:the|a) )?captcha|captcha (?:challenge|verification|required))\b", re.I,
)


def _unseen(n: Node) -> bool:
    return n.tag in ("script", "style", "template") or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(n.attrs.get("style", "")))


def interstitial(html: str | None) -> bool:
    """Challenge and CAPTCHA pages, by what a visitor can see on them."""
    root = parse(html)
    if _CHALLENGE.search(root.text(_unseen)):
        return True
    todo = [root]
    while todo:
        n = todo.pop()
        if n.tag in ("title", "h1", "h2") and re.fullmatch("(?:re)?captcha", n.text(_unseen), re.I):
            return True
        src = n.attrs.get("src", "") if n.tag == "iframe" else ""
        if {"g-recaptcha", "h-captcha"} & set(n.attrs.get("class", "").split()) or "/recaptcha/" in src or "hcaptcha.com" in src:
            return True
        todo += [c for c in n.children if isinstance(c, Node) and not _unseen(c)]
    return False


def json_nodes(text: str | None) -> list[dict]:
    """All mappings of a JSON document that lie under the known keys, outermost first; none if it is malformed."""
    try:
        todo = [json.loads(text or "")]
    except (ValueError, RecursionError):
        return []
    out = []
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo = x + todo
        elif isinstance(x, dict):
            out.append(x)
            todo = [x[k] for k in NODE_KEYS if isinstance(x.get(k), dict | list)] + todo
    return out


def detail_links(html: str | None, url: str, selectors: str, prefixes: list[str], most: int) -> list[str]:
    """Links that selectors and prefixes allow, without fragments, each once, in order."""
    out: dict[str, None] = {}
    for a in parse(html).select(selectors):
        link = urldefrag(join_url(url, a.attrs.get("href", "")) or "")[0]
        path = "/" + link.split("://", 1)[-1].partition("/")[2]
        if link and a.attrs.get("href") and any(link.startswith(p) if "://" in p else path.startswith(p) for p in prefixes):
            out.setdefault(link)
    return list(out)[:most]


def cards(html: str | None, selectors: str) -> list[dict]:
    """Cards with data attributes: title, start, price, venue, city, format, description."""
    out = []
    for c in parse(html).select(selectors):
        head = c.first("h1, h2, h3, [data-title]")
        out.append({"title": head.text() if head else None} | {k: c.attrs.get(f"data-{k}") for k in ("start", "end", "price", "venue", "city", "format", "eligibility")} | {"description": c.text()[:2000]})
    return out


#: Rows that ``column`` holds as Python objects at a time.
PART = 64


def column(fn, kind, *cols: Column) -> Column:
    """An Arrow-batched function of columns; a row on which it fails gives null and leaves the others alone."""

    def one(row: tuple):
        try:
            return fn(*(None if isinstance(x, float) and x != x else x for x in row))
        except (ValueError, RecursionError, AttributeError, TypeError, AssertionError):
            return None

    to = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def call(rows: pa.Array) -> pa.Array:
        # a batch is read in parts, so that few pages and finds are held as Python objects at a time
        parts = [pa.array([one(tuple(row.values())) for row in rows.slice(i, PART).to_pylist()], to) for i in range(0, len(rows), PART)]
        return pa.concat_arrays(parts) if parts else pa.array([], to)

    return call(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cols))))


def page_title(html: Column) -> Column:
    return column(lambda h: title(parse(h)), T.StringType(), html)


def is_interstitial(html: Column) -> Column:
    return column(interstitial, T.BooleanType(), html)


def labelled(html: Column, *labels: str) -> Column:
    return column(lambda h: label_value(parse(h), *labels), T.StringType(), html)


def joined_url(base: Column, link: Column) -> Column:
    return column(join_url, T.StringType(), base, link)


def links(html: Column, url: Column, selectors: str, prefixes: list[str], most: int) -> Column:
    return column(lambda h, u: detail_links(h, u, selectors, prefixes, most), T.ArrayType(T.StringType()), html, url)


def card_titles(html: Column, selectors: str) -> Column:
    return column(lambda h: [c["title"] for c in cards(h, selectors)], T.ArrayType(T.StringType()), html)


def node_count(text: Column) -> Column:
    return column(lambda t: len(json_nodes(t)), T.IntegerType(), text)


# Names of months, as they may be written, and zones that a label may name, in seconds.
MONTHS = (
    ("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"),
    ("july", "jul"), ("august", "aug"), ("september", "sept", "sep"), ("october", "oct"), ("november", "nov"), ("december", "dec"),
)
LABEL_ZONES = {"ist": 19800, "utc": 0, "gmt": 0, "z": 0}
_NUMBER_OF = {name: i for i, names in enumerate(MONTHS, 1) for name in names}
#: A text as a date sees it: a clock time, a number with its mark of order, a word, or a sign.
_PIECE = re.compile(r"(?P<clock>\d{1,2}:\d{2}(?::\d{2})?)|(?P<number>\d++)(?:st|nd|rd|th)?(?!(?!t\d)[^\W\d_])|(?P<hour>\d{1,2})(?=[ap]\.?m)|(?P<word>[^\W\d_]+)|(?P<sign>[-/+])|\S", re.I)


@dataclass
class Dated:
    """A whole day, and the clock time and zone (its seconds) that a text gives with it."""

    day: dt.date
    clock: dt.time | None
    zone: int | None


def read_date(value: str | None, dayfirst: bool = True, zones: dict[str, int] = LABEL_ZONES) -> Dated | None:
    """The first whole date of a text: a year of this century with day and month beside it, in the forms 2026-10-11, 11/10/2026,
    11 October 2026, October 11, 2026. Parts are never filled in; a date that does not exist is none.

    A clock time has minutes, or AM or PM beside the hour; a zone is one of ``zones`` after the clock time, or an offset such
    as +05:30 right after it.
    """
    pieces = [(m.lastgroup or "other", m.group(m.lastgroup).lower() if m.lastgroup else m.group()) for m in _PIECE.finditer(value or "")]
    day, used = _day_of(pieces, dayfirst)
    if day is None:
        return None
    clock, after = None, None
    for i, (kind, text) in enumerate(pieces):
        half = next((t[0] for k, t in pieces[i + 1 : i + 2] if k == "word" and t in ("am", "pm", "a", "p")), None)
        if kind == "clock" or kind == "hour" or (kind == "number" and i not in used and half):
            parts = [int(x) for x in text.split(":")]
            if half and (not 1 <= parts[0] <= 12):
                return None
            parts[0] = parts[0] % 12 + 12 * (half == "p") if half else parts[0]
            try:
                clock, after = dt.time(*parts), i
            except ValueError:
                return None
            break
    tail = pieces[after + 1 :] if clock else []
    zone = next((zones[t] for k, t in tail if k == "word" and t in zones), None)
    if [k for k, _ in tail[:2]] == ["sign", "clock"] and tail[0][1] == "+":
        hours, minutes = tail[1][1].split(":")[:2]
        zone = 3600 * int(hours) + 60 * int(minutes)
    return Dated(day, clock, zone)


def _day_of(pieces: list[tuple[str, str]], dayfirst: bool) -> tuple[dt.date | None, set[int]]:
    numbers = [(i, int(t)) for i, (k, t) in enumerate(pieces) if k == "number" and len(t) <= 4]
    for i, year in numbers:
        if not 2000 <= year <= 2099:
            continue
        beside = {j: n for j, n in numbers if j != i and n <= 31}
        months = [j for j, (k, t) in enumerate(pieces) if k == "word" and t in _NUMBER_OF]
        for j in months:  # a day right before or after the name of its month, signs apart
            for step in (-1, 1):
                at = next((q for q in range(j + step, j + 3 * step, step) if 0 <= q < len(pieces) and pieces[q][0] != "sign" and pieces[q][1] not in (",", "of", ".")), None)
                if at in beside and (found := _made(year, _NUMBER_OF[pieces[j][1]], beside[at])):
                    return found, {i, at}
        if i + 4 < len(pieces) and pieces[i + 1] == pieces[i + 3] and pieces[i + 1][0] == "sign" and i + 2 in beside and i + 4 in beside:
            return _made(year, beside[i + 2], beside[i + 4]), {i, i + 2, i + 4}
        if i >= 4 and pieces[i - 1] == pieces[i - 3] and pieces[i - 1][0] == "sign" and i - 2 in beside and i - 4 in beside:
            first, second = beside[i - 4], beside[i - 2]
            order = [(second, first), (first, second)] if dayfirst else [(first, second), (second, first)]
            return next((d for m, n in order if (d := _made(year, m, n))), None), {i, i - 2, i - 4}
    return None, set()


def _made(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def label_date(value: str | None, zone: str = "Asia/Kolkata", dayfirst: bool = True):
    """A whole date, at midnight where no time is given, in its own zone or else the given one -> UTC."""
    from zoneinfo import ZoneInfo

    found = read_date(value, dayfirst)
    if found is None:
        return None
    where = ZoneInfo(zone) if found.zone is None else dt.timezone(dt.timedelta(seconds=found.zone))
    return pd.Timestamp(dt.datetime.combine(found.day, found.clock or dt.time(), where)).tz_convert("UTC").tz_localize(None)


def labelled_date(value: Column, dayfirst: bool = True) -> Column:
    return column(lambda v: None if (d := label_date(v, dayfirst=dayfirst)) is None else d.strftime("%Y-%m-%d %H:%M:%S"), T.StringType(), value).cast("timestamp_ntz")
