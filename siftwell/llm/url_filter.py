"""URL filter: a trie over reversed host labels, then path segments; the longest matching entry decides."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import ascii_lower

Rule = tuple[str, str]  # verdict, host + path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


class UrlTrie:
    """Host nodes branch by labels from the last to the first; the path part of a node branches by whole segments and
    ends in the beginning of one more segment (``en/1`` fits ``en/12``, ``en/`` any page below ``en``).

    Among entries that fit, the longest in characters wins, of equally long ones that with the longer host, and block
    before allow for the same entry.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, rule in rules:
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            entry = ((len(rule), len(host), verdict == "block"), rule, verdict)
            if not path:
                slot, name = node, "entry"
            else:
                node = node.setdefault("path", {})
                *whole, start = path[1:].split("/")
                for segment in whole:
                    node = node.setdefault("segments", {}).setdefault(segment, {})
                slot, name = node.setdefault("starts", {}), start
            slot[name] = max(slot.get(name, entry), entry)

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """rule, verdict"""
        best = None
        node = self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            found = [node["entry"]] if "entry" in node else []
            if path.startswith("/") and "path" in node:
                below = node["path"]
                segments = path[1:].split("/")
                for i, segment in enumerate(segments):
                    starts = below.get("starts", {})
                    found += [starts[s] for n in range(len(segment) + 1) if (s := segment[:n]) in starts] if len(starts) > len(segment) else [e for s, e in starts.items() if segment.startswith(s)]
                    below = below.get("segments", {}).get(segment) if i < len(segments) - 1 else None
                    if below is None:
                        break
            best = max([best, *found] if best else found, default=None)
        return (best[1], best[2]) if best else (None, None)


def filter_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_trie_bytes: int = 32 << 20,
) -> DataFrame:
    """One row per input row: id_col, host, path, rule (null if none fits), verdict (the rule's, else ``default``).

    A null url or one without ``://`` has an empty host and path and fits no rule. Rules: (allow or block, host/path);
    a rule fits its host and all subdomains if the path starts with the rule's. Other columns are ignored; an empty
    table or an empty list of rules is fine. The trie is broadcast while the rules take at most ``max_trie_bytes``;
    a longer list is joined by host suffix and path prefix instead, with the same result.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("__id"), url_host(url).alias("host"), url_path(url).alias("path"))
    found = _by_trie(rows, rules) if sum(len(r[1].encode()) for r in rules) <= max_trie_bytes else _by_join(rows, rules)
    return found.select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _by_trie(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(UrlTrie(rules).root)

    @F.pandas_udf("rule string, verdict string")
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        trie = UrlTrie([])
        trie.root = shared.value
        return pd.DataFrame([trie.match(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"])

    return rows.withColumn("__m", match("host", "path")).select("__id", "host", "path", "__m.rule", "__m.verdict")


def _by_join(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each url meets the rules by equality of (host suffix, path prefix of a length that rules have)."""
    spark = rows.sparkSession
    best: dict[str, str] = {}
    for verdict, rule in rules:
        best[rule] = "block" if "block" in (verdict, best.get(rule)) else verdict
    table = spark.createDataFrame([(*split_rule(r), r, v) for r, v in best.items()], "suffix string, prefix string, rule string, verdict string")
    sizes = sorted({len(split_rule(r)[1]) for r in best})
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*(F.lit(n) for n in sizes)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = rows.filter("host <> ''").select("__row", F.explode(suffixes).alias("suffix"), "path").select("__row", "suffix", F.explode(prefixes).alias("prefix"))
    rank = F.struct(F.length("rule"), F.length("suffix"))
    hits = keys.join(table, ["suffix", "prefix"]).groupBy("__row").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("__m"))
    return rows.join(hits, "__row", "left").select("__id", "host", "path", "__m.rule", "__m.verdict")
