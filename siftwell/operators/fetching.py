"""What a fetcher may do and when, decided offline over tables of requests: rules of sites, rates, and overlapping spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import url as U
from siftwell.operators.merge import Ranges

#: Minutes for which rules that could be read, and the failure to read any, stand.
RULES_STAND, FAILURE_STANDS = 360, 15


def scheduled(requests: DataFrame, gap: Column, key: str = "host") -> DataFrame:
    """requests: key, at, id -> the same with starts_at and wait_us: each starts when it arrives, or ``gap`` (microseconds, the
    same for a key) after the one before has started.

    start(n) = max(at(n), start(n - 1) + gap), so start(n) - n * gap is a running maximum of at(k) - k * gap. Requests of one key go
    by time, then id; a key with very many is summed up range by range. Null times start at once and hold nobody up.
    """
    c = F.col
    timed = requests.filter(c("at").isNotNull()).withColumns({"at_us": F.unix_micros(c("at").cast("timestamp")), "gap_us": gap.cast("long")})
    ranges = Ranges(timed, ["at", "id"], key)
    rows = ranges.running(ranges.rows, {"no": ("sum", F.lit(1).cast("long"))})
    rows = ranges.running(rows, {"top": ("max", c("at_us") - c("no") * c("gap_us"))})
    start = c("top") + c("no") * c("gap_us")
    out = rows.withColumns({"wait_us": start - c("at_us"), "starts_at": F.timestamp_micros(start)}).select(*requests.columns, "starts_at", "wait_us")
    return out.unionByName(requests.filter(c("at").isNull()).withColumns({"starts_at": F.lit(None).cast("timestamp"), "wait_us": F.lit(0).cast("long")}))


def robots_verdicts(requests: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """requests: id, url, at -> (id, verdict): allow, deny, or unknown where no rules stand at that time and they must be read.

    files: origin, fetched_at, readable: when the rules of an origin were read, or failed to be. Rules that were read stand for
    RULES_STAND minutes; a failure denies everything for FAILURE_STANDS. A request goes by the last file before it. rules:
    origin, fetched_at, prefix, allow: the longest prefix of the request's path and query decides, allow before deny for equal ones; without any, it
    is allowed. Urls without an origin are denied. An empty prefix denies or allows nothing.
    """
    c = F.col
    net = F.concat(U.scheme(c("url")), F.lit("://"), U.host(c("url")), F.when(U.port(c("url")) != "", F.concat(F.lit(":"), U.port(c("url")))).otherwise(""))
    target = F.concat(U.path(c("url")), F.when(U.query(c("url")) != "", F.concat(F.lit("?"), U.query(c("url")))).otherwise(""))
    asked = requests.select("id", c("at").cast("timestamp").alias("at"), F.when(F.coalesce(U.host(c("url")), F.lit("")) != "", net).alias("origin"), target.alias("target"))
    file = F.struct(c("fetched_at").cast("timestamp").alias("since"), F.coalesce("readable", F.lit(False)).alias("readable"))
    # as of: files and requests of an origin in one order, a file before a request of the same instant
    line = files.filter("fetched_at IS NOT NULL").select("origin", c("fetched_at").cast("timestamp").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(asked.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("target"), file.alias("file"))
    line = line.unionByName(asked.filter("origin IS NOT NULL").select("origin", "at", F.lit(1).alias("kind"), "id", "target", F.lit(None).cast(line.schema["file"].dataType).alias("file")))
    ranges = Ranges(line, ["at", "kind"], "origin")
    met = ranges.running(ranges.rows, {"last": ("last", c("file"))}).filter("kind = 1")
    stands = F.when(c("last.readable"), RULES_STAND).otherwise(FAILURE_STANDS)
    standing = F.coalesce(F.unix_micros("at") - F.unix_micros("last.since") < stands.cast("long") * 60_000_000, F.lit(False))
    met = met.select("id", "origin", "target", F.when(standing, c("last.since")).alias("since"), F.when(standing, c("last.readable")).alias("readable")).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    # prefixes meet rules by equality, for the lengths that rules have
    known = rules.filter("prefix <> ''").select("origin", c("fetched_at").cast("timestamp").alias("since"), c("prefix").alias("head"), "allow").withColumn("n", F.length("head"))
    lengths = known.groupBy("origin", "since").agg(F.collect_set("n").alias("ns"))  # numbers up to the longest url
    heads = met.filter("readable").join(lengths, ["origin", "since"]).select("row", "origin", "since", F.explode(F.transform(F.filter("ns", lambda n: n <= F.length("target")), lambda n: F.left("target", n))).alias("head"))
    best = heads.join(known, ["origin", "since", "head"]).groupBy("row").agg(F.max(F.struct("n", "allow")).alias("b"))
    verdict = F.when(c("readable").isNull(), "unknown").when(~c("readable"), "deny").when(F.coalesce("b.allow", F.lit(True)), "allow").otherwise("deny")
    return met.join(best, "row", "left").select("id", verdict.alias("verdict")).unionByName(asked.filter("origin IS NULL").select("id", F.lit("deny").alias("verdict")))


def overlapping(spans: DataFrame, width: int, before: int = 0, after: int = 0, key: str = "conv_id", id_col: str = "turn") -> DataFrame:
    """spans: key, id_col, lo, hi -> (key, id_col, other): pairs of different spans of a key, of which the first begins before the
    other's end + ``before`` and ends after the other's begin - ``after``.

    Spans are cut into bins of ``width`` and meet by bin; a pair is kept in the first bin that both have, so none comes twice. With a
    width about as long as spans, the work grows with the pairs that there are. Null bounds overlap with nothing.
    """
    c = F.col
    bin_of = lambda x: F.floor(x / width)
    reach = max(0, before, after)
    rows = spans.filter("lo IS NOT NULL AND hi IS NOT NULL").select(key, c(id_col).alias("span"), "lo", "hi").withColumns({"first": bin_of(c("lo") - reach), "last": bin_of(F.greatest(c("lo"), c("hi")) + reach)})
    cut = rows.withColumn("bin", F.explode(F.sequence("first", "last")))
    a, b = cut.alias("a"), cut.alias("b")
    near = (c("a.lo") < c("b.hi") + before) & (c("a.hi") > c("b.lo") - after) & (c("a.span") != c("b.span")) & (c("a.bin") == F.greatest("a.first", "b.first"))
    met = a.join(b, (c(f"a.{key}") == c(f"b.{key}")) & (c("a.bin") == c("b.bin")) & near)
    return met.select(c(f"a.{key}").alias(key), c("a.span").alias(id_col), c("b.span").alias("other"))
