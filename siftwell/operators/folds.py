"""Ordered folds: cross-postings of one fetch, trust-aware merges, chunking, suppression of reverted changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.constants import CHUNK_CHARS, SEVERITY
from siftwell.functions.text import combine_all, is_paid
from siftwell.operators.merge import rank, trust_merge


def dedupe_fold(rows: DataFrame, key: str = "identity", order: str = "seq") -> DataFrame:
    """Cross-postings of one event, folded in their order. Every field is an aggregate of its own: last value there,
    texts combined, worst state, earliest date, any flag, distinct values in order of appearance.

    Columns that rows may lack: canonical_url and source_name (of the first), observed_at (the latest), raw_id, source_url, country, ends_at,
    first_observed_open_at, and what structured data say
    themselves, schema_format, schema_starts_at and schema_ends_at (instants with a clock time), which come before any other value.
    """
    have = lambda *names: [c for c in names if c in rows.columns]
    last = lambda c: F.max_by(c, F.when((F.col(c).isNotNull()) & (F.col(c).cast("string") != ""), F.col(order)))
    in_order = F.array_sort(F.collect_list(F.struct(order, "description", "price_text", "eligibility_text", "speakers", "topics")))
    state = F.max_by("registration_state", F.struct(rank(F.col("registration_state"), SEVERITY), -F.col(order)))
    known = lambda c: F.max_by(c, F.when(F.col(c) != "unknown", F.col(order)))
    schema = lambda c, how: [how(f"schema_{c}")] if f"schema_{c}" in rows.columns else []
    folded = rows.groupBy(key).agg(
        *(last(c).alias(c) for c in ("title", "organizer", "venue", "city", "registration_url", *have("source_url", "country", "raw_id"))), *(F.min_by(c, order).alias(c) for c in have("canonical_url", "source_name")), *(F.max(c).alias(c) for c in have("observed_at")), F.coalesce(*schema("format", known), known("format"), F.lit("unknown")).alias("format"),
        F.coalesce(known("event_type"), F.lit("unknown")).alias("event_type"), state.alias("registration_state"), *(F.min(c).alias(c) for c in ("registration_deadline", "registration_opened_at", *have("first_observed_open_at"))),
        *(F.coalesce(*schema(c, last), last(c)).alias(c) for c in ("starts_at", *have("ends_at"))), F.bool_or("is_explicitly_paid").alias("flag"), in_order.alias("all"),
    )
    column = lambda c: F.col(f"all.{c}")  # noqa: E731  the field of each row, in order
    texts = {c: combine_all(column(c)) for c in ("description", "price_text", "eligibility_text")}
    lists = {c: F.array_distinct(F.flatten(F.filter(column(c), lambda x: x.isNotNull()))) for c in ("speakers", "topics")}
    out = folded.withColumns(texts | lists)
    return out.withColumn("is_explicitly_paid", F.coalesce("flag", F.lit(False)) | is_paid(F.col("price_text"))).drop("all", "flag")


__all__ = ["dedupe_fold", "identity_resolve", "organizer_match", "pack_attributed", "pack_chunks", "rank", "reverted_schedules", "trust_merge"]
def _grams(text: Column, lengths: Column) -> Column:
    """What an alias may be found by: runs of as many words as the lengths say, joined; for length 0 its signs, one by one."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0))
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    signs = F.transform(F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.regexp_replace(text, r"(?U)\w", ""), ""))), lambda c: F.concat(F.lit("\0"), c))
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.when(n == 0, signs).when(n <= F.size(words), runs(n)).otherwise(F.array().cast("array<string>")))))


def alias_hits(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(organizer, position): labels that hold an alias as a whole phrase, case ignored.

    An alias is looked up by all its words at once: the words of a phrase that stands alone are whole words of the label in a row. So labels
    meet aliases by equality of runs of words, as long as aliases are, and each pair that meets is verified once. Aliases without any
    word are looked up by their first sign. There may be any number of either.
    """
    low = F.lower("alias")
    words = F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0))
    key = F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.concat(F.lit("\0"), F.left(low, F.lit(1))))
    index = aliases.filter("alias IS NOT NULL").select("position", low.alias("alias"), key.alias("gram"), F.size(words).alias("n"))
    lengths = sorted(r["n"] for r in index.select("n").distinct().collect())  # as many as aliases have different numbers of words
    asked = labels.select("organizer").dropna().distinct().withColumn("gram", F.explode(_grams(F.lower("organizer"), F.array(*map(F.lit, lengths)).cast("array<int>"))))
    quoted = F.replace("alias", F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    named = F.regexp_like(F.lower("organizer"), F.concat(F.lit(r"(?U)(?<!\w)\Q"), quoted, F.lit(r"\E(?!\w)")))
    return asked.join(index, "gram").filter(named).select("organizer", "position").distinct()


def organizer_match(candidates: DataFrame, organizers: DataFrame, aliases: DataFrame, domains: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """candidates: id, organizer, host, and source_name with profiles. organizers: position, name, trust, perhaps
    online_allowed. aliases: position, alias. domains: position, domain. profiles: position, source_name.

    An alias confirmed by a domain or a profile comes first, then a domain, an alias, a profile; of one kind the first
    organizer. Only a domain, or a profile with an alias, gives an organizer's trust and its permission for online events.
    Labels meet aliases by equality of runs of words (``alias_hits``), hosts meet domains by equality of suffixes.
    """
    from siftwell.functions.text import casefold
    from siftwell.functions.url import host_suffixes

    def flagged(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select("id", "position", *(F.lit(k == kind).alias(k) for k in "adp"))

    labels = alias_hits(candidates, aliases)
    parts = flagged(candidates.join(labels, "organizer"), "a")
    parts = parts.unionByName(flagged(candidates.select("id", F.explode(host_suffixes(casefold(F.col("host")))).alias("domain")).join(domains, "domain"), "d"))
    if profiles is not None:
        parts = parts.unionByName(flagged(candidates.join(profiles, "source_name"), "p"))
    flags = parts.groupBy("id", "position").agg(*(F.bool_or(k).alias(k) for k in "adp"))
    sure = F.col("d") | F.col("p")
    tier = F.when(F.col("a") & sure, 1).when(F.col("d"), 2).when(F.col("a"), 3).otherwise(4)
    best = flags.withColumn("tier", tier).groupBy("id").agg(F.min(F.struct("tier", "position")).alias("m")).select("id", "m.tier", "m.position")
    online = F.coalesce("online_allowed", F.lit(False)) if "online_allowed" in organizers.columns else F.lit(False)
    out = candidates.select("id").join(best.join(organizers.withColumn("online_allowed", online), "position"), "id", "left")
    explicit = F.coalesce(F.col("tier") <= 2, F.lit(False))
    return out.select("id", "name", F.when(explicit, F.coalesce("trust", F.lit("low"))).otherwise("low").alias("trust"), F.coalesce(explicit & F.col("online_allowed"), F.lit(False)).alias("online_allowed"), explicit.alias("explicit_identity"))


def identity_resolve(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows (seq, identity, canonical_url, normalized_key, perhaps webinar) meet existing ones (id and the same) by
    identity, then url, then key -> (seq, event_id, tier).

    Of several the smallest id counts; of one identity the best by the column ``rank`` of the existing rows, if there is one. The
    event of a key is not met if it has another identity, or another webinar. Existing rows are reduced to one for each value
    before they are joined, so a value that many rows share meets an incoming row once.
    """
    for name in ("identity", "webinar"):
        incoming = incoming if name in incoming.columns else incoming.withColumn(name, F.lit(None).cast("string"))
        existing = existing if name in existing.columns else existing.withColumn(name, F.lit(None).cast("string"))
    if "rank" not in existing.columns:
        existing = existing.withColumn("rank", F.lit(0))

    def first(name: str, *more: str) -> DataFrame:
        row = F.struct("id", *(F.col(c).alias(f"its_{c}") for c in more))
        ranked = (F.col("rank") if name == "identity" else F.lit(0)).alias("rank")
        of_rank = existing.dropna(subset=[name]).groupBy(name, ranked).agg(F.min_by(row, "id").alias("m"))
        return of_rank.groupBy(name).agg(F.max_by("m", "rank").alias("m")).select(name, "m.*")

    other = lambda c: F.coalesce(F.col(c) != F.col(f"its_{c}"), F.lit(False))
    by_key = incoming.join(first("normalized_key", "identity", "webinar"), "normalized_key").filter(~(other("identity") | other("webinar")))
    hits = None
    for tier, rows in enumerate((incoming.join(first("identity"), "identity"), incoming.join(first("canonical_url"), "canonical_url"), by_key), 1):
        one = rows.select("seq", F.struct(F.lit(tier).alias("tier"), "id").alias("m"))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy("seq").agg(F.min("m").alias("m")).select("seq", F.col("m.id").alias("event_id"), F.col("m.tier").alias("tier"))
    return incoming.select("seq").join(best, "seq", "left")


def pack_attributed(blocks: Column, limit: int = CHUNK_CHARS) -> Column:
    """Blocks (body, ids) joined by blank lines into messages of at most ``limit`` characters, greedily; each message has the
    sorted ids of what is in it. A longer block is cut at its last line feed within the limit, else at the limit; line feeds
    at the cut go, and every part has the ids of the block."""
    ids = lambda x: F.array_sort(F.array_distinct(F.coalesce(x, F.array().cast("array<bigint>"))))
    message = lambda body, n: F.struct(body.alias("body"), ids(n).alias("ids"))
    start = F.struct(F.array().cast("array<struct<body: string, ids: array<bigint>>>").alias("done"), message(F.lit(""), F.array().cast("array<bigint>")).alias("cur"))

    def cut(acc: Column, i: Column) -> Column:
        text = acc["cur"]["body"]
        head = F.left(text, F.lit(limit))
        back = F.instr(F.reverse(head), "\n")  # 0 where there is none; a line feed in front is none either
        at = F.when((back == 0) | (back == limit), limit).otherwise(limit - back)
        rest = F.regexp_replace(F.substring(text, at + 1, F.length(text)), "^\n+", "")
        part, more = message(F.left(text, at), acc["cur"]["ids"]), message(rest, acc["cur"]["ids"])
        return F.when(F.length(text) > limit, F.struct(F.array_append(acc["done"], part).alias("done"), more.alias("cur"))).otherwise(acc)

    def step(acc: Column, b: Column) -> Column:
        empty = acc["cur"]["body"] == ""
        joined = F.when(empty, b["body"]).otherwise(F.concat(acc["cur"]["body"], F.lit("\n\n"), b["body"]))
        both = message(joined, F.concat(acc["cur"]["ids"], F.coalesce(b["ids"], F.array().cast("array<bigint>"))))
        flushed = F.when(empty, acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"]))
        whole = F.struct(flushed.alias("done"), message(b["body"], b["ids"]).alias("cur"))
        parts = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(b["body"]))), whole, cut)  # a cut takes a character at least
        return F.when(F.length(joined) <= limit, F.struct(acc["done"].alias("done"), both.alias("cur"))).when(F.length(b["body"]) <= limit, whole).otherwise(parts)

    return F.aggregate(blocks, start, step, lambda acc: F.when(acc["cur"]["body"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))


def pack_chunks(blocks: Column, limit: int = CHUNK_CHARS) -> Column:
    """``pack_attributed`` of plain texts."""
    none = F.array().cast("array<bigint>")
    return F.transform(pack_attributed(F.transform(blocks, lambda b: F.struct(b.alias("body"), none.alias("ids"))), limit), lambda m: m["body"])


def reverted_schedules(changes: DataFrame) -> DataFrame:
    """changes: event_id, id, old_value, new_value, observed_at, starts_at, ends_at (current texts) -> ids to suppress.

    Values that changes connect form components; one that holds no null, is entered as often as left, and in which
    exactly one current field equals the oldest value and no other current value lies, has been reverted. The changes of
    one event are few."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            root.setdefault(x, x)
            while root[x] != x:
                x = root[x]
            return x

        group = group.sort_values(["observed_at", "id"])
        values = [(None if pd.isna(o) else o, None if pd.isna(n) else n) for o, n in zip(group.old_value, group.new_value, strict=True)]
        for o, n in values:
            root[find(o)] = find(n)
        gone = []
        for r in {find(o) for o, _ in values}:
            at = [i for i, (o, _) in enumerate(values) if find(o) == r]
            members = {v for i in at for v in values[i]}
            balance: dict = {}
            for i in at:
                balance[values[i][0]] = balance.get(values[i][0], 0) - 1
                balance[values[i][1]] = balance.get(values[i][1], 0) + 1
            current = [c for c in (group.starts_at.iloc[0], group.ends_at.iloc[0]) if c in members]
            if None not in members and not any(balance.values()) and current == [values[at[0]][0]]:
                gone += [group.id.iloc[i] for i in at]
        return pd.DataFrame({"event_id": group.event_id.iloc[0], "id": pd.Series(gone, dtype="int64")})

    return changes.groupBy("event_id").applyInPandas(run, "event_id long, id long")
