"""Mixing sources to target weights: Efraimidis-Spirakis sampling with DataFrame functions only.

Every document draws u from its id and gets the key -ln(u) / quality; within a source the smallest keys are taken
until the token budget is reached. A source whose target exceeds its size is first taken whole as often as it fits
(complete epochs); the sampling fills the fraction that remains.

No source is sorted as a whole: keys fall into ``buckets`` ranges of equal probability, whose number grows with the rows;
sums of whole ranges give the one range in which the budget ends, and only that range is sorted. Sources themselves are
taken to be few (thousands): their targets are computed together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import TOKEN, materialize

#: Signs that prose has few of; their share lowers a document's quality weight.
SIGNS = "!#$%&*|<>{}[]\\^~_=+@"


def quality_weight(text: Column) -> Column:
    """Share of the characters that are no SIGNS, 0.1 at least; 1 for an empty text."""
    plain = F.length(F.translate(text, SIGNS, ""))
    return F.greatest(F.lit(0.1), F.coalesce(F.try_divide(plain.cast("double"), F.length(text).cast("double")), F.lit(1.0)))


def uniform(id_: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """sources: (source, source_size), one row each. Adds target: water filling under caps of most * source_size.

    With the sources in order of cap / weight, those before the first that its even share does not fill are at their
    caps, and the level of that first one holds for all others.
    """
    by_name = sources.withColumn("__no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("__no") - 1) % len(weights) + 1).cast("int"))
    rows = by_name.withColumn("__w", pick).withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("__ratio", F.col("__cap") / F.col("__w"))
    order = Window.orderBy("__ratio", "__no")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumn("__full", F.coalesce(F.sum("__cap").over(before), F.lit(0.0))).withColumn("__gone", F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    level = (F.sum("source_size").over(whole) - F.col("__full")) / (F.sum("__w").over(whole) - F.col("__gone"))
    rows = rows.withColumn("__level", level)
    first = F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__no", "__level"))).over(whole)
    return rows.select("source", "source_size", F.least("__cap", F.coalesce(first["__level"] * F.col("__w"), F.col("__cap"))).alias("target"))


def _ranges(docs: DataFrame, buckets: int | None) -> int:
    """4096 ranges, or as many as leave some 4096 rows in each."""
    return buckets or min(1 << 20, max(4096, docs.count() // 4096))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, buckets: int, quality: Column | None) -> dict[str, Column]:
    """What the mix needs of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = -F.log(uniform(F.col(id_col), seed)) / (quality_weight(text) if quality is None else quality)
    return {
        "__id": F.col(id_col), "__source": F.col(source_col), "__size": F.regexp_count(text, F.lit(TOKEN)).cast("long"), "__key": key,
        "__bucket": F.least(F.lit(buckets - 1), F.floor((1 - F.exp(-key)) * buckets)).cast("int"),
    }


def _plan(rows: DataFrame, weights: tuple[float, ...], most: float, buckets: int) -> DataFrame:
    """One row per source: __source, source_size, target, epochs, rest, last (the range in which the rest ends), before
    (the sum of the ranges below)."""
    ranges = rows.groupBy("__source", "__bucket").agg(F.sum("__size").alias("n"))
    sources = _targets(ranges.groupBy(F.col("__source").alias("source")).agg(F.sum("n").alias("source_size")), weights, most)
    sources = sources.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = ranges.withColumn("until", F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket")))
    ends = sums.alias("r").join(sources.alias("s"), F.col("r.__source").eqNullSafe(F.col("s.source"))).filter(F.col("until") > F.col("rest"))
    ends = ends.groupBy("__source").agg(F.min(F.struct("__bucket", (F.col("until") - F.col("n")).alias("before"))).alias("end"))
    return materialize(
        sources.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.__source")), "left")
        .select(F.col("source").alias("p_source"), "source_size", "target", "epochs", "rest", F.coalesce("e.end.__bucket", F.lit(buckets)).alias("last"), F.coalesce("e.end.before", F.lit(0)).alias("before")), "mix-plan",
    )


def _ending(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of the ranges in which the rests end, with extra: whether the fraction takes the row."""
    inner = rows.join(plan, F.col("__source").eqNullSafe(F.col("p_source"))).filter(F.col("__bucket") == F.col("last"))
    until = F.sum("__size").over(Window.partitionBy("__source").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, -1))
    inner = inner.withColumn("until", F.col("before") + F.coalesce(until, F.lit(0)))
    return inner.withColumn("extra", (2 * F.col("until") + F.col("__size") <= 2 * F.col("rest")).cast("long")).drop("until")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3.0, seed: int = 17, buckets: int | None = None, quality: Column | None = None,
) -> DataFrame:
    """One row per input row: id_col, size, source_size, target, taken, times.

    size: words of the text (null and empty texts: 0). Sources in code-point order, null last, weigh ``weights`` in turn
    and share the sum of all sizes; a target stops at ``most`` times its source's size and the excess is shared anew.
    times: how often the mix takes the row; taken: times * size. The last document is taken if that comes nearer to the
    target. Ties of keys go by id. Repeated rows are rows of their own. Reruns agree. An empty table gives an empty
    result. Other columns are ignored. quality: weights of documents, positive; by default ``quality_weight``.
    """
    buckets = _ranges(docs, buckets)
    drawn = _drawn(docs, id_col, text_col, source_col, seed, buckets, quality)
    rows = materialize(docs.select(*(c.alias(n) for n, c in drawn.items())), "mix")
    plan = _plan(rows, weights, most, buckets)
    outer = rows.join(plan, F.col("__source").eqNullSafe(F.col("p_source"))).filter(F.col("__bucket") != F.col("last"))
    outer = outer.withColumn("extra", (F.col("__bucket") < F.col("last")).cast("long"))
    times = F.col("epochs") + F.col("extra")
    out = outer.unionByName(_ending(rows, plan))
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (times * F.col("__size")).alias("taken"), times.alias("times"))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3.0, seed: int = 17, buckets: int | None = None, quality: Column | None = None,
) -> DataFrame:
    """The mix itself: rows with all their columns, each as often as ``mix`` takes it.

    Which rows are taken follows from the last key that each source takes, so texts are not shuffled; only where rows that
    repeat id, size and key are not all taken, these are numbered. Nulls and empty texts have size 0: they are drawn like
    others and come as often as ``mix`` says. An empty table gives an empty result. Columns may have any names.
    """
    buckets = _ranges(docs, buckets)
    drawn = _drawn(docs, id_col, text_col, source_col, seed, buckets, quality)
    rows = materialize(docs.select(*(c.alias(n) for n, c in drawn.items())), "mix")
    plan = _plan(rows, weights, most, buckets)
    place = F.struct("__key", "__id", "__size")
    ending = materialize(_ending(rows, plan).select("__source", place.alias("place"), "extra"), "mix-ending")
    last = ending.filter("extra = 1").groupBy(F.col("__source").alias("l_source")).agg(F.max("place").alias("top"))
    same = F.col("__source").eqNullSafe(F.col("l_source")) & F.col("place").eqNullSafe(F.col("top"))
    ties = ending.join(last, same).groupBy(F.col("__source").alias("t_source")).agg(F.sum("extra").alias("some"), F.count("*").alias("all"))
    plan = plan.join(last, F.col("p_source").eqNullSafe(F.col("l_source")), "left").join(ties, F.col("p_source").eqNullSafe(F.col("t_source")), "left")
    plan = materialize(plan.select("p_source", "epochs", "last", "top", F.when(F.col("some") < F.col("all"), F.col("some")).alias("some")), "mix-plan")

    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in drawn.items()))
    both = own.join(plan, F.col("__source").eqNullSafe(F.col("p_source")))
    ends = F.col("__bucket") == F.col("last")  # sizes are counted in that range only
    tied = F.coalesce(F.when(ends & F.col("some").isNotNull(), place.eqNullSafe(F.col("top"))), F.lit(False))
    taken = (F.col("__bucket") < F.col("last")) | F.when(ends, F.coalesce(place <= F.col("top"), F.lit(False))).otherwise(False)
    some = plan.filter("some IS NOT NULL").limit(1).count() > 0
    counted = (both.filter(~tied) if some else both).select("row", (F.col("epochs") + taken.cast("long")).alias("times"))
    if some:
        no = F.row_number().over(Window.partitionBy("__source").orderBy("__key"))
        counted = counted.unionByName(both.filter(tied).select("row", (F.col("epochs") + (no <= F.col("some")).cast("long")).alias("times")))
    repeated = counted.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return repeated.select("row.*")
