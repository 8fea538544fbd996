"""Prefix trie of conversations by digests.

Every turn is a digest of its role and text; the digest of a conversation's first d turns is a sum over hashes of (position,
turn), 128 bits wide, so it is a running sum that can be cut into blocks. Of all conversations that share a prefix the
one with the smallest id owns the node. Who owns a node owns what follows on its own conversation, so each conversation owns
a chain: the nodes from its first owned depth to its end. That depth is found by binary search: in each round all open
conversations look up the owner of one of their prefixes in the table of minima. The chains, each hanging on a node
of another one, are the tree. Sums over subtrees are made from the chains, bottom-up, by pointer jumping: after round
k a chain holds what lies less than 2 ** k chains below it, so the rounds grow with the logarithm of the height.

Texts are read once; everything after that handles rows of a few numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import TOKEN, materialize

#: Positions of a conversation that one task sums up at most.
BLOCK = 1024
_PARTS = ("s0", "s1", "s2", "s3")
_KEY = ["depth", "k0", "k1"]


@dataclass
class Trie:
    """nodes: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, k0, k1 (the
    digest). ends: one row for each conversation: member, the node in which it ends (depth, k0, k1)."""

    nodes: DataFrame
    ends: DataFrame


def numbered_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, no, turn_digest, words), ``no`` counting from 1 in the order of turns, null first.

    Turns of the same number go by role, then by the digest of role and text, so repeated rows stay repeated. Null roles
    and texts are empty ones. Rows without an id belong to no conversation and are left out. A conversation may
    be of any length: it is numbered within ranges of the order, and the ranges before are counted.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    turns = rows.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role)).alias("role"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_digest"),
        F.regexp_count(text, F.lit(TOKEN)).cast("long").alias("words"),
    ).filter("conv_id IS NOT NULL")
    order = [F.col("turn").asc_nulls_first(), "role", "turn_digest"]
    ranged = materialize(turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    later = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("before > 0").select("conv_id", "range", "before")
    local = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    return ranged.withColumn("local", local).join(later, ["conv_id", "range"], "left").select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("no"), "turn_digest", "words")


def _running(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Each of ``columns`` becomes its sum over the rows of conv_id up to this depth. Blocks of depths are summed apart."""
    rows = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in columns))
    carried = blocks.select("conv_id", "block", *(F.sum(c).over(before).alias(f"{c}_before") for c in columns)).filter("block > 0")
    own = rows.select("*", *(F.sum(c).over(inside).alias(f"{c}_inside") for c in columns)).drop(*columns)
    out = own.join(carried, ["conv_id", "block"], "left")
    sums = [(F.col(f"{c}_inside") + F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in columns]
    return out.select(*(c for c in rows.columns if c not in {*columns, "block"}), *sums)


def _prefixes(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, k0, k1, words, last): all prefixes of all members, the empty one too; last marks the whole conversation."""
    half: list[Column] = []
    for seed in (1, 2):
        whole = F.xxhash64(F.lit(seed), "no", "turn_digest")
        half += [F.shiftrightunsigned(whole, 32), whole.bitwiseAND(F.lit(0xFFFFFFFF))]
    hashed = turns.select("conv_id", F.col("no").cast("long").alias("depth"), "words", *(c.alias(n) for c, n in zip(half, _PARTS, strict=True)))
    roots = members.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), *(F.lit(0).cast("long").alias(n) for n in _PARTS))
    summed = _running(hashed.unionByName(roots), _PARTS)
    low = [F.col(n).bitwiseAND(F.lit(0xFFFFFFFF)) for n in _PARTS]
    keys = [F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("k0"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("k1")]
    return summed.select("conv_id", "depth", *keys, "words")


def _first_owned(prefixes: DataFrame, minima: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, length, first, below): binary search for the first owned depth, length + 1 where none is; below is the owner
    of the node before it, null at the root."""
    state = lengths.select("conv_id", "length", F.lit(-1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"), F.lit(None).cast(lengths.schema["conv_id"].dataType).alias("below"))
    longest = lengths.agg(F.max("length")).first()[0]
    done = None
    # the search is over an interval of length + 2 depths, which halves in each round
    for _ in range(0 if longest is None else int(longest + 2).bit_length()):
        probes = state.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2))
        seen = probes.join(prefixes.select("conv_id", *_KEY), ["conv_id", "depth"]).join(minima.select(*_KEY, "owner"), _KEY)
        mine = F.col("owner") == F.col("conv_id")
        state = seen.select(
            "conv_id", "length", F.when(mine, F.col("lo")).otherwise(F.col("depth")).alias("lo"), F.when(mine, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(mine, F.col("below")).otherwise(F.col("owner")).alias("below"),
        )
        state = materialize(state, "search")
        ended = state.filter("hi - lo = 1")
        done = ended if done is None else done.unionByName(ended)
        state = state.filter("hi - lo > 1")
        if state.isEmpty():
            break
    found = state if done is None else done
    return found.select("conv_id", "length", F.col("hi").alias("first"), "below")


def _totals(chains: DataFrame, sums: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved): of each chain with all chains that hang on it, by pointer jumping."""
    state = materialize(chains.join(sums, "conv_id").select("conv_id", "leaves", "saved", F.col("below").alias("up")), "chains")
    while not state.filter("up IS NOT NULL").isEmpty():
        gained = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.filter("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("upper"))
        risen = state.join(above, "up", "left").join(gained, "conv_id", "left")
        state = materialize(risen.select("conv_id", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("upper").alias("up")), "chains")
    return state.drop("up")


def trie_of(turns: DataFrame, members: DataFrame) -> Trie:
    """The trie of turns (conv_id, no, turn_digest, words), ``no`` counting from 1 without gaps. members: the distinct ids
    of all conversations, those without turns too. Without members there are no nodes, not even a root."""
    prefixes = materialize(_prefixes(turns, members), "prefixes")
    lengths = materialize(prefixes.groupBy("conv_id").agg(F.max("depth").alias("length")), "lengths")
    minima = materialize(prefixes.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("words").alias("words")), "minima")
    searched = materialize(_first_owned(prefixes, minima, lengths), "owned")
    chains = searched.filter("first <= length")

    attached = chains.filter("below IS NOT NULL").groupBy(F.col("below").alias("conv_id"), (F.col("first") - 1).alias("depth"))
    hanging = attached.agg(F.count("*").alias("hung"))
    nodes = minima.withColumnRenamed("owner", "conv_id").join(chains, "conv_id").join(hanging, ["conv_id", "depth"], "left")
    nodes = nodes.withColumn("n_children", F.coalesce("hung", F.lit(0)) + (F.col("depth") < F.col("length")).cast("long"))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("below")))
    nodes = materialize(nodes.select("conv_id", *_KEY, "parent_conv_id", "n_convs", "n_children", "leaves", "saved"), "nodes")

    totals = _totals(chains, nodes.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    below = chains.filter("below IS NOT NULL").join(totals, "conv_id").groupBy(F.col("below").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    full = nodes.join(below, ["conv_id", "depth"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("hung_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("hung_saved", F.lit(0)))
    # a subtree is its chain's total without what lies above
    full = full.drop("hung_leaves", "hung_saved").withColumn("own_leaves", F.col("leaves")).withColumn("own_saved", F.col("saved"))
    summed = _running(full, ("leaves", "saved")).join(totals.withColumnsRenamed({"leaves": "all_leaves", "saved": "all_saved"}), "conv_id")
    out = summed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("all_leaves") - F.col("leaves") + F.col("own_leaves")).alias("n_leaves"),
        (F.col("all_saved") - F.col("saved") + F.col("own_saved")).alias("saved_tokens"), "k0", "k1",
    )
    ends = prefixes.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select(F.col("conv_id").alias("member"), *_KEY)
    return Trie(out, ends)


def prefix_trie(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Trie:
    """The trie of conversations as they are stored; see ``numbered_turns`` for nulls, ties and repeated rows. An empty table
    gives an empty trie. Other columns are ignored."""
    turns = materialize(numbered_turns(rows, id_col, turn_col, role_col, text_col), "numbered")
    return trie_of(turns, turns.select("conv_id").distinct())


def branched(turns: DataFrame, of: int = 20, share: int = 4) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and members of conversations rebuilt from branches: conversation c begins with the first
    crc32(c) % share turns of conversation c - c % of, as far as it has them, and goes on with its own turns after as many."""
    lengths = turns.groupBy("conv_id").agg(F.max("no").alias("n"))
    begun = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % of).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % share).alias("h"))
    heads = materialize(begun.join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "heads")
    own = turns.join(heads, "conv_id").filter("no > h").select("conv_id", (F.col("no") - F.col("h") + F.col("taken")).alias("no"), "turn_digest", "words")
    lent = turns.filter(F.col("no") < share).withColumnRenamed("conv_id", "base").join(heads.select("conv_id", "base", "taken"), "base").filter("no <= taken").select("conv_id", "no", "turn_digest", "words")
    return own.unionByName(lent), heads.select("conv_id")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k0, k1, ends_sha256): SHA-256 of the members that end in a node, as decimals in ascending order, joined by commas.
    The members of a node go through one digest one after another; a task holds one batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for depth, k0, k1, member in zip(*columns, strict=True):
                if key == (depth, k0, k1):
                    digest.update(f",{member}".encode())
                else:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (depth, k0, k1), hashlib.sha256(str(member).encode())
            if out:
                yield _digest_batch(out)
        if key is not None:
            yield _digest_batch([(*key, digest.hexdigest())])

    ordered = ends.select(*_KEY, "member").repartition(*_KEY).sortWithinPartitions(*_KEY, "member")
    return ordered.mapInArrow(run, "depth long, k0 long, k1 long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "k0", "k1", "ends_sha256"])


def trie_report(trie: Trie) -> DataFrame:
    """The nodes with the digest of those that end in them; the digest of an empty text where none does."""
    found = trie.nodes.join(ends_digests(trie.ends), _KEY, "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).drop("k0", "k1")
