from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from siftwell.llm import prefix_trie
from siftwell.llm.prefix_trie import branched, numbered_turns, prefix_trie as build, trie_of, trie_report

SCHEMA = "conv_id long, turn long, role string, text string, no string, depth string, words string"


def brute(chains: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    """Every prefix of every conversation, its members and its subtree, by a plain loop."""
    nodes: dict[tuple, list[int]] = {}
    for c, turns in chains.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = sum(not any(q[:-1] == p for q in nodes if q) for p in under)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(chains[c]) == len(path)))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    chains: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            chains.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def md5(s: str) -> str:
        return hashlib.md5(s.encode()).hexdigest()

    return {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1], md5(f"{len(x[2])}:{x[2]}"), md5(f"{len(x[2])}:{x[2]}{x[3]}")))] for c, v in chains.items()}


def rebuilt(chains: dict[int, list]) -> dict[int, list]:
    return {c: chains.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in chains.items()}


def found(trie) -> set[tuple]:
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = trie_report(trie).collect()
    assert len(rows) == len({tuple(r[c] for c in cols) for r in rows})
    return {tuple(r[c] for c in cols) for r in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in range(70):
        for turn in range(rng.randint(1, 6)):
            out.append((c * rng.choice([1, 1, 1, 3]), turn if turn else None, rng.choice(["user", None, "a"]), rng.choice(["", None, "one two", "x y z", "same"])))
    out += [(5, 2, "user", "same")] * 3 + [(None, 1, "user", "lost"), (301, 0, "u", "v"), (302, 0, "u", "v"), (323, 0, "u", None), (900, 0, "user", "hub"), (7, 1, "ab", "c"), (8, 1, "a", "bc")]
    out += [(c, 0, "user", "hub") for c in range(901, 920)]  # copies
    out += [(1000, t, "user", f"deep {t % 7}") for t in range(60)] + [(1020, t, "user", f"deep {t % 7}") for t in range(45)] + [(1040, t, "user", f"deep {t % 7}") for t in range(60)]
    return out


def test_stored_conversations(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    df = spark.createDataFrame([(*r, "n", "d", "w") for r in rows], SCHEMA)
    assert found(build(df)) == brute(ordered(rows))


def test_rebuilt_conversations(spark, rows):
    df = spark.createDataFrame([(*r, "n", "d", "w") for r in rows], SCHEMA)
    chains = rebuilt(ordered(rows))
    assert any(not v for v in chains.values())
    assert found(trie_of(*branched(numbered_turns(df)))) == brute(chains)


def test_chains_below_chains(spark):
    """Each conversation leaves the one before a turn later, so chains hang on chains."""
    rows = [(c, t, "r", f"own {c}" if t == 20 - c else "shared") for c in range(1, 19) for t in range(21 - c)]
    assert found(build(spark.createDataFrame([(*r, "n", "d", "w") for r in rows], SCHEMA))) == brute(ordered(rows))
    deep = [(c, t, "r", f"step {t}" if t < c else f"leaf {c}") for c in range(1, 12) for t in range(c + 1)]
    assert found(build(spark.createDataFrame([(*r, "n", "d", "w") for r in deep], SCHEMA))) == brute(ordered(deep))


def test_one_long_conversation_is_numbered_in_ranges(spark):
    n = 5000
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("r").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    got = {(r.no, r.words) for r in numbered_turns(df).collect()}
    assert got == {(i, 1) for i in range(1, n + 1)}
    report = trie_report(build(df.unionByName(df.filter("turn < 3000").withColumn("conv_id", F.lit(2).cast("long"))))).cache()
    assert report.count() == n + 1 and report.filter("n_convs = 2").count() == 3001
    assert report.filter("depth = 0").first().saved_tokens == 3000


def test_empty_table_has_no_root(spark):
    assert trie_report(build(spark.createDataFrame([], SCHEMA))).count() == 0
