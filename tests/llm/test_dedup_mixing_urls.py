from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from siftwell.llm.exact_dedup import Directory, exact_dedup, keep_distinct
from siftwell.llm.mixing import mix
from siftwell.llm.url_filter import filter_urls


@pytest.mark.parametrize("options", [{}, {"key_bits": 2, "bucket_rows": 2}, {"bucket_rows": 1}])
def test_exact_dedup(documents, nothing, options):
    rows, found = documents.collect(), exact_dedup(documents, **options).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    assert len(found) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in found:
        ids = by_sha[r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(kept[s] == 1 for s in by_sha)
    distinct = keep_distinct(documents, **options)
    assert distinct.columns == documents.columns
    assert sorted((r.text or "") for r in distinct.collect()) == sorted(groups)
    assert exact_dedup(nothing).count() == 0 and keep_distinct(nothing).count() == 0


def test_directory_doubles_and_splits():
    d = Directory.build({0: 10, 1: 1, 7: 3}, 3, 3)
    sizes = defaultdict(set)
    for p in range(8):
        sizes[d.slots[p >> (3 - d.depth)]].add(p)
    assert d.depth == 3 and {0} in sizes.values()  # the hot prefix has a bucket of its own and chains
    assert Directory.build({0: 2}, 3, 3).slots == [0]


def test_mixing(spark, documents, nothing):
    found = mix(documents).collect()
    assert len(found) == documents.count() and {r.taken for r in mix(nothing).collect()} == set()
    assert sorted(map(str, found)) == sorted(map(str, mix(documents).collect()))
    for r in found:
        assert r.taken == r.times * r.size and r.times <= 3 and r.target <= 3 * r.source_size + 1e-6
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(1, 9)), "en", rng.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(4000)]
    df = spark.createDataFrame(rows, documents.schema.fieldNames()[:5])
    for buckets in (1, 64):
        taken, target, size = defaultdict(int), {}, {}
        for r in mix(df, buckets=buckets).collect():
            s = rows[r.doc_id][3]
            taken[s] += r.taken
            target[s], size[s] = r.target, r.source_size
        assert all(abs(taken[s] - target[s]) <= 9 for s in target)
        assert sum(target.values()) == pytest.approx(sum(size.values()))
        free = [s for s in target if target[s] < 3 * size[s] - 1e-6]
        weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
        level = {target[s] / weight[s] for s in free}
        assert max(level) == pytest.approx(min(level)) and all(3 * size[s] <= min(level) * weight[s] + 1e-6 for s in target if s not in free)
    plain = [sorted(map(str, mix(df, buckets=b).select("doc_id", "taken").collect())) for b in (1, 64)]
    assert plain[0] == plain[1]


def test_urls(spark):
    urls = ["http://A.org/x", "http://a.example.org/es/1", "http://example.org/en/12", "https://example.org", "http://b.com/fr/", "ftp://com/de/x?y://z", None, "", "nothing", "http://xorg/", "http://d.example.com/de/#a", "http://e.com?x://org/", "http://example.org/en"]
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "net"), ("allow", "net")]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith(r[len(r.partition("/")[0]) :])]
        best = max(fits, default=None)
        return (host, path, best[3], best[4]) if best else (host, path, None, "allow")

    for limit in (1 << 20, 0):
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules, max_trie_bytes=limit).collect()}
        assert found == {i: brute(u) for i, u in enumerate(urls)}
    assert filter_urls(df.limit(0), rules).count() == 0 and filter_urls(df, []).filter("rule is not null").count() == 0
