"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import materialize, read_table
from siftwell.llm.exact_dedup import exact_dedup
from siftwell.llm.hamming import top_k
from siftwell.llm.hard_negatives import hard_negatives
from siftwell.llm.language_model import lm_scores
from siftwell.llm.mixing import mix
from siftwell.llm.ngram_join import ngram_join
from siftwell.llm.packing import pack
from siftwell.llm.prefix_trie import branched, numbered_turns, trie_of, trie_report
from siftwell.llm.quality import score_quality
from siftwell.llm.substring_dedup import repeated_passages
from siftwell.llm.token_counts import token_counts
from siftwell.llm.toxicity import score_toxicity
from siftwell.llm.url_filter import filter_urls

URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A url that no rule fits is allowed. A null url, and one without ``://``, has an empty host and path; repeated rows come
    back repeated; an empty table gives an empty result; other columns are ignored."""
    return filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id is divisible by 100, among all vectors."""
    rows = read_table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pretrained PPM model with contexts of up to five bytes."""
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have size 0, a null source is the last one; ties of keys go by id and size; repeated rows are rows
    of their own; an empty table gives an empty result; other columns are ignored."""
    return mix(read_table(spark, sf_dir, "documents")).drop("times")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of 0.9 or more."""
    return ngram_join(read_table(spark, sf_dir, "documents"), words=3, num=90, den=100).drop("class_digest")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so that every distinct text is encoded."""
    return token_counts(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the table ``labels``, of 20,000 ids at most; pseudo-labels and scores cover all documents."""
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents share, with four fifths of the words equal."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty ones; null ids are the smallest; of rows that repeat text and id one is kept; an empty table gives
    an empty result; other columns are ignored."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts are the end id alone; very long ones are cut; rows with null ids and repeated rows are packed like
    others; an empty table gives an empty result; other columns are ignored."""
    return pack(read_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voters are mined from the labels of 20,000 ids at most, those of held-out rows left out; the label model, the classifier
    and the scores cover all documents. A null id is held out by no remainder, so held_out is null there."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels").filter(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the same number go by role and digest, null numbers first; null roles and texts are empty; rows without an id
    are left out; repeated turns stay; conversations without turns end in the root; without any conversation the result is
    empty; other columns are ignored."""
    turns = materialize(numbered_turns(read_table(spark, sf_dir, "conversations")), "numbered")
    return trie_report(trie_of(*branched(turns)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; rows whose id is divisible by 7 carry the next label."""
    rows = read_table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives(rows, "id % 50 = 0")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_topk_search": op2_topk_search,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_mixing": op4_mixing,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
    "op11_toxicity": op11_toxicity,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op1_url_filter": r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages AS p
), rules AS (
  SELECT * FROM (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
    ('com/de/', 'com', '/de/', 'block')) AS t(rule, rule_host, rule_path, rule_verdict)
), hits AS (
  SELECT a.page_id, a.host, a.path, r.rule, r.rule_verdict,
    row_number() OVER (PARTITION BY a.page_id, a.host, a.path ORDER BY length(r.rule) DESC) AS no
  FROM parts AS a
  LEFT JOIN rules AS r
    ON (a.host = r.rule_host OR ends_with(a.host, '.' || r.rule_host)) AND starts_with(a.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM hits WHERE no = 1
""",
    "op2_topk_search": """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings AS e WHERE embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
    CAST(list_sum(list_transform(list_zip(q.bits, r.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes AS q JOIN codes AS r ON q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, neighbor_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pairs AS p
)
SELECT query_id, rank, neighbor_id, distance FROM ranked AS k WHERE rank <= 10
""",
    "op4_mixing": r"""
WITH rows_ AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
      / greatest(0.1, CASE WHEN coalesce(text, '') = '' THEN 1.0 ELSE
          CAST(length(translate(text, '!#$%&*|<>{}[]\^~_=+@', '')) AS DOUBLE) / CAST(length(text) AS DOUBLE) END) AS key
  FROM documents AS d
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n, 3.0 * sum(size) AS cap,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM rows_ GROUP BY source
), levels AS (
  SELECT a.source, a.n, a.cap, a.w, a.cap / a.w AS ratio,
    ((SELECT sum(n) FROM sources AS t) - coalesce((SELECT sum(b.cap) FROM sources AS b WHERE b.cap / b.w < a.cap / a.w), 0.0))
      / ((SELECT sum(w) FROM sources AS t) - coalesce((SELECT sum(b.w) FROM sources AS b WHERE b.cap / b.w < a.cap / a.w), 0.0)) AS level
  FROM sources AS a
), targets AS (
  SELECT source, n, least(cap, coalesce((SELECT arg_min(level, ratio) FROM levels AS l WHERE level <= ratio) * w, cap)) AS target FROM levels AS m
), plan AS (
  SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE floor(target / n) END AS epochs,
    target - CASE WHEN n = 0 THEN 0 ELSE floor(target / n) END * n AS rest
  FROM targets AS t
), ranked AS (
  SELECT r.doc_id, r.size, p.n, p.target, p.epochs, p.rest,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows_ AS r JOIN plan AS p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
  CAST((epochs + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM ranked AS k
""",
    "op9_exact_dedup": """
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(coalesce(d.text, '')) AS text_sha256
FROM documents AS d
JOIN (SELECT coalesce(text, '') AS body, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1) AS g
  ON g.body = coalesce(d.text, '')
""",
    "op12_prefix_trie": r"""
WITH ids AS (
  SELECT conv_id, max(no) AS n,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
  FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS no FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS no,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT i.conv_id, i.h, i.conv_id - i.conv_id % 20 AS base, least(i.h, coalesce(b.n, 0)) AS taken FROM ids AS i LEFT JOIN ids AS b ON b.conv_id = i.conv_id - i.conv_id % 20
), rebuilt AS (
  SELECT h.conv_id, t.no, t.digest, t.words FROM heads AS h JOIN turns AS t ON t.conv_id = h.base AND t.no <= h.taken
  UNION ALL
  SELECT h.conv_id, t.no - h.h + h.taken, t.digest, t.words FROM heads AS h JOIN turns AS t ON t.conv_id = h.conv_id AND t.no > h.h
), prefixes AS (
  SELECT conv_id, no AS depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY no) AS path, words FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM prefixes GROUP BY depth, path
), tree AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes AS n LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1)::INTEGER)
), kids AS (
  SELECT t.*, (SELECT count(*) FROM nodes AS k WHERE k.depth = t.depth + 1 AND left(k.path, 64 * t.depth::INTEGER) = t.path) AS n_children FROM tree AS t
), sums AS (
  SELECT a.depth, a.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.words) AS saved_tokens
  FROM kids AS a JOIN kids AS b ON b.depth >= a.depth AND starts_with(b.path, a.path) GROUP BY a.depth, a.path
), lasts AS (
  SELECT conv_id, max(depth) AS depth, arg_max(path, depth) AS path FROM prefixes GROUP BY conv_id
), ends AS (
  SELECT depth, path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM lasts GROUP BY depth, path
)
SELECT k.conv_id, k.depth::BIGINT AS depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM kids AS k JOIN sums AS s USING (depth, path) LEFT JOIN ends AS e USING (depth, path)
""",
    "op13_hard_negatives": """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors AS a JOIN vectors AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM pairs AS p WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives AS p JOIN pairs AS n ON n.anchor_id = p.anchor_id AND n.label <> p.anchor_label
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 3
""",
}
