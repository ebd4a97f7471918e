"""The queries ``opN_<name>`` of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_trie import conversation_trie
from .decontam import contamination
from .hard_negatives import hard_negatives
from .langid import fit, identify, page_evidence
from .license_scan import license_scan
from .lm_score import lm_scores
from .near_dedup import near_duplicates
from .packing import pack
from .quality_rules import quality_rules
from .sharding import shard
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .topk import top_k

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents, held out or not."""
    return lm_scores(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every twentieth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents (doc_id; their source stands for a host)
    and all pages (page_id)."""
    documents = _table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    docs = documents.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("source").alias("host"), none.alias("suffix"), none.alias("declared"))
    pages = page_evidence(_table(spark, sf_dir, "pages")).select(F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "host", "suffix", "declared")
    return identify(docs.unionByName(pages), fit(documents), ["doc_id", "page_id"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold three quarters of a benchmark item's shingles."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a similarity of 0.75."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all documents."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutting-stock packing of all documents into sequences of 2048 tokens."""
    return pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    return shard(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 100 bytes that start earlier."""
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by base rules and a decision list learned from their labels."""
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector; each seventh carries the next label."""
    vectors = _table(spark, sf_dir, "embeddings")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, whose first turns (crc32 of the id
    modulo 6 many) are those of the id's hundred."""
    conv = F.col("conv")
    return conversation_trie(_table(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scores, op2_topk, op3_language_id, op4_decontamination, op5_near_dedup, op6_license_scan, op7_packing, op8_sharding, op9_suffix_dedup, op10_token_counts, op11_quality_rules, op12_hard_negatives, op13_conversation_trie)}

#: Vectors with null or non-finite components take no part.
_OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

_OP12_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.v, o.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: The crc32 is that of the polynomial 0xEDB88320, over a table of 256 made here.
_OP13_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS steps
), ids AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
      lambda a, b: xor(a // 256, steps[xor(a % 256, b) + 1])), 4294967295) % 6 AS h
  FROM ids, crc
), own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), long AS (
  SELECT h.conv_id, 0 AS part, o.pos, o.digest, o.size FROM heads h JOIN own o ON o.conv_id = h.base AND o.pos <= h.h
  UNION ALL
  SELECT h.conv_id, 1, o.pos, o.digest, o.size FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, digest, size FROM long
), paths AS (
  SELECT conv_id, depth, size, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads
), placed AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM paths
), nodes AS (
  SELECT node, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM placed GROUP BY node, depth
), children AS (
  SELECT above AS node, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above
), sums AS (
  SELECT p.node, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.size) AS saved_tokens
  FROM nodes x LEFT JOIN children c ON c.node = x.node JOIN paths p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.node
)
SELECT x.conv_id, x.depth, a.conv_id AS parent_conv_id, x.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums s ON s.node = x.node LEFT JOIN nodes a ON a.node = x.above LEFT JOIN children c ON c.node = x.node
"""

ORACLE: dict[str, str] = {"op2_topk": _OP2_SQL, "op12_hard_negatives": _OP12_SQL, "op13_conversation_trie": _OP13_SQL}
