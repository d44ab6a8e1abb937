"""The numbered operators' queries over whole tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cross_tokenizer, decontamination, hard_negatives, license_scan, line_dedup, quality, secret_scan, simhash_dedup, toxicity, url_filter, vantage_point, warc

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked pairs of document and benchmark item with their coverage."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated lines."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives written of pages say of each page."""
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth."""
    return vantage_point.nearest(_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's URL."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base phrases and license labels."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and passages."""
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives for each of the five positives of every hundredth vector."""
    return hard_negatives.hard_negatives(hard_negatives.relabel(_table(spark, sf_dir, "embeddings")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links of the tokens of two tokenizers."""
    return cross_tokenizer.align(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: three patterns, and random strings by their characters a token."""
    return secret_scan.digest_rows(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_line_dedup, op3_warc, op4_nearest, op5_url_filter, op6_bpe, op7_quality, op8_simhash,
        op9_licenses, op10_toxicity, op11_hard_negatives,
        op12_token_alignment, op13_secrets,
    )
}

#: Both vector searches are exact (the pruning factor of the first is one). The other results hold hashes, models' scores or
#: components that SQL cannot state; they are tested against brute force.
ORACLES: dict[str, str] = {
    "op4_nearest": """WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
 AND len(list_filter(embedding, lambda e: e <> 0)) > 0 GROUP BY vec_id),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10""",
    "op11_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5""",
}
