"""Registered queries of the training-data operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polystrata.llm import language_id, mixing, ngram_join, nn_descent, quality, sentence_pieces, sharding, topk_search, toxicity, wrappers
from polystrata.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated compression score."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's texts by slot of its host's wrapper, and its content."""
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every passage of benchmark."""
    return topk_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many copies of every document the mixture holds."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document; documents of equal text are one group, so that a shard can be deduplicated by itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("copy_of"), mixing.token_count(F.col("text")).alias("tokens"))
    return sharding.shard(docs, ["copy_of"], F.col("tokens")).select("doc_id", "shard", "tokens", "group_size")


def op6_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's class of near duplicates, and how many it has."""
    return nn_descent.neighbours(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language and labelled spans."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids under merge-dropout, decoded again."""
    return sentence_pieces.encode(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with near copies: its class, and how many it has."""
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents, with what was found in them as written and once restored."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


for _f in (op1_quality_classifier, op2_html_extraction, op3_topk_search, op4_mixing, op5_sharding, op6_embedding_neighbours, op7_language_id, op8_sentence_pieces, op9_ngram_jaccard, op10_toxicity):
    QUERIES[_f.__name__] = _f

ORACLE["op3_topk_search"] = topk_search.SQL
ORACLE["op4_mixing"] = mixing.SQL
ORACLE["op9_ngram_jaccard"] = """
WITH RECURSIVE d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS size, text
       FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND regexp_matches(text, '[\\p{L}\\p{N}]')),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS a FROM d WHERE doc_id = rep),
g AS (SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, unnest(CASE WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
               ELSE list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2]) END) AS gram
        FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS u, y.doc_id AS v, count(*) AS overlap FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM o JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE overlap / (p.n + q.n - overlap)::DOUBLE >= 0.5 - 1e-12),
l AS (SELECT u, sum(size)::BIGINT AS links FROM e JOIN d ON d.doc_id = v GROUP BY u),
c AS (SELECT doc_id AS node, doc_id AS reach FROM d WHERE doc_id = rep UNION SELECT c.node, e.v FROM c JOIN e ON e.u = c.reach),
m AS (SELECT node, min(reach) AS class_id FROM c GROUP BY node)
SELECT d.doc_id, m.class_id, coalesce(l.links, 0) + d.size - 1 AS links FROM d JOIN m ON m.node = d.rep LEFT JOIN l ON l.u = d.rep WHERE coalesce(l.links, 0) + d.size > 1
"""
