"""The corpus pipeline: language ID, quality, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last give
the columns of documents, in their order. Models and statistics of a stage come
from its own input (all that its predecessor kept) and the labels table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polystrata.llm import language_id, mixing, ngram_join, quality, sentence_pieces
from polystrata.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified; texts that are null, empty, without letters, or mostly of words that fit no language, go.

    All of a very long text counts; equal texts, and rows that repeat, stay or go
    together; a share of fitting letters at the bound stays. Other columns may
    have any names. An empty table gives no rows.
    """
    return language_id.keep_accepted(docs, language_id.train(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the compression classifier scores at its threshold or above.

    Null and empty texts go; all of a very long text counts; equal texts, and rows
    that repeat, stay or go together. Labels of a doc_id that isn't there, with a
    null, or with both values are ignored; without enough of them every text
    stays. Other columns may have any names. An empty table gives no rows.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least doc_id.

    Rows with a null doc_id or text, or without a word, stay; all of a very long
    text counts; a similarity at the threshold is a copy; rows that repeat a
    doc_id stay or go together. Other columns may have any names. An empty table
    gives no rows.
    """
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources meet their token budgets.

    A null source is one of its own; null and empty texts have no tokens; all of
    a very long text is counted; rows that repeat a doc_id within a source are
    taken together, and equal keys are ordered by doc_id. Other columns may have
    any names. An empty table gives no rows.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number, and whether they decode to the text.

    A null text has null ids, an empty one none; a very long one is encoded whole;
    repeated rows give equal rows; ties between merges go to the leftmost. Other
    columns are left out. An empty table gives no rows.
    """
    return sentence_pieces.encode(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs


#: The language, quality and encoding stages can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against plain loops.
ORACLE_SQL = None
