"""The corpus pipeline: quality, exact dedup, near dedup, mixing and encoding of documents.

Each stage works on all rows that the one before kept and is written as Parquet before the next
reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm import bpe, exact, mixing, ngram_join, quality
from postmill.llm.common import drop_tables, read_table, settle
from postmill.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; the labels of ``sf_dir`` teach it."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least id."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.repeat_by_source(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with their digests."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True, with_decoded=False)


#: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: A trained classifier, components and the flow have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again; what a stage staged goes with it.

    * Null texts are empty: judged by the features of an empty text, copies of each other, without
      shingles, taken by the mix only where it takes their whole source, without tokens.
    * Null ids, sources and languages are values like others; a copy with an id stays before one without.
    * Rows that repeat id and text are copies; rows that repeat an id only are documents of their own.
    * Texts of any length go through whole. An empty table gives no rows.
    * Columns beyond those of documents go through all stages but the last, whatever their names.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
