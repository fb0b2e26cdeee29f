"""The corpus pipeline: toxicity, exact dedup, near-duplicates, mixing and SentencePiece encoding, one after the other.

Each stage takes all that the one before it kept.  The first four return the columns of ``documents``, the last the
encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import exact_dedup, mixing, queries, sentencepiece, simhash, toxicity
from gridspark.llm.common import DOCUMENT_COLUMNS, WORD, drop_written, keep_rows, lower_ascii, table, tune
from gridspark.sources.scratch import dropping_tables, shared_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose toxicity reaches the threshold. NULL texts and texts without a word have nothing toxic and stay.

    Repeated rows are judged each for itself; an empty table gives an empty result.
    """
    tune(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~queries.held_out(3, 1))
    clean = toxicity.score(F.col("text"), model) < toxicity.Settings().threshold
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    return docs.filter(clean | wordless).select(*DOCUMENT_COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: one with the largest id.

    The verdict is a row's own: of rows that repeat an id only those go whose text is a copy, one of whole rows that are
    repeated stays, and a row with a NULL id stays only where its group has no other.
    """
    tune(spark)
    docs = docs.select(*DOCUMENT_COLUMNS)
    groups = exact_dedup.exact_dedup(docs).filter("group_size > 1")
    return keep_rows(docs, "doc_id", F.sha2(lower_ascii(F.col("text")), 256), groups.select(F.col("doc_id").alias("id"), F.col("full_hash").alias("key"), "kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: SimHash over five-word shingles, similarity of 0.8 or more.

    Texts without a word are near copies of each other. The verdict is a row's own, see :func:`simhash.without_near_copies`.
    """
    tune(spark)
    return simhash.without_near_copies(docs.select(*DOCUMENT_COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics get their target shares of tokens.

    NULL and empty texts are drawn with their cell, which goes if it has no tokens at all; NULL sources and languages are values like any other; repeated rows of an id
    share one draw; an empty table gives an empty result.
    """
    tune(spark)
    return mixing.sampled(docs).select(*DOCUMENT_COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of SentencePiece pieces, with the check that they decode to the text, for each row; NULL texts have none."""
    tune(spark)
    return sentencepiece.encode(docs, f"{queries.TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
          ("mixing", mixed), ("sentencepiece", encoded)]

#: A trained classifier, links by fingerprints and a Viterbi search are beyond SQL; tests/llm/test_pipeline.py holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote for itself, and its input, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        with dropping_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs, last = spark.read.parquet(path), docs
        if before:
            drop_written(last)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
