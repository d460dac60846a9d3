"""Corpus pipeline: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but
the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import materialize, release, table
from sluice.llm.ngrams import keep_one
from sluice.llm.packing import pack_documents
from sluice.llm.private import sanitise
from sluice.llm.quality import keep_good
from sluice.llm.suffixes import drop_repeats


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among them. Null and empty texts are scored like others; repeated rows share a score; without labels all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more. The smallest doc_id stays, with its repeats; documents without words, null texts among them, all stay."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated strings cover. Null texts stay null, empty and short ones as they are; all copies of a repeated row lose their bytes."""
    return _measured(drop_repeats(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced and disclosing terms generalised or removed. Null and empty texts stay as they are; repeated rows count as one text and are rewritten alike."""
    return _measured(sanitise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and places in sequences of 4096 tokens. A null or empty text is one piece of its end token; repeated rows are packed each; an empty table gives no pieces."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("private data", private_data),
    ("packing", packing),
]

ORACLE_SQL = None  # a trained model, hashing and packing are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes when the next one is written."""
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        release(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
