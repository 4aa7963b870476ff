"""From raw documents to packed sequences: quality, exact copies, near copies, repeated passages, packing.

Every stage works on all rows that the one before kept; documents keep their columns until they are packed, whatever
else these are called.  Null and empty texts are judged like others by the classifier and are copies of each other; of
rows that repeat a key or a text one stays; ties go to the longer text, then to the smaller key; very long texts are read whole.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.exact_dedup import drop_exact_duplicates
from corpusloom.llm.harmonic_packing import pack_documents
from corpusloom.llm.jaccard_forest import drop_near_duplicates
from corpusloom.llm.quality_model import keep_good
from corpusloom.llm.repeat_index import without_repeats
from corpusloom.llm.storage import prepared, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, learnt from the labels outside the held-out fold."""
    return keep_good(docs, prepared(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    prepared(spark)
    return drop_exact_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group connected by similar sets of five words."""
    prepared(spark)
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 200 bytes that occur more than once."""
    prepared(spark)
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    prepared(spark)
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_dedup),
    ("packing", packing),
]

# A trained classifier and a tokenizer are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written before the next one reads it."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
