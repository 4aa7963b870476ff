"""Registered queries of the subpackage, each over its whole table, and their DuckDB oracles where SQL can say them.

Tokenizers, trained models, MinHash and byte windows over whole tables are beyond SQL: those queries are compared with
brute-force versions, exact round trips or held-out labels in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, collocations, exact_dedup, harmonic_packing, host_rules, html_tree, jaccard_forest, license_rules, merge_dropout, quality_model, repeat_index, spelling_variants, token_store
from .storage import prepared


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.token_directory(_table(spark, folder, "documents"))


def op2_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    return merge_dropout.dropout_round_trip(_table(spark, folder, "documents"), seed=1)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, folder, "documents"))


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_tree.main_texts(_table(spark, folder, "pages"))


def op6_jaccard_forest(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_forest.jaccard_classes(_table(spark, folder, "documents"))


def op7_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return host_rules.host_quality(_table(spark, folder, "documents"))


def op8_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return harmonic_packing.pack_documents(_table(spark, folder, "documents"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat_format.conversation_digest(chat_format.with_sample(_table(spark, folder, "conversations")))


def op10_repeat_index(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_index.repeated_bytes(_table(spark, folder, "documents"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, folder, "documents"))


def op13_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return license_rules.scan_licenses(_table(spark, folder, "documents")).drop("detections")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: fn
    for fn in (op1_token_store, op2_merge_dropout, op3_quality, op4_exact_dedup, op5_html_text, op6_jaccard_forest, op7_host_rules, op8_harmonic_packing, op9_chat_format, op10_repeat_index, op11_collocations, op12_spelling_variants, op13_license_rules)
}
ORACLES = {"op4_exact_dedup": exact_dedup.SQL, "op7_host_rules": host_rules.SQL, "op9_chat_format": chat_format.SQL, "op11_collocations": collocations.SQL, "op12_spelling_variants": spelling_variants.SQL, "op13_license_rules": license_rules.SQL}
