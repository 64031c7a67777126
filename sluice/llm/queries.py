"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import (
    bpe,
    decontaminate,
    fill_in_middle,
    html_extract,
    language_id,
    line_dedup,
    pii,
    quality,
    setsketch,
    token_store,
    toxicity,
    warc_zip,
    whitening,
)
from sluice.llm.common import read_table

#: Only for the registered query; a user passes a key of their own.
PSEUDONYM_KEY = b"key of the registered query"
BYTE_BPE = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Where the installed vocabulary lies; every machine has it at its own place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return decontaminate.decontamination_report(docs, read_table(spark, folder, "benchmark"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.language_report(read_table(spark, folder, "documents"))


def op3_token_store(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return token_store.store_tokens(spark, docs, tokenizer_path())


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(read_table(spark, folder, "documents"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, folder, "documents"), PSEUDONYM_KEY)


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_duplicates(read_table(spark, folder, "documents"), width=3, percent=85)


def op7_warc_packages(spark: SparkSession, folder: str) -> DataFrame:
    pages = warc_zip.archive_pages(spark, read_table(spark, folder, "pages"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(read_table(spark, folder, "documents"))


def op9_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path())


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, folder, "pages"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitening_report(read_table(spark, folder, "embeddings"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.fim_report(read_table(spark, folder, "documents"))


def registered() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def statements() -> dict[str, str]:
    """SQL for those that SQL can express."""
    from sluice.llm import sql

    return sql.statements()
