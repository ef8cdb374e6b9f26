"""The corpus operators' queries over whole driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tidy
from . import chat, chunk_dedup, decontaminate, filter_audit, langid, line_dedup, mixing, quality, secrets, simhash, suffix_dedup, turn_repair, url_filter
from .shared import documents

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Each leaves only the tables that its result reads."""
    return {name: tidy(fn) for name, fn in _queries().items()}


def _queries() -> dict[str, Query]:
    return {
        "op1_source_mixing": lambda spark, d: mixing.op1_source_mixing(documents(spark, d)),
        "op3_chat_format": lambda spark, d: chat.op3_chat_format(spark.read.parquet(f"{d}/conversations.parquet")),
        "op8_benchmark_decontamination": lambda spark, d: decontaminate.op8_benchmark_decontamination(
            documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")
        ),
        "op4_secret_scan": lambda spark, d: secrets.op4_secret_scan(documents(spark, d)),
        "op5_suffix_array_dedup": lambda spark, d: suffix_dedup.op5_suffix_array_dedup(documents(spark, d)),
        "op7_quality_rules": lambda spark, d: quality.op7_quality_rules(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
        "op6_language_id": lambda spark, d: langid.op6_language_id(documents(spark, d)),
        "op9_line_dedup": lambda spark, d: line_dedup.op9_line_dedup(documents(spark, d)),
        "op10_chunk_dedup": lambda spark, d: chunk_dedup.op10_chunk_dedup(documents(spark, d)),
        "op2_simhash_near_dedup": lambda spark, d: simhash.op2_simhash_near_dedup(documents(spark, d)),
        "op11_conversation_repair": lambda spark, d: turn_repair.op11_conversation_repair(spark.read.parquet(f"{d}/conversations.parquet")),
        "op12_url_filter": lambda spark, d: url_filter.op12_url_filter(spark.read.parquet(f"{d}/pages.parquet")),
        "op13_filter_audit": lambda spark, d: filter_audit.op13_filter_audit(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": mixing.ORACLE,
        "op4_secret_scan": secrets.ORACLE,
        "op7_quality_rules": quality.ORACLE,
        "op9_line_dedup": line_dedup.ORACLE,
        "op11_conversation_repair": turn_repair.ORACLE,
        "op12_url_filter": url_filter.ORACLE,
        "op13_filter_audit": filter_audit.ORACLE,
    }
