"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import byte_bpe, conversation_repair, decontaminate, html_extraction, language_id, license_scan, mixing, quality_rules, ranked_search, simhash, suffix_dedup, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_mixing": mixing.op3_mixing,
        "op4_html_extraction": html_extraction.op4_html_extraction,
        "op5_simhash": simhash.op5_simhash,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_token_files": token_files.op8_token_files,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_language_id": language_id.op10_language_id,
        "op11_ranked_search": ranked_search.op11_ranked_search,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.oracle(),
        "op3_mixing": mixing.oracle(),
        "op9_quality_rules": quality_rules.oracle(),
        "op11_ranked_search": ranked_search.oracle(),
        "op12_conversation_repair": conversation_repair.oracle(),
    }
