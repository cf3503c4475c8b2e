"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swathe.llm import exact_dedup, importance, matroska, mixing, packing, pitman_yor, simhash, substring_dedup, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_simhash": simhash.op5_simhash,
        "op6_packing": packing.op6_packing,
        "op7_lm_score": pitman_yor.op7_lm_score,
        "op8_importance": importance.op8_importance,
        "op9_warc_audit": warc.op9_warc_audit,
        "op10_media": matroska.op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op2_substring_dedup": substring_dedup.OP2_SQL,
        "op3_mix_sources": mixing.OP3_SQL,
        "op9_warc_audit": warc.OP9_SQL,
    }
