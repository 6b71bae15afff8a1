"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, language, lines, mixing, neardup, neighbours, packing, privacy, quality, resampling, secrets, substrings, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
        "op4_hilbert_neighbours": neighbours.op4_hilbert_neighbours,
        "op5_warc_round_trip": warc.op5_warc_round_trip,
        "op6_personal_data": privacy.op6_personal_data,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_radix_substring_dedup": substrings.op9_radix_substring_dedup,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_importance_resampling": resampling.op12_importance_resampling,
        "op13_language_model_scores": language.op13_language_model_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.OP2_SQL, "op5_warc_round_trip": warc.OP5_SQL, "op11_conversation_repair": conversations.OP11_SQL, "op12_importance_resampling": resampling.OP12_SQL}
