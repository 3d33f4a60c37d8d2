"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm import bpe, brown_lm, chat, edit_embedding, exact_dedup, fim, licenses, mixing, quality, resampling, revisits, simhash, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality.op1,
        "op2_exact_dedup": exact_dedup.op2,
        "op3_edit_fingerprints": edit_embedding.op3,
        "op4_brown_lm": brown_lm.op4,
        "op5_simhash": simhash.op5,
        "op6_mixing": mixing.op6,
        "op7_revisits": revisits.op7,
        "op8_bpe": bpe.op8,
        "op9_license_scan": licenses.op9,
        "op10_chat_format": chat.op10,
        "op11_fill_in_middle": fim.op11,
        "op12_suffix_dedup": suffix_dedup.op12,
        "op13_importance_resampling": resampling.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.OP2_SQL, "op7_revisits": revisits.OP7_SQL, "op10_chat_format": chat.OP10_SQL, "op11_fill_in_middle": fim.OP11_SQL}
