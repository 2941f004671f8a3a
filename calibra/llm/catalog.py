"""Queries and SQL of the operators."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from calibra.llm import (
    chat, decontaminate, fim, hard_negatives, html_extract, language, near_dup, packing, rules, tokens, warc, wavelet, weak_quality,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        rules.op1_quality_rules, tokens.op2_token_counts, language.op3_language_id, weak_quality.op4_quality_classifier, near_dup.op5_near_duplicates,
        wavelet.op6_token_ids, decontaminate.op7_decontamination, html_extract.op8_html_extraction, warc.op9_warc,
        packing.op10_best_fit_packing, hard_negatives.op11_hard_negatives, fim.op12_fill_in_middle, chat.op13_chat_formatting,
    )
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op1_quality_rules": rules.OP1_SQL, "op9_warc": warc.OP9_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL,
           "op12_fill_in_middle": fim.OP12_SQL, "op13_chat_formatting": chat.OP13_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text}
