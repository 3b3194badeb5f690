"""Names of the training-data queries, with their Spark builders and, where SQL can express them, DuckDB twins."""

from __future__ import annotations

from . import bpe, chat_format, collocations, divergence, language_model, line_dedup, near_dedup, nearest, oracle, packing, quality_model, quality_rules, secret_scan, url_filter


def queries():
    return {
        "op1_packing": packing.query,
        "op2_near_dedup": near_dedup.query,
        "op3_byte_bpe": bpe.query,
        "op4_chat_format": chat_format.query,
        "op5_quality_rules": quality_rules.query,
        "op6_language_model": language_model.query,
        "op7_quality_model": quality_model.query,
        "op8_secret_scan": secret_scan.query,
        "op9_nearest": nearest.query,
        "op10_line_dedup": line_dedup.query,
        "op11_source_divergence": divergence.query,
        "op12_url_filter": url_filter.query,
        "op13_collocations": collocations.query,
    }


def oracle_sql():
    return {
        "op2_near_dedup": oracle.NEAR,
        "op4_chat_format": oracle.CHAT,
        "op11_source_divergence": oracle.DIVERGENCE,
        "op12_url_filter": oracle.URLS,
        "op13_collocations": oracle.COLLOCATIONS,
    }
