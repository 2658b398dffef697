"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, flac, jaccard, licenses, lm_scoring, pieces, quality, sharding, substrings

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_media_columns": flac.op2_media_columns,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_sharding": sharding.op8_sharding,
    "op9_ngram_jaccard_join": jaccard.op9_ngram_jaccard_join,
    "op10_license_scans": licenses.op10_license_scans,
}


def oracles() -> dict[str, str]:
    return ORACLES | {"op10_license_scans": licenses.oracle_sql()}


ORACLES = {
    "op1_substring_dedup": substrings.ORACLE_SQL,
    "op3_lm_scoring": lm_scoring.ORACLE_SQL,
    "op4_chat_formatting": chat.ORACLE_SQL,
    "op8_sharding": sharding.ORACLE_SQL,
    "op9_ngram_jaccard_join": jaccard.ORACLE_SQL,
}
