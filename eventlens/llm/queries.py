"""The registered queries of this subpackage and their DuckDB oracle SQL."""

from __future__ import annotations

from . import decontaminate, licence_scan, line_dedup, mixing, ngram_join, page_text, quality, resample, secret_scan, sharding, token_files, url_filter, vector_codes

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_token_files": token_files.op3_token_files,
    "op4_licence_scan": licence_scan.op4_licence_scan,
    "op5_page_text": page_text.op5_page_text,
    "op6_fuzzy_line_dedup": line_dedup.op6_fuzzy_line_dedup,
    "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_jump_sharding": sharding.op10_jump_sharding,
    "op11_url_filter": url_filter.op11_url_filter,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_importance_resample": resample.op13_importance_resample,
}

#: Operators without SQL are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op7_ngram_jaccard_join": ngram_join.ORACLE_SQL,
    "op8_secret_scan": secret_scan.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op11_url_filter": url_filter.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
