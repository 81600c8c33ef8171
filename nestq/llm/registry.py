"""The registered queries of this subpackage and the oracle SQL of those that SQL can express."""

from __future__ import annotations

from nestq.llm import bpe_stream, decontaminate, html_extract, language_id, line_dedup, lm_score, near_dedup, quality_rules, secret_scan, substring_dedup

_QUERIES = [
    lm_score.op1_lm_score,
    html_extract.op2_html_extract,
    near_dedup.op3_near_dedup,
    language_id.op4_language_id,
    secret_scan.op5_secret_scan,
    quality_rules.op6_quality_rules,
    decontaminate.op7_decontaminate,
    bpe_stream.op8_bpe_stream,
    line_dedup.op9_line_dedup,
    substring_dedup.op10_substring_dedup,
]


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": quality_rules.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
