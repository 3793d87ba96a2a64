"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, byte_bpe, exact_dedup, html_text, lang_id, line_dedup, near_dedup, packing, pii, secret_scan, sql


def queries():
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_html_text": html_text.op6_html_text,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_pii": pii.op8_pii,
        "op9_lang_id": lang_id.op9_lang_id,
        "op10_ann": ann.op10_ann,
    }


def oracle_sql():
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_near_dedup": sql.NEAR,
        "op5_secret_scan": sql.SECRETS,
        "op7_line_dedup": sql.LINES,
        "op8_pii": sql.PII,
        "op10_ann": ann.ORACLE,
    }
